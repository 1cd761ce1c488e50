"""Column functions for ids, names and report cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator of scoped group ids and the pattern of member file names.
GROUP_SEPARATOR = "::patient_idx="
MEMBER_NAME = r"(?i)^(.+)\.svs_roi_([0-9]+)\.png$"


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null: the rule for every metric."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def canonical_index(value: Column) -> Column:
    """Trimmed; an integer written with a zero fraction loses it (``12.00`` is ``12``); null stays null."""
    return F.regexp_replace(F.trim(value), r"^([+-]?[0-9]+)\.0+$", "$1")


def clean_index(value: Column) -> Column:
    """The weaker form: only one ``.0`` after digits is dropped."""
    return F.regexp_replace(F.trim(value), r"^([0-9]+)\.0$", "$1")


def scoped_group(stratum: Column, index: Column) -> Column:
    """Group id unique across strata; null if the stratum holds the separator or a part is empty."""
    bad = stratum.contains(GROUP_SEPARATOR) | (F.trim(stratum) == "") | (canonical_index(index) == "")
    return F.when(bad, F.lit(None)).otherwise(F.concat(stratum, F.lit(GROUP_SEPARATOR), canonical_index(index)))


def member_subgroup(name: Column) -> Column:
    """Subgroup part of a member name, null where the name has another form."""
    return F.nullif(F.regexp_extract(name, MEMBER_NAME, 1), F.lit(""))


def member_index(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, MEMBER_NAME, 2), F.lit(""))


def normal_subgroup(name: Column) -> Column:
    """Base name without directory, ``_roi_N.png``, ``.svs`` and the prefix ``SMC_``."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    base = F.regexp_replace(base, r"(?i)_roi_[0-9]+\.png$", "")
    base = F.regexp_replace(base, r"(?i)\.svs$", "")
    return F.regexp_replace(base, r"^SMC_", "")


def safe_name(value: Column) -> Column:
    """Runs of characters outside ``0-9A-Za-z_.-`` become one underscore."""
    return F.regexp_replace(value, r"[^0-9A-Za-z_.-]+", "_")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value as C and Python do (0.5515 is a little less than that).

    Between two neighbours it is compared with the double nearest to their middle; where it is that
    double, the middle's own side of it follows from an exact product (split factors), and a true tie goes to the even one.
    """
    unit = 10**digits
    y = F.abs(x.cast("double"))
    below = F.floor(y * F.lit(float(unit)))
    odd = (2 * below + 1).cast("double")
    middle = odd / F.lit(2.0 * unit)
    high = middle * F.lit(134217729.0) - (middle * F.lit(134217729.0) - middle)
    off = (high * F.lit(2.0 * unit) - odd) + (middle - high) * F.lit(2.0 * unit)
    up = (y > middle) | ((y == middle) & ((off > 0) | ((off == 0) & (below % 2 == 1))))
    n = (below + up.cast("long")).cast("long")
    whole = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / F.lit(unit)).cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((n % unit).cast("string"), digits, "0")) if digits else whole


def mean_sd_cell(mean: Column, sd: Column, digits: int = 3) -> Column:
    """``0.700 ± 0.079``; null where a part is null or not finite."""
    finite = mean.isNotNull() & sd.isNotNull() & ~F.isnan(mean) & ~F.isnan(sd) & (F.abs(mean) < F.lit(float("inf"))) & (F.abs(sd) < F.lit(float("inf")))
    return F.when(finite, F.concat(fixed(mean, digits), F.lit(" ± "), fixed(sd, digits)))


def interval_cell(low: Column, high: Column, digits: int = 3) -> Column:
    """``0.600–0.800``; null unless 0 <= low <= high <= 1."""
    return F.when((low >= 0) & (low <= high) & (high <= 1), F.concat(fixed(low, digits), F.lit("–"), fixed(high, digits)))


def hash32(*parts) -> Column:
    """A number below 2^32 from the MD5 of the parts joined by ``|``; the same in any engine with MD5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
