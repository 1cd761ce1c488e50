"""Manifest of samples from metadata and a listing of their files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_index, member_index, member_subgroup, scoped_group
from . import checks

# Columns that metadata must have.
REQUIRED = ("slide_name", "patient_idx", "roi_idx", "diagnosis_raw", "diagnosis", "differentiation", "growth_pattern", "top_left_x", "top_left_y",
            "top_right_x", "top_right_y", "bottom_left_x", "bottom_left_y", "bottom_right_x", "bottom_right_y")


def derive(metadata: DataFrame) -> DataFrame:
    """Metadata (strings) with ids derived: group, subgroup, index, file name and sample id.

    Extra columns pass through.  Values that cannot be derived are null; ``identity_checks`` finds them.
    """
    index = canonical_index(F.col("roi_idx"))
    sub = member_subgroup(F.col("slide_name"))
    same = member_index(F.col("slide_name")) == index
    return metadata.withColumns({
        "grp": scoped_group(F.col("diagnosis"), F.col("patient_idx")), "subgroup": F.when(same, sub),
        "member": index, "stratum": F.col("diagnosis"),
        "file_name": F.when(same, F.concat(sub, F.lit("_roi_"), index, F.lit(".png"))),
        "sample": F.when(same, F.concat_ws("::", scoped_group(F.col("diagnosis"), F.col("patient_idx")), F.concat(sub, F.lit("_roi_"), index)))})


def identity_checks(manifest: DataFrame) -> DataFrame:
    """Every derived id equals its derivation from the raw columns, path base names included; keys are unique; group fixes stratum."""
    fresh = derive(manifest.drop("grp", "subgroup", "member", "stratum", "file_name", "sample"))
    keep = ["slide_name", *[F.col(c).alias(f"new_{c}") for c in ("grp", "subgroup", "file_name", "sample")]]
    both = manifest.join(fresh.select(*keep), "slide_name", "left")
    same = F.col("grp").eqNullSafe(F.col("new_grp")) & F.col("subgroup").eqNullSafe(F.col("new_subgroup")) & F.col("sample").eqNullSafe(F.col("new_sample"))
    if "path" in manifest.columns:
        same = same & (F.regexp_extract("path", r"([^/\\]*)$", 1) == F.col("new_file_name"))
    return checks.union_checks(
        checks.required_columns(manifest, ["grp", "subgroup", "sample", "stratum"], "ids derived"),
        checks.unique_key(manifest, ["sample"], "unique samples"), checks.unique_key(manifest, ["slide_name"], "unique names"),
        checks.row_rule(both, same, "ids equal their derivation"),
        checks.functional_dependency(manifest, ["grp"], "stratum", "group fixes stratum"))


def match_files(manifest: DataFrame, files: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with the path of their file, and checks of both directions; ``files``: ``path, file_name``.

    Without ``strict`` files that no row names are allowed.
    """
    missing = manifest.join(files, "file_name", "left_anti")
    extra = files.join(manifest.select("file_name"), "file_name", "left_anti")
    gate = checks.union_checks(
        checks.unique_key(files, ["file_name"], "unique file names"),
        checks.check_row(missing, "a file for every row", F.count("*")),
        checks.check_row(extra, "a row for every file", F.count("*"), blocking=strict))
    return manifest.join(files.select("file_name", "path"), "file_name"), gate


def build(metadata: DataFrame, files: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Manifest and the check rows that gate it."""
    first = checks.required_columns(metadata, list(REQUIRED))
    rows, gate = match_files(derive(metadata), files, strict)
    return rows, checks.union_checks(first, gate, identity_checks(rows))


def import_old_split(manifest: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bring an old split (``diagnosis, patient_idx, wsi, roi_idx, split`` and shared columns) onto the manifest's samples.

    Keys are normalised on both sides and joined full outer; the check row counts rows without
    partner, keys that are not one to one and columns that differ.
    """
    from .align import mismatch_counts, natural_key

    left = manifest.select("sample", *natural_key(F.col("diagnosis"), F.col("patient_idx"), F.col("subgroup"), F.col("member")), "differentiation", "growth_pattern")
    right = old.select("split", *natural_key(F.col("diagnosis"), F.col("patient_idx"), F.col("wsi"), F.col("roi_idx")), "differentiation", "growth_pattern")
    keys = ["k_stratum", "k_index", "k_subgroup", "k_member"]
    counts = mismatch_counts(left, right, keys, ["differentiation", "growth_pattern"])
    wrong = F.sum(F.col("left_only") + F.col("right_only") + F.col("differs_differentiation") + F.col("differs_growth_pattern"))
    gate = checks.union_checks(checks.unique_key(left, keys, "unique manifest keys"), checks.unique_key(right, keys, "unique old keys"),
                               checks.check_row(counts, "old split matches the manifest", wrong))
    return left.join(right.select(*keys, "split"), keys).select("sample", "split"), gate
