"""States of audit units: one pass that answers every rule on folds.

A unit is a column whose values must keep to folds (samples, groups, subgroups, labels).  Each row is dealt to all its
units; the state of a value is how many rows it has in each fold and outside all folds, and states of two parts add up,
so they are combined before the shuffle.  All rules, and the summary of the folds, are sums over these states.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_states(samples: DataFrame, units: list[str], n_folds: int) -> DataFrame:
    """``unit, key``, ``in_fold`` (rows in each fold), ``outside`` (rows in no fold), ``alien_folds`` (other fold numbers: 0, 1, or 2 for more)."""
    dealt = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("string").alias("key")) for u in units]))
    inside = F.coalesce(F.col("fold").between(0, n_folds - 1), F.lit(False))
    alien = F.when(~inside, F.col("fold"))
    return samples.select("fold", dealt.alias("u")).groupBy("u.unit", "u.key").agg(
        F.array(*[F.sum((F.col("fold").eqNullSafe(F.lit(f))).cast("long")) for f in range(n_folds)]).alias("in_fold"),
        F.sum((~inside).cast("long")).alias("outside"),
        (F.max(alien).isNotNull().cast("int") + F.coalesce((F.min(alien) != F.max(alien)).cast("int"), F.lit(0))).alias("alien_folds"))


def unit_totals(states: DataFrame, n_folds: int) -> DataFrame:
    """One row ``totals``, a map from unit to its sums over all values: ``keys``, ``repeats`` (rows beyond the first of a value),
    ``spread`` (values in more than one fold), ``lacking`` (folds that values lack; a null value lacks all), ``outside``, and by fold ``rows_in`` and ``keys_in``.
    """
    folds_of = F.aggregate("in_fold", F.lit(0), lambda s, n: s + (n > 0).cast("int"))
    rows = F.aggregate("in_fold", F.col("outside"), lambda s, n: s + n)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    per = states.groupBy("unit").agg(
        F.count("key").alias("keys"), total(rows - 1).alias("repeats"), total(folds_of + F.col("alien_folds") > 1).alias("spread"),
        total(F.when(F.col("key").isNull(), n_folds).otherwise(n_folds - folds_of)).alias("lacking"), total(F.col("outside")).alias("outside"),
        F.array(*[total(F.col("in_fold")[f]) for f in range(n_folds)]).alias("rows_in"),
        F.array(*[total((F.col("in_fold")[f] > 0) & F.col("key").isNotNull()) for f in range(n_folds)]).alias("keys_in"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("unit", F.struct(*per.columns[1:])))).alias("totals"))  # a row for each unit


def total_of(unit: str, name: str) -> Column:
    """A sum of one unit from ``unit_totals``; 0 where there was no row."""
    return F.coalesce(F.try_element_at("totals", F.lit(unit))[name], F.lit(0))


def check_rows(one: DataFrame, failures: dict[str, Column], blocking: bool = True) -> DataFrame:
    """Check rows from one row of sums: for each name how many failures it counts."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(bad.cast("long"), F.lit(0)).alias("bad")) for n, bad in failures.items()]))
    return one.select(rows.alias("c")).select(
        "c.name", F.when(F.col("c.bad") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(F.col("c.bad").cast("string"), F.lit(" violations")).alias("detail"), F.lit(blocking).alias("blocking"))


def fold_rows(totals: DataFrame, names: dict[str, str], n_folds: int) -> DataFrame:
    """Fold summary from ``unit_totals``: ``fold, n_samples`` and, by name, the distinct values of units; folds without rows are left out."""
    at = lambda unit, what, f: F.try_element_at("totals", F.lit(unit))[what][f]
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), at("sample", "rows_in", f).alias("n_samples"), *[at(u, "keys_in", f).alias(n) for n, u in names.items()]) for f in range(n_folds)]))
    return totals.select(one.alias("r")).select("r.*").where("n_samples > 0")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
