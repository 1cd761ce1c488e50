"""Data-quality rules.  Each gives check rows: ``name, status, detail, blocking``."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "name string, status string, detail string, blocking boolean"


def check_row(df: DataFrame, name: str, failures: Column, blocking: bool = True) -> DataFrame:
    """One row from an aggregate that counts failures: PASS at 0 (or on no rows), else FAIL."""
    bad = F.coalesce(failures.cast("long"), F.lit(0))
    return told(df.agg(bad.alias("bad")).withColumn("name", F.lit(name)), blocking)


def told(failures: DataFrame, blocking: bool = True) -> DataFrame:
    """Check rows from ``name`` and ``bad``, a number of failures."""
    return failures.select(
        "name", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(F.col("bad").cast("string"), F.lit(" violations")).alias("detail"), F.lit(blocking).alias("blocking"))


def required_columns(df: DataFrame, columns: list[str], name: str = "required_columns") -> DataFrame:
    """Columns must exist and hold no nulls, and there must be rows."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(name, "FAIL", f"missing: {', '.join(missing)}", True)], CHECK)
    nulls = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)) for c in columns])
    return check_row(df, name, nulls + F.when(F.count("*") == 0, 1).otherwise(0))


def unique_key(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Number of rows beyond the first of each key."""
    return check_row(df.groupBy(*columns).agg(F.count("*").alias("n")), name, F.sum(F.col("n") - 1))


def row_rule(df: DataFrame, holds: Column, name: str, blocking: bool = True) -> DataFrame:
    """Rows for which ``holds`` is false or null."""
    return check_row(df, name, F.sum((~F.coalesce(holds, F.lit(False))).cast("long")), blocking)


def functional_dependency(df: DataFrame, left: list[str], right: str, name: str) -> DataFrame:
    """Keys with more than one value of ``right``."""
    per = df.groupBy(*left).agg((F.countDistinct(right) + F.max(F.col(right).isNull().cast("int"))).alias("n"))
    return check_row(per, name, F.sum((F.col("n") > 1).cast("long")))


def within_one(df: DataFrame, unit: str, container: str, name: str) -> DataFrame:
    """Units that lie in more than one container (leakage)."""
    per = df.groupBy(unit).agg(F.countDistinct(container).alias("n"))
    return check_row(per, name, F.sum((F.col("n") > 1).cast("long")))


def same_sets(left: DataFrame, right: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Keys on one side alone."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return check_row(a.exceptAll(b).unionAll(b.exceptAll(a)), name, F.count("*"))


def expect_counts(counts: DataFrame, expected: dict[str, int], name: str) -> DataFrame:
    """A one-row table of counts against expected numbers."""
    wrong = reduce(lambda a, b: a + b, [F.sum((~F.col(c).eqNullSafe(F.lit(v))).cast("long")) for c, v in expected.items()])
    return check_row(counts, name, wrong)


def complete_grid(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, extra and repeated cells: ``keys..., problem, n``; no rows if the grid is complete."""
    want, have = expected.select(*keys).distinct(), rows.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = want.join(have, keys, "left_anti").withColumn("n", F.lit(0).cast("long")).withColumn("problem", F.lit("missing"))
    extra = have.join(want, keys, "left_anti").withColumn("problem", F.lit("extra"))
    twice = have.where("n > 1").withColumn("problem", F.lit("repeated"))
    order = [*keys, "problem", "n"]
    return missing.select(*order).unionByName(extra.select(*order)).unionByName(twice.select(*order))


def union_checks(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def roll_up(checks: DataFrame) -> DataFrame:
    """READY if and only if no blocking row is anything but PASS (a deferred one blocks too)."""
    blocked = F.sum((F.col("blocking") & (F.col("status") != "PASS")).cast("long"))
    return checks.agg(
        F.count("*").alias("n_checks"), F.coalesce(F.sum((F.col("status") == "PASS").cast("long")), F.lit(0)).alias("n_pass"),
        F.coalesce(blocked, F.lit(0)).alias("n_blocking"),
        F.when(F.coalesce(blocked, F.lit(0)) == 0, "READY").otherwise("BLOCKED").alias("verdict"))


def require(checks: DataFrame) -> None:
    """Raise with the failed names if a blocking check did not pass (at most twenty are told)."""
    bad = checks.where(F.col("blocking") & (F.col("status") != "PASS")).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['status']} ({r['detail']})" for r in bad))
