"""Audits of whole artefacts: cohort contracts, stored splits and result sets.

The rules of an audit are sums over the same rows, so they are taken together: a pass over each table, then check rows
from one row of sums.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import checks, evaluate, folds, units


def cohort_contract(samples: DataFrame, tasks: list[str], expected: dict[str, int], columns: list[str], files: DataFrame | None = None,
                    published: DataFrame | None = None) -> DataFrame:
    """Columns, counts and, where files are given, their names and sizes against what was published.

    ``expected``: numbers under the names of ``folds.cohort_summary``.  Missing columns are told at once, without reading the table.
    """
    missing = [c for c in columns if c not in samples.columns]
    if missing:
        first = checks.required_columns(samples, columns)
    else:
        source = {"n_subgroups": "subgroup", "n_groups": "grp", **{f"n_{t}": t for t in tasks}}
        nulls = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)) for c in columns])
        counts = [(F.count("*") if c == "n_samples" else F.countDistinct(source[c])).alias(c) for c in expected]
        one = samples.agg((nulls + F.when(F.count("*") == 0, 1).otherwise(0)).alias("_bad"), *counts)
        wrong = reduce(lambda a, b: a + b, [(~F.col(c).eqNullSafe(F.lit(n))).cast("int") for c, n in expected.items()], F.lit(0))
        first = units.check_rows(one, {"required_columns": F.col("_bad"), "declared counts": wrong + (F.col("_bad") > 0).cast("int")})
    if files is None or published is None:
        return first
    return first.unionByName(checks.same_sets(files, published, ["file_name", "size_bytes"], "files as published"))


def split_reaudit(samples: DataFrame, stored_summary: DataFrame, tasks: list[str], n_folds: int) -> DataFrame:
    """The leakage audit made anew, and the stored fold summary against the recomputed one."""
    totals = materialise(folds.audit_totals(samples, tasks, n_folds), "audit-totals")
    fresh = units.fold_rows(totals, {"n_groups": "grp", "n_subgroups": "subgroup", **{f"n_{t}": t for t in tasks}}, n_folds)
    return folds.leakage_audit(samples, tasks, n_folds, totals=totals).unionByName(
        checks.same_sets(fresh, stored_summary, fresh.columns, "stored summary is the recomputed one"))


def result_contract(rows: DataFrame, samples: DataFrame, system: list[str], seeds: list[int], n_folds: int, stored_metrics: DataFrame,
                    classes: DataFrame, by: list[str]) -> DataFrame:
    """Every system has every seed, every seed every fold, every sample is predicted once, and stored metrics follow from the rows.

    ``rows``: predictions with ``fold``; ``stored_metrics``: as ``evaluate.system_metrics`` gives them, compared to 9 places.
    The rows are read four times: by system, seed and sample, by sample alone, for folds out of range, and for the metrics; dealt by
    sample, they are not shuffled.
    """
    keys = [*system, "seed"]
    alien = ~F.coalesce(F.col("fold").between(0, n_folds - 1), F.lit(False))
    known = samples.select("sample").distinct().withColumn("_known", F.lit(1))
    seen = rows.groupBy("sample").agg(F.count("*").alias("_n")).join(known, "sample", "full_outer").agg(
        F.count("_known").alias("size"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("unknown"))
    once = rows.groupBy(*keys, "sample").agg(F.count("*").alias("n"), *[F.max((F.col("fold") == f).cast("int")).alias(f"f{f}") for f in range(n_folds)])
    others = rows.where(alien).groupBy(*keys).agg(F.countDistinct(F.coalesce(F.col("fold"), F.lit(-1))).alias("_others"))
    runs = once.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.max("n").alias("most"),
                                   reduce(lambda a, b: a + b, [F.coalesce(F.max(f"f{f}"), F.lit(0)) for f in range(n_folds)]).alias("have"))
    pair = F.lit(True)
    for k in keys:
        pair = pair & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    runs = runs.alias("r").join(F.broadcast(others.alias("o")), pair, "left").select("r.*", F.coalesce("_others", F.lit(0)).alias("others"))
    declared = F.col("seed").isin(list(seeds))
    per = runs.join(F.broadcast(seen)).groupBy(*system).agg(  # one row of sums beside a row for each run
        F.max("size").alias("size"), F.max("unknown").alias("unknown"), (F.lit(len(seeds)) - F.sum(declared.cast("int"))).alias("lost"), F.sum((~declared).cast("int")).alias("extra"),
        F.sum(F.when(declared, n_folds - F.col("have") + F.col("others")).otherwise(F.col("have") + F.col("others"))).alias("folds_off"),
        F.sum(((F.col("n_samples") != F.col("size")) | (F.col("most") != 1)).cast("int")).alias("not_once"))
    sums = per.agg(F.sum(F.col("lost") + F.col("extra")).alias("seeds"), F.sum(F.col("folds_off") + n_folds * F.col("lost")).alias("folds"), F.sum("not_once").alias("not_once"))
    cut = lambda d: d.select(*keys, F.struct(*[F.round(m, 9).alias(m) for m in evaluate.METRICS]).alias("m"))
    fresh, stored = cut(evaluate.system_metrics(rows, classes, keys, by)), cut(stored_metrics).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    off = fresh.alias("x").join(stored.alias("y"), same, "full_outer").agg(F.sum(
        F.when(F.col("x.m").isNull() | F.col("y.m").isNull(), 1).when(F.col("x.m") != F.col("y.m"), 2).otherwise(0)).alias("off"))
    one = sums.join(F.broadcast(off)).join(F.broadcast(seen))  # a row each
    return units.check_rows(one, {"every seed of every system": F.col("seeds"), "every fold of every seed": F.col("folds"), "every sample once": F.col("not_once"),
                                  "known samples": F.col("unknown"), "metrics follow from rows": F.col("off")})
