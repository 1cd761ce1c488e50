"""Completeness-gated summary tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import interval_cell, mean_sd_cell
from . import checks
from . import lineage
from .evaluate import METRICS, confusion_over_seeds, per_class_summary, seed_summary
from .retrieval import over_folds

# Accepted spellings of strategies and their canonical names.
STRATEGY_ALIASES = {
    "center": "center", "centre": "center", "center crop": "center", "grid mean": "grid_mean", "grid_mean": "grid_mean", "mean": "grid_mean",
    "grid max": "grid_max", "grid_max": "grid_max", "max": "grid_max",
}


def canonical(df: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Trim, fold case and replace by the alias table; unknown values stay as they are."""
    table = df.sparkSession.createDataFrame(sorted(aliases.items()), "alias string, canonical string")
    keyed = df.withColumn("_key", F.lower(F.trim(column)))
    return keyed.join(F.broadcast(table), F.col("_key") == F.col("alias"), "left").withColumn(column, F.coalesce("canonical", column)).drop("_key", "alias", "canonical")


def experiment_grid(spark, models: list[str], strategies: list[str], tasks: list[str], select: str = "all") -> DataFrame:
    """Model × strategy × task; ``select``: ``all`` or models by comma list, unknown ones are an error."""
    wanted = models if select.strip().lower() == "all" else [m.strip() for m in select.split(",") if m.strip()]
    unknown = sorted(set(wanted) - set(models))
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return one("model", wanted).crossJoin(one("strategy", strategies)).crossJoin(one("task", tasks))


def input_checks(rows: DataFrame, system: list[str], seeds: list[int], constant: list[str]) -> DataFrame:
    """One protocol, unique (system, seed), exactly the seeds expected, counts positive and constant across seeds, metrics finite and within 0..1, no fold rows."""
    parts = [checks.unique_key(rows, [*system, "seed"], "unique system and seed")]
    if "protocol_id" in rows.columns:
        parts.append(checks.check_row(rows.agg(F.countDistinct("protocol_id").alias("n")), "one protocol", F.sum((F.col("n") != 1).cast("long"))))
    if "fold" in rows.columns:
        parts.append(checks.row_rule(rows, F.col("fold").isNull(), "no fold rows"))
    want = rows.select(*system).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    parts.append(checks.check_row(checks.complete_grid(rows, want, [*system, "seed"]), "every seed of every system", F.count("*")))
    for c in constant:
        parts.append(checks.functional_dependency(rows, system, c, f"constant {c}"))
        parts.append(checks.row_rule(rows, F.col(c) > 0, f"positive {c}"))
    for m in METRICS:
        if m in rows.columns:
            parts.append(checks.row_rule(rows, ~F.isnan(F.col(m)) & F.col(m).between(0, 1), f"{m} within 0 and 1"))
    return checks.union_checks(*parts)


def best_flags(summary: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """``is_best`` by the unrounded value; every tie is flagged."""
    return summary.withColumn("is_best", F.col(value) == F.max(value).over(Window.partitionBy(*by)))


def ordered(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Rows in the declared order of each column; values not declared come last, by name."""
    keys = []
    for c, values in orders.items():
        place = F.lit(len(values))
        for i, v in enumerate(values):
            place = F.when(F.col(c) == v, F.lit(i)).otherwise(place)
        keys += [place, F.col(c)]
    return df.orderBy(*keys)


def with_position(df: DataFrame, orders: dict[str, list[str]], out: str = "position") -> DataFrame:
    """Add each row's place, from 0, in the declared order (``ordered``); for report tables, which are small."""
    keys = []
    for c, values in orders.items():
        keys += [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)), F.lit(0)), F.lit(len(values) + 1)), F.col(c)]
    return df.withColumn(out, F.row_number().over(Window.orderBy(*keys)) - 1)


def first_n(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by id: each task keeps its own first ones, so no task sorts the table."""
    return df.orderBy(*by).limit(n)


def first_failures(df: DataFrame, holds, by: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows, by id, for which ``holds`` is false or null."""
    return first_n(df.where(~F.coalesce(holds, F.lit(False))), by, n)


def summary_cells(metrics: DataFrame, system: list[str], by: list[str], digits: int = 3) -> DataFrame:
    """Per system and metric: mean, SD, cell text and best flag (within ``by`` and metric)."""
    s = best_flags(seed_summary(metrics, system), [*by, "metric"])
    return s.withColumn("cell", mean_sd_cell(F.col("mean"), F.col("sd"), digits))


def wide(cells: DataFrame, rows: list[str], name: str, values: list[str], cell: str = "cell") -> DataFrame:
    """One column for each of ``values``; the list is given, so the pivot needs no job of its own."""
    return cells.groupBy(*rows).pivot(name, values).agg(F.first(cell))


def summary_table(metrics: DataFrame, tasks: list[str], shown: list[str], digits: int = 3) -> DataFrame:
    """A row per (model, strategy), a cell per (task, metric) as ``mean ± sd`` and a flag column for the best."""
    cells = summary_cells(metrics, ["model", "strategy", "task"], ["task"], digits).withColumn("slot", F.concat_ws("_", "task", "metric"))
    slots = [f"{t}_{m}" for t in tasks for m in shown]
    text = wide(cells, ["model", "strategy"], "slot", slots)
    best = wide(cells, ["model", "strategy"], "slot", slots, "is_best").select("model", "strategy", *[F.col(s).alias(f"{s}_best") for s in slots])
    return text.join(best, ["model", "strategy"])


def interval_table(intervals: DataFrame, digits: int = 3) -> DataFrame:
    return intervals.withColumn("cell", interval_cell(F.col("ci_low"), F.col("ci_high"), digits))


def retrieval_table(over_folds: DataFrame, ks: list[int], shown: dict[str, str], rows: list[str], digits: int = 3) -> DataFrame:
    """A cell per metric at k from mean and SD over folds; ``shown``: metric to printed name."""
    cells = over_folds.where(F.col("metric").isin(*shown) & F.col("k").isin(*ks))
    name = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])[F.col("metric")]
    cells = cells.withColumn("slot", F.concat_ws("_at_", name, F.col("k").cast("string"))).withColumn("cell", mean_sd_cell(F.col("mean"), F.col("sd"), digits))
    return wide(cells, rows, "slot", [f"{m}_at_{k}" for m in shown.values() for k in ks])


def estimator_delta(old: DataFrame, new: DataFrame, system: list[str], digits: int = 3) -> DataFrame:
    """Means of two estimators side by side, their difference, and whether the displayed cell changed."""
    a = old.select(*system, "metric", F.col("mean").alias("old_mean"), F.col("sd").alias("old_sd"))
    b = new.select(*system, "metric", F.col("mean").alias("new_mean"), F.col("sd").alias("new_sd"))
    cell = lambda m, s: mean_sd_cell(F.col(m), F.col(s), digits)
    return a.join(b, [*system, "metric"]).withColumn("delta", F.col("new_mean") - F.col("old_mean")).withColumn(
        "cell_changed", cell("old_mean", "old_sd") != cell("new_mean", "new_sd"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("metric").agg(F.count("*").alias("n_cells"), F.sum(F.col("cell_changed").cast("long")).alias("n_changed"),
                                        F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))


def report_bundle(metrics: DataFrame, per_fold: DataFrame, intervals: DataFrame, tasks: list[str], seeds: list[int], per_class: DataFrame | None = None,
                  confusion: DataFrame | None = None, inputs: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All report tables, and the check rows that gate them (``checks.require`` raises on a failure).

    ``per_class`` and ``confusion`` are summarised over seeds.  ``inputs``: file identities that the evaluation and the retrieval consumed; they
    must be the same, and become the provenance table.  An interval without a cell (a bound missing or out of range) fails.
    """
    system = ["model", "strategy", "task"]
    cells = interval_table(intervals)
    parts = [input_checks(metrics, system, seeds, ["n_samples"]), checks.row_rule(cells, F.col("cell").isNotNull(), "intervals have bounds")]
    made = {"summary": summary_table(metrics, tasks, ["balanced_accuracy", "macro_f1"]), "intervals": cells,
            "retrieval": retrieval_table(over_folds(per_fold, ["k"]).withColumn("system", F.lit("all")), [5, 10, 15, 20], {"average_precision": "map"}, ["system"])}
    if per_class is not None:
        made["per_class"] = per_class_summary(per_class, system)
    if confusion is not None:
        made["confusion"] = confusion_over_seeds(confusion, system)
    if inputs is not None:
        parts.append(lineage.same_lineage(*inputs))
        made["provenance"] = lineage.identity_index(inputs[0].unionByName(inputs[1])).select("role", "path", "size_bytes", "sha256")
    return {"checks": checks.union_checks(*parts), **made}
