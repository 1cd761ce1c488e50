"""Evaluation of out-of-fold predictions.

Predictions are rows ``<system columns>, seed, sample, grp, y_true, y_pred`` with labels as
strings; the class universe is an explicit table ``label`` (per task, where tasks are a column).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import safe_divide
from ..functions.vectors import argmax
from ..sources.shared import materialise
from . import checks


def class_index(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``label, class_id``: classes numbered from 0 in order (within ``by``)."""
    w = Window.partitionBy(*by).orderBy("label")
    return labels.select(*by, "label").distinct().withColumn("class_id", (F.row_number().over(w) - 1).cast("int"))


def encode_labels(rows: DataFrame, index: DataFrame, column: str, out: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Class id of a label; unknown labels get null and can be found with ``unknown_labels``."""
    return rows.join(index.select(*by, F.col("label").alias(column), F.col("class_id").alias(out)), [*by, column], "left")


def unknown_labels(rows: DataFrame, index: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return rows.join(index.select(*by, F.col("label").alias(column)), [*by, column], "left_anti")


def _known(samples: DataFrame) -> DataFrame:
    """The distinct samples, as the hashed side of a join: rows, of which there are many for each, are then neither sorted nor shuffled again if dealt by ``sample``."""
    return samples.select("sample").distinct().hint("shuffle_hash")


def coverage(rows: DataFrame, samples: DataFrame, keys: list[str], rules: dict[str, tuple] = {}) -> DataFrame:  # noqa: B006
    """Per key: ``found`` (distinct known samples), ``repeated`` (samples with more than one row), ``alien`` (rows of unknown samples) and ``wanted``.

    ``rules``: more columns, made in the same pass: how those of samples become one, and the aggregate over the rows of a sample.
    """
    per = rows.groupBy(*keys, "sample").agg(F.count("*").alias("n"), *[c.alias(name) for name, (_, c) in rules.items()])
    per = per.join(_known(samples).withColumn("known", F.lit(1)), "sample", "left")
    each = per.groupBy(*keys).agg(F.count("known").alias("found"), F.sum((F.col("n") > 1).cast("long")).alias("repeated"),
                                  F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("alien"), *[f(name).alias(name) for name, (f, _) in rules.items()])
    return each.join(F.broadcast(samples.agg(F.countDistinct("sample").alias("wanted"))))  # one row


def probability_coverage(rows: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """``coverage`` with the rows of each key that break a rule for probabilities, and their least and greatest number of classes.

    One pass over ``rows``, of which a row for each key is left.
    """
    p = F.col("probs")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    # What lies outside 0..1 is looked for in vain, with the answer null if an entry is null; NaN counts as the greatest.
    whole = F.array_contains(p, F.lit(2.0)).isNotNull()
    fine = F.when(F.size(p) == 0, True).otherwise(whole & (F.array_min(p) >= -1e-6) & (F.array_max(p) <= 1 + 1e-6))
    broken = lambda holds: F.sum((~F.coalesce(holds, F.lit(False))).cast("long"))
    width = F.when(p.isNotNull(), F.size(p))
    return coverage(rows, samples, keys, {"out_of_range": (F.sum, broken(fine)), "off_one": (F.sum, broken(F.abs(total - 1) <= 1e-5)), "narrowest": (F.min, F.min(width)), "widest": (F.max, F.max(width))})


def probability_checks(rows: DataFrame, samples: DataFrame, keys: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Rules for fold probabilities ``keys..., sample, probs``: each sample once per key, in range, sums of one, one width.

    ``cells``: their ``probability_coverage``, if it has been written.
    """
    cells = probability_coverage(rows, samples, keys) if cells is None else cells
    bad = {"each sample once per system and seed": F.sum(F.col("wanted") - F.col("found") + F.col("repeated") + F.col("alien")),
           "probabilities in range": F.sum("out_of_range"), "probabilities sum to one": F.sum("off_one"),
           "one class count": F.sum((F.col("narrowest") < F.col("widest")).cast("long"))}
    one = cells.agg(*[F.coalesce(c.cast("long"), F.lit(0)).alias(str(i)) for i, c in enumerate(bad.values())])
    each = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(str(i)).alias("bad")) for i, name in enumerate(bad)])).alias("c")).select("c.*")
    return checks.told(each)


def assemble(rows: DataFrame, samples: DataFrame, keys: list[str], cells: DataFrame | None = None) -> DataFrame:
    """One row per key and sample with the predicted class of its held-out fold; samples without a prediction get a row of nulls.

    Rows of unknown samples are left out (``probability_checks`` counts them).  Each sample meets the keys it was seen with once; only what it lacks becomes rows.
    ``cells``: the ``coverage`` of rows and samples, if it has been written; if no key falls short, nothing is looked for.
    """
    known = _known(samples)
    got = rows.select(*keys, "sample", "fold", argmax(F.col("probs")).alias("class_id"), F.array_max("probs").alias("top_prob")).join(known, "sample", "left_semi")
    order = [*keys, "sample", "fold", "class_id", "top_prob"]
    lacking = (coverage(rows, samples, keys) if cells is None else cells).where("found < wanted")
    if cells is not None and lacking.isEmpty():
        return got.select(*order)
    key = F.struct(*keys)
    short = lacking.agg(F.collect_list(key).alias("_short"))  # one row: the systems and seeds that fall short
    seen = rows.groupBy("sample").agg(F.collect_set(key).alias("_seen"))
    none = F.array().cast(short.schema["_short"].dataType)
    lost = samples.select("sample").distinct().join(seen, "sample", "left").join(F.broadcast(short)).select("sample", F.explode(F.array_except("_short", F.coalesce("_seen", none))).alias("_k")).select("sample", "_k.*")
    nothing = [F.lit(None).cast(got.schema[c].dataType).alias(c) for c in order[-3:]]
    return got.select(*order).unionByName(lost.select(*keys, "sample", *nothing))


def cells_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., true_id, pred_id, n``: the one aggregate of all rows, from which confusions, class counts and metrics follow."""
    return rows.groupBy(*keys, "true_id", "pred_id").agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, classes: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Long confusion matrix over the whole class universe: ``keys..., true_id, pred_id, n, share`` with zero cells.

    ``share`` is the count in parts of its row, 0 in an empty row.
    """
    # The empty cells of every key that occurs are added with count 0, so the matrix is one sum over few rows.
    counts = cells_of(rows, keys)
    ids = F.broadcast(classes.select(*by, "class_id"))
    pairs = ids.withColumnRenamed("class_id", "true_id").join(ids.withColumnRenamed("class_id", "pred_id"), by) if by else \
        ids.withColumnRenamed("class_id", "true_id").crossJoin(ids.withColumnRenamed("class_id", "pred_id"))
    grid = counts.select(*keys).distinct()
    grid = grid.join(F.broadcast(pairs), by) if by else grid.crossJoin(F.broadcast(pairs))
    order = [*keys, "true_id", "pred_id"]
    full = counts.unionByName(grid.withColumn("n", F.lit(0).cast("long")).select(*order, "n")).groupBy(*order).agg(F.sum("n").alias("n"))
    row = F.sum("n").over(Window.partitionBy(*keys, "true_id"))
    return full.withColumn("share", safe_divide(F.col("n"), row))


def class_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., class_id, tp, actual, predicted``: all that the metrics need, from the cells of the confusion."""
    n, none = F.col("n"), F.lit(0).cast("long")
    side = F.explode(F.array(
        F.struct(F.col("true_id").alias("class_id"), F.when(F.col("true_id") == F.col("pred_id"), n).otherwise(none).alias("tp"), n.alias("actual"), none.alias("predicted")),
        F.struct(F.col("pred_id").alias("class_id"), none.alias("tp"), none.alias("actual"), n.alias("predicted"))))
    return cells_of(rows, keys).select(*keys, side.alias("s")).groupBy(*keys, "s.class_id").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))


def counts_by_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same as ``class_counts`` by one aggregate, where ``keys`` leave few rows for a cell, as groups do."""
    hit, sides = F.col("true_id") == F.col("pred_id"), ("tp", "actual", "predicted")
    one = lambda c, *n: F.struct(F.col(c).alias("class_id"), *[F.lit(x).cast("long").alias(s) for s, x in zip(sides, n)])
    cells = F.explode(F.when(hit, F.array(one("true_id", 1, 1, 1))).otherwise(F.array(one("true_id", 0, 1, 0), one("pred_id", 0, 0, 1))))
    return rows.select(*keys, cells.alias("s")).groupBy(*keys, "s.class_id").agg(*[F.sum(f"s.{c}").alias(c) for c in sides])


def over_universe(counts: DataFrame, classes: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """``counts`` with a row of zeros for every class of the universe that a key lacks."""
    ids = F.broadcast(classes.select(*by, "class_id"))
    grid = counts.select(*keys).distinct()
    grid = grid.join(ids, by) if by else grid.crossJoin(ids)
    zeros = grid.select(*keys, "class_id", *[F.lit(0).cast("long").alias(c) for c in columns])
    return counts.select(*keys, "class_id", *columns).unionByName(zeros).groupBy(*keys, "class_id").agg(*[F.sum(c).alias(c) for c in columns])


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from ``tp, actual, predicted``; 0/0 is 0."""
    return counts.withColumns({
        "precision": safe_divide(F.col("tp"), F.col("predicted")), "recall": safe_divide(F.col("tp"), F.col("actual")),
        "f1": safe_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted"))})


def per_class(rows: DataFrame, classes: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Precision, recall, F1, support and group support of every class of the universe."""
    counts = counts_by_row(rows, [*keys, "grp"])  # a class's groups are those with a row of it
    counts = counts.withColumn("group_support", (F.col("actual") > 0).cast("long"))
    full = over_universe(counts, classes, keys, by, ["tp", "actual", "predicted", "group_support"])
    return rates(full).select(*dict.fromkeys([*keys, *by]), "class_id", "precision", "recall", "f1", F.col("actual").alias("support"), "group_support")


def metrics_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro-F1 and weighted F1 from counts of every class of the universe."""
    return rates(counts).groupBy(*keys).agg(
        safe_divide(F.sum("tp"), F.sum("actual")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        safe_divide(F.sum(F.col("f1") * F.col("actual")), F.sum("actual")).alias("weighted_f1"), F.sum("actual").cast("long").alias("n_samples"))


def system_metrics(rows: DataFrame, classes: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    return metrics_of_counts(over_universe(class_counts(rows, keys), classes, keys, by, ["tp", "actual", "predicted"]), keys)


METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def unpivot(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    cells = ", ".join(f"'{m}', {m}" for m in metrics)
    return rows.select(*keys, F.expr(f"stack({len(metrics)}, {cells}) as (metric, value)"))


def seed_summary(metrics: DataFrame, system: list[str]) -> DataFrame:
    """Mean and sample SD over seeds of each metric; the SD of one seed is 0."""
    return unpivot(metrics, [*system, "seed"]).groupBy(*system, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.countDistinct("seed").alias("n_seeds"))


def per_class_summary(per_class_rows: DataFrame, system: list[str]) -> DataFrame:
    """Mean and SD over seeds of each class's rates (the SD of one seed is null, as in group SDs), supports and seeds."""
    return per_class_rows.groupBy(*system, "class_id").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        F.max("support").alias("support"), F.max("group_support").alias("group_support"), F.countDistinct("seed").alias("n_seeds"))


def confusion_over_seeds(confusions: DataFrame, system: list[str]) -> DataFrame:
    return confusions.groupBy(*system, "true_id", "pred_id").agg(
        F.avg("share").alias("mean_share"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("sd_share"), F.sum("n").alias("n"))


def evaluate_probabilities(rows: DataFrame, samples: DataFrame, classes: DataFrame, system: list[str]) -> dict[str, DataFrame]:
    """From stored fold probabilities to all tables: predictions, confusions, per-class and system metrics, seed summaries.

    ``samples``: ``sample, grp, true_id``.  Checks are returned beside the tables; nothing is trained again.  One pass over ``rows`` makes
    all checks, another each table; rows dealt by ``sample`` are not shuffled.
    """
    keys = [*system, "seed"]
    cells = materialise(probability_coverage(rows, samples, keys), "coverage")  # a row for each key
    done = assemble(rows, samples, keys, cells).join(samples.hint("shuffle_hash"), "sample").withColumnRenamed("class_id", "pred_id")
    cm = confusion(done, classes, keys)
    pc, sm = per_class(done, classes, keys), system_metrics(done, classes, keys)
    return {"checks": probability_checks(rows, samples, keys, cells), "predictions": done, "confusion": cm, "per_class": pc, "metrics": sm,
            "by_fold": system_metrics(done, classes, [*keys, "fold"]), "seed_summary": seed_summary(sm, system),
            "per_class_summary": per_class_summary(pc, system), "confusion_summary": confusion_over_seeds(cm, system)}
