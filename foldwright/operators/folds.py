"""Group tables, stratified group folds, balance, summaries and leakage audits.

Samples are rows with ``sample, subgroup, grp, stratum`` and any task columns.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import checks, units


def cohort_summary(samples: DataFrame, tasks: list[str]) -> DataFrame:
    return samples.agg(
        F.count("*").alias("n_samples"), F.countDistinct("subgroup").alias("n_subgroups"), F.countDistinct("grp").alias("n_groups"),
        *[F.countDistinct(t).alias(f"n_{t}") for t in tasks])


def group_table(samples: DataFrame) -> DataFrame:
    """One row per group: its stratum (the smallest, where the dependency is broken), samples and subgroups."""
    return samples.groupBy("grp").agg(
        F.min("stratum").alias("stratum"), F.count("*").alias("n_samples"), F.countDistinct("subgroup").alias("n_subgroups"))


def numbered(rows: DataFrame, by: list[str], token: Column, tie: str, out: str) -> DataFrame:
    """Add ``out``: position from 0 within ``by`` in the order of ``token`` (a hex digest), then ``tie``.

    Positions are counted inside slices of equal leading digits and shifted by the sizes of the
    slices before, so a large stratum is never ordered in one task.
    """
    x = rows.withColumn("_token", token).withColumn("_slice", F.substring("_token", 1, 3))
    sizes = x.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_slice").orderBy("_token", tie)
    return (x.join(sizes, [*by, "_slice"]).withColumn(out, (F.col("_shift") + F.row_number().over(inside) - 1).cast("long"))
            .drop("_token", "_slice", "_shift"))


def stratified_folds(groups: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """Fold of each group: even within each stratum and even over all.

    Strata, ordered by their smallest group id, follow one another on a line; inside a stratum the
    groups are shuffled by a seeded digest; the place on the line modulo ``n_folds`` is the fold.
    """
    strata = groups.groupBy("stratum").agg(F.count("*").alias("n"), F.min("grp").alias("first"))
    w = Window.orderBy("first", "stratum").rowsBetween(Window.unboundedPreceding, -1)  # over strata, a small table
    strata = strata.withColumn("shift", F.coalesce(F.sum("n").over(w), F.lit(0))).select("stratum", "shift")
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("grp")).cast("binary"))
    placed = numbered(groups, ["stratum"], token, "grp", "pos").join(strata, "stratum")
    return placed.withColumn("fold", F.pmod(F.col("shift") + F.col("pos"), F.lit(n_folds)).cast("int")).select(*groups.columns, "fold")


def apply_folds(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """Samples with the fold of their group; samples of unknown groups keep a null fold (see ``fold_match_checks``)."""
    return samples.join(folds.select("grp", "fold"), "grp", "left")


def fold_match_checks(samples: DataFrame, folds: DataFrame) -> DataFrame:
    return checks.union_checks(checks.unique_key(folds, ["grp"], "one fold per group"),
                               checks.same_sets(samples, folds, ["grp"], "same groups in samples and folds"))


def roles(samples: DataFrame, n_folds: int) -> DataFrame:
    """Each sample once per held-out fold, as ``test`` or ``train``."""
    held = samples.withColumn("held_fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return held.withColumn("role", F.when(F.col("fold") == F.col("held_fold"), "test").otherwise("train"))


def balance_features(samples: DataFrame, tasks: list[str]) -> DataFrame:
    """Long features of each group, with weights: its samples (1), subgroups (0.5), samples per class (1.5) and presence of a class (1).

    Classes a group lacks are 0 and left out.
    """
    size = samples.groupBy("grp").agg(F.count("*").cast("double").alias("samples"), F.countDistinct("subgroup").cast("double").alias("subgroups"))
    size = size.select("grp", F.expr("stack(2, 'samples', samples, 1.0D, 'subgroups', subgroups, 0.5D) as (feature, value, weight)"))
    named = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks]))
    cells = samples.select("grp", named.alias("c")).groupBy("grp", "c.task", "c.label").agg(F.count("*").cast("double").alias("n"))
    name = F.concat_ws(":", F.col("task"), F.col("label"))
    cells = cells.withColumn("name", name).select("grp", F.expr(
        "stack(2, concat('samples:', name), n, 1.5D, concat('present:', name), 1.0D, 1.0D) as (feature, value, weight)"))
    return size.unionByName(cells)


def fold_deviations(features: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """``feature, weight, fold, off, scale``: how far each fold's total is off its target, and the unit it is counted in.

    The target is the part of the feature's sum that the fold has of all groups; the unit is an equal share, at least 1.
    """
    totals = features.join(folds.select("grp", "fold"), "grp").groupBy("feature", "fold").agg(F.sum("value").alias("v"))
    sums = features.groupBy("feature").agg(F.max("weight").alias("weight"), F.sum("value").alias("s"))
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n")).withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each fold
    cells = sums.crossJoin(F.broadcast(sizes.select("fold", "part"))).join(totals, ["feature", "fold"], "left")
    return cells.select("feature", "weight", "fold", (F.coalesce("v", F.lit(0.0)) - F.col("s") * F.col("part")).alias("off"), F.greatest(F.col("s") / n_folds, F.lit(1.0)).alias("scale"))


def fold_cost(features: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """One row ``cost``: weighted squared deviation of fold totals from their targets."""
    off = F.col("off") / F.col("scale")
    return fold_deviations(features, folds, n_folds).agg(F.coalesce(F.sum(F.col("weight") * off * off), F.lit(0.0)).alias("cost"))


PROPOSAL = "a string, b string, fa int, fb int, times long, change double, step int, moved array<double>"


class Balance:
    """Sums of every feature in every fold, what they should be, and the cost of the difference (as ``fold_cost``)."""

    def __init__(self, features: DataFrame, folds: DataFrame, n_folds: int):
        rows = fold_deviations(features, folds, n_folds).collect()  # a row for each feature and fold
        self.names = sorted({r["feature"] for r in rows})
        place = {n: i for i, n in enumerate(self.names)}
        self.off = {f: np.zeros(len(self.names)) for f in sorted({r["fold"] for r in rows})}
        self.unit = np.zeros(len(self.names))
        for r in rows:
            self.off[r["fold"]][place[r["feature"]]] = r["off"]
            self.unit[place[r["feature"]]] = r["weight"] / r["scale"] ** 2

    @classmethod
    def of_vectors(cls, vectors: DataFrame, weights: dict[str, float], folds: DataFrame, n_folds: int) -> "Balance":
        """The same from ``group_vectors``: one pass over the groups."""
        summed = [F.coalesce(F.sum(F.col("values")[i]), F.lit(0.0)).alias(f"v{i}") for i in range(len(weights))]
        rows = vectors.join(folds.select("grp", "fold"), "grp", "left").groupBy("fold").agg(*summed).collect()  # a row for each fold
        totals = {r["fold"]: np.array([r[f"v{i}"] for i in range(len(weights))]) for r in rows}
        sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
        whole, out = sum(totals.values(), np.zeros(len(weights))), cls.__new__(cls)
        out.names, out.unit = list(weights), np.array(list(weights.values())) / np.maximum(whole / n_folds, 1.0) ** 2
        out.off = {f: totals.get(f, np.zeros(len(weights))) - whole * (n / sum(sizes.values())) for f, n in sorted(sizes.items())}
        return out

    def cost(self, moved: dict[int, np.ndarray] | None = None) -> float:
        return float(sum(((x + (moved or {}).get(f, 0.0)) ** 2) @ self.unit for f, x in self.off.items()))


def best_swaps(classes: DataFrame, balance: Balance, rows_per_block: int = 2048, steps: int = 64, shares: int = 1, deal: int | None = None, parts: int | None = None) -> DataFrame:
    """``PROPOSAL``: for each couple of blocks of two folds of a stratum the swaps that lower the cost most, one after another.

    ``classes``: ``stratum, fold, values, class, n``.  The change of a swap is a scalar product of the two classes and terms
    of each alone, so a couple of blocks is one matrix, from which the best swap is taken; the sums of the two folds move by
    it and only the terms of each class alone are made anew for the next, ``steps`` times at most, each class once.
    ``times``: how many groups of the couple to swap at once; ``moved``: what leaves fold ``fa`` for ``fb`` by it.
    ``shares``: each couple of blocks evens out that part of what the sums are off (``change`` is that of the part's cost).
    ``deal``: classes are dealt to blocks by a hash with this seed and a block meets one of every other fold alone, which is
    linear in the classes; null: all couples of blocks meet.  ``parts``: tasks among which couples are dealt, which are few bytes and much work.  No rows of all couples: no swap of two groups of a stratum lowers the cost.
    """
    unit, off = balance.unit, {f: x / shares for f, x in balance.off.items()}
    sizes = classes.groupBy("stratum", "fold").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"))
    if deal is not None:  # as many blocks in every fold of a stratum, so that each has a partner
        sizes = sizes.withColumn("blocks", F.max("blocks").over(Window.partitionBy("stratum")))
    token = F.xxhash64("class") if deal is None else F.xxhash64("class", F.lit(deal))
    dealt = classes.join(F.broadcast(sizes), ["stratum", "fold"]).withColumn("block", F.pmod(token, F.col("blocks")))  # a row for each stratum and fold
    blocks = dealt.groupBy("stratum", "fold", "block").agg(F.array_sort(F.collect_list(F.struct("class", "n", "values"))).alias("rows")).select(
        "stratum", "fold", "block", F.col("rows.class").alias("names"), F.col("rows.n").alias("sizes"), F.flatten("rows.values").alias("values"))
    met = ["stratum"] if deal is None else ["stratum", "block"]
    side = lambda x: blocks.select(*met, *[F.col(c).alias(f"{c}_{x}") for c in ("fold", "names", "sizes", "values")])

    def work(batches):
        for batch in batches:
            for fa, na, ma, va, fb, nb, mb, vb in batch.itertuples(index=False):
                x, y, gap = va.reshape(len(na), -1), vb.reshape(len(nb), -1), off[fb] - off[fa]
                square = 2 * ((x * x) @ unit)[:, None] + 2 * ((y * y) @ unit)[None, :] - 4 * (x * unit) @ y.T
                most, out = np.minimum(ma[:, None], mb[None, :]), []
                for step in range(steps):
                    linear = 2 * (x @ (unit * gap))[:, None] - 2 * (y @ (unit * gap))[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        times = np.where(square > 1e-12, np.round(-linear / (2 * square)), most)
                    times = np.clip(np.nan_to_num(times, nan=1.0), 1, most)
                    change = np.where(linear + square < -1e-12, times * linear + times * times * square, 0.0)
                    i, j = np.unravel_index(int(change.argmin()), change.shape)
                    if change[i, j] >= 0:
                        break
                    t = int(times[i, j])
                    out.append((na[i], nb[j], fa, fb, t, float(change[i, j]), step, t * (x[i] - y[j])))
                    gap = gap + 2 * t * (x[i] - y[j])
                    square[i], square[:, j] = np.inf, np.inf
                yield pd.DataFrame(out, columns=["a", "b", "fa", "fb", "times", "change", "step", "moved"])

    pairs = side("a").join(side("b"), met).where("fold_a < fold_b")
    pairs = pairs.select(*[f"{c}_{x}" for x in "ab" for c in ("fold", "names", "sizes", "values")])
    return (pairs if parts is None else pairs.repartition(parts)).mapInPandas(work, PROPOSAL)


def agreed_swaps(proposals: DataFrame) -> DataFrame:
    """Proposals that are the first (by step, then change) of both their classes, so that each class has one partner at most; the best of all is among them."""
    bid = F.struct("step", "change", "a", "b").alias("bid")
    ends = proposals.select(F.explode(F.array("a", "b")).alias("class"), bid).groupBy("class").agg(F.min("bid").alias("bid"))
    won = ends.groupBy("bid").agg(F.count("*").alias("n")).where("n = 2").select("bid.a", "bid.b")
    return proposals.join(won, ["a", "b"])


def vectors_of(features: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """``groups`` with ``values``, their features in the order of ``names``."""
    wide = features.groupBy("grp").pivot("feature", names).agg(F.sum("value"))
    return groups.join(wide, "grp").select(*groups.columns, F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names]).alias("values"))


def group_vectors(samples: DataFrame, tasks: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """``grp, stratum, n_samples, n_subgroups, values``, a row for each group, written; and the weight of each feature, in the order of ``values``.

    The features are those of ``balance_features``, counted in one pass over samples that are shuffled once.
    """
    labels = samples.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("string").alias("label")) for t in tasks])).alias("c")).select("c.*").distinct()
    cells = sorted(((r["task"], r["label"]) for r in labels.collect()), key=str)  # a row for each class
    counts = [F.count_if(F.col(t).cast("string").eqNullSafe(F.lit(x))).alias(f"_n{i}") for i, (t, x) in enumerate(cells)]
    one = samples.repartition("grp").groupBy("grp").agg(F.min("stratum").alias("stratum"), F.count("*").alias("n_samples"), F.countDistinct("subgroup").alias("n_subgroups"), *counts)
    values, weights = {"samples": F.col("n_samples"), "subgroups": F.col("n_subgroups")}, {"samples": 1.0, "subgroups": 0.5}
    for i, (t, x) in enumerate(cells):
        name = t if x is None else f"{t}:{x}"
        for kind, weight, value in (("samples", 1.5, F.col(f"_n{i}")), ("present", 1.0, (F.col(f"_n{i}") > 0).cast("int"))):
            weights[f"{kind}:{name}"] = weight
            values[f"{kind}:{name}"] = values[f"{kind}:{name}"] + value if f"{kind}:{name}" in values else value
    names = sorted(values)
    rows = one.select("grp", "stratum", "n_samples", "n_subgroups", F.array(*[values[n].cast("double") for n in names]).alias("values"))
    return materialise(rows, "group-vectors"), {n: weights[n] for n in names}


def with_class(placed: DataFrame) -> DataFrame:
    """Groups of one stratum, fold and vector are interchangeable: they make a ``class``."""
    return placed.withColumn("class", F.md5(F.to_json(F.struct("stratum", "fold", "values")).cast("binary")))


def class_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("stratum", "fold", "class").agg(F.first("values").alias("values"), F.count("*").alias("n"))


#: Classes in a block of a pass in which every block meets one of each other fold.
DEALT_BLOCK = 512


def balanced_folds(samples: DataFrame, folds: DataFrame, tasks: list[str], n_folds: int, passes: int = 30, least_gain: float = 1e-12, vectors: tuple[DataFrame, dict[str, float]] | None = None) -> DataFrame:
    """Improve folds by swapping groups of one stratum; sizes of folds, overall and per stratum, stay as they are.

    Each pass finds lists of the swaps of classes of interchangeable groups that lower the cost most, in couples of blocks of two
    folds of a stratum.  These do not know of one another, so of all lists together as many first steps are taken as give the
    lowest cost.  A pass is linear in the classes: they are dealt to blocks anew, each block meets one of every other fold, and
    each couple evens out its share of what the sums are off.  A pass that gains less than half the cost is followed by one of
    an eighth of the shares, at last by whole differences; where no number of steps lowers the cost, the one best
    swap is made alone, which does.  Only if even a gain of 1e-12 is asked for, all couples of blocks meet in the end.  It ends
    when no swap of two groups lowers the cost by more than 1e-12, when a pass of whole differences gained less than ``least_gain`` or
    the cost left is less than that, at the latest after ``passes``.  A pass reads and writes the sizes of classes alone; groups
    are counted into classes once and moved once, in the end.  Classes and swaps stay in Spark; only sums of features by fold and
    step come to the driver.  ``vectors``: the result of ``group_vectors``, where it is there already.
    """
    rows, weights = group_vectors(samples, tasks) if vectors is None else vectors
    balance = Balance.of_vectors(rows, weights, folds, n_folds)
    placed = rows.select("grp", "stratum", "values").join(folds.select("grp", "fold"), "grp")
    before = sizes = _sizes(placed.groupBy("stratum", "fold", "values").agg(F.count("*").alias("n")))
    largest, strata = sizes.groupBy("stratum").count().agg(F.sum(F.ceil(F.col("count") / (n_folds * DEALT_BLOCK))), F.count("*")).first()
    largest = largest or 1
    whole = largest <= strata  # one block for each stratum and fold: all couples meet in every pass
    shares = 1 if whole else int(largest)
    parts = max(folds.sparkSession.sparkContext.defaultParallelism, int(largest) * n_folds * (n_folds - 1) // 128)  # at most 64 couples of blocks in a task of a dealt pass
    for turn in range(passes):
        lists = best_swaps(sizes, balance, parts=parts) if whole else best_swaps(sizes, balance, DEALT_BLOCK, shares=shares, deal=turn, parts=parts)
        swaps = materialise(agreed_swaps(materialise(lists, "fold-proposals")), "fold-swaps")
        ends = F.explode(F.array(F.struct(F.col("fa").alias("fold"), F.lit(-1).alias("sign")), F.struct(F.col("fb").alias("fold"), F.lit(1).alias("sign")))).alias("e")
        sums = swaps.select("step", "moved", ends).select("step", "e.fold", "e.sign", F.posexplode("moved").alias("place", "v"))
        steps: dict[int, dict[int, np.ndarray]] = {}
        for r in sums.groupBy("step", "fold", "place").agg(F.sum(F.col("v") * F.col("sign")).alias("v")).collect():  # steps times folds times features
            steps.setdefault(r["step"], {}).setdefault(r["fold"], np.zeros(len(balance.names)))[r["place"]] = r["v"]
        now, total, best = balance.cost(), {f: np.zeros(len(balance.names)) for f in balance.off}, (np.inf, 0, {})
        for k in sorted(steps):
            for f, v in steps[k].items():
                total[f] = total[f] + v
            best = min(best, (balance.cost(total), k, dict(total)), key=lambda x: x[0])
        after, last, moved = best
        chosen = swaps.where(F.col("step") <= last)
        if after >= now - 1e-12 and steps and shares == 1:
            one = swaps.where("step = 0").orderBy("change", "a", "b").first()
            chosen = swaps.where((F.col("a") == one["a"]) & (F.col("b") == one["b"]))
            moved = {one["fa"]: -np.array(one["moved"]), one["fb"]: np.array(one["moved"])}
        elif after >= now - 1e-12:
            moved = {}
        if moved:
            sides = chosen.select("times", F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("fb").alias("to")), F.struct(F.col("b").alias("class"), F.col("fa").alias("to")))).alias("e")).select("times", "e.*")
            change = sizes.join(sides, "class")
            sizes = _sizes(sizes.select("stratum", "fold", "values", "n").unionByName(change.select("stratum", "fold", "values", (-F.col("times")).alias("n"))).unionByName(
                change.select("stratum", F.col("to").cast("int").alias("fold"), "values", F.col("times").alias("n"))).groupBy("stratum", "fold", "values").agg(F.sum("n").alias("n")).where("n > 0"))
        for f, v in moved.items():
            balance.off[f] = balance.off[f] + v
        if balance.cost() < least_gain and not whole:
            break
        gain = now - balance.cost()
        if shares > 1:
            shares = shares if gain >= now / 2 else -(-shares // 8)
        elif (gain < least_gain or not steps) and (whole or least_gain > 1e-12):
            break
        elif gain < now / 10 and least_gain <= 1e-12:
            whole = True
    if sizes is before:
        return folds.drop("fold").join(placed.select("grp", "fold"), "grp")
    moves = materialise(placed.join(_moves(before, sizes), ["stratum", "fold", "values"]).select("grp", "class", "leave", "first", "ends"), "fold-moves")
    at = F.col("first") + F.col("place")
    going = numbered(moves, ["class"], F.md5(F.col("grp").cast("binary")), "grp", "place").where("place < leave").select(
        "grp", F.element_at(F.filter("ends", lambda e: e["begin"] <= at), -1)["fold"].alias("to"))
    return folds.drop("fold").join(placed.join(going, "grp", "left").select("grp", F.coalesce("to", "fold").cast("int").alias("fold")), "grp")


def _sizes(sizes: DataFrame) -> DataFrame:
    """Written classes: ``stratum, fold, values, n, class``."""
    return materialise(with_class(sizes.withColumn("fold", F.col("fold").cast("int")).withColumn("n", F.col("n").cast("long"))), "fold-classes")


def _moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where groups leave, by classes: ``stratum, fold, values, class, leave, first, ends``.

    ``leave`` groups of the class go, as few as there can be; those of one stratum and vector, counted on from ``first``, go to the fold of the last of ``ends`` that begins at or before them.
    """
    same, w = ["stratum", "values"], Window.partitionBy("stratum", "values").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # a row for each fold
    both = before.select(*same, "fold", (-F.col("n")).alias("n")).unionByName(after.select(*same, "fold", "n")).groupBy(*same, "fold").agg(F.sum("n").alias("n")).where("n <> 0")
    both = both.withColumn("leave", F.greatest(-F.col("n"), F.lit(0))).withColumn("come", F.greatest("n", F.lit(0)))
    both = both.withColumn("first", F.coalesce(F.sum("leave").over(w), F.lit(0))).withColumn("begin", F.coalesce(F.sum("come").over(w), F.lit(0)))
    ends = both.where("come > 0").groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("begin", "fold"))).alias("ends"))
    return with_class(both.where("leave > 0").select(*same, "fold", "leave", "first").join(ends, same))




def class_coverage(samples: DataFrame, task: str, unit: str, n_folds: int) -> DataFrame:
    """Class × fold counts of distinct groups (``unit='grp'``) or of samples; empty cells are 0."""
    rows = samples.select(task, "fold", unit).distinct() if unit == "grp" else samples
    return (rows.groupBy(F.col(task).alias("label")).pivot("fold", list(range(n_folds))).count()
            .na.fill(0, [str(i) for i in range(n_folds)])
            .select("label", *[F.col(str(i)).cast("long").alias(f"fold_{i}") for i in range(n_folds)]))


def fold_summary(samples: DataFrame, tasks: list[str]) -> DataFrame:
    return samples.groupBy("fold").agg(
        F.countDistinct("grp").alias("n_groups"), F.countDistinct("subgroup").alias("n_subgroups"), F.count("*").alias("n_samples"),
        *[F.countDistinct(t).alias(f"n_{t}") for t in tasks])


def named_split_summary(samples: DataFrame, split: str) -> DataFrame:
    """Size of each named split and its share of all groups, in percent."""
    per = samples.groupBy(split).agg(F.countDistinct("grp").alias("n_groups"), F.countDistinct("subgroup").alias("n_subgroups"), F.count("*").alias("n_samples"))
    return per.withColumn("group_percent", F.round(100.0 * F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy()), 6))


def fold_table_checks(folds: DataFrame, n_folds: int) -> DataFrame:
    """Unique groups, exactly the folds expected, every stratum in every fold."""
    grid = folds.select("stratum").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return checks.union_checks(
        checks.unique_key(folds, ["grp"], "unique groups"),
        checks.row_rule(folds, F.col("fold").between(0, n_folds - 1), "fold numbers"),
        checks.check_row(grid.join(folds, ["stratum", "fold"], "left_anti"), "every stratum in every fold", F.count("*")))


def audit_totals(samples: DataFrame, tasks: list[str], n_folds: int) -> DataFrame:
    """The sums that every rule of ``leakage_audit`` and the fold summary follow from, one row, by one pass over ``samples``."""
    return units.unit_totals(units.unit_states(samples, ["sample", "grp", "subgroup", *tasks], n_folds), n_folds)


def leakage_audit(samples: DataFrame, tasks: list[str], n_folds: int, expected: dict[int, dict[str, int]] | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Check rows: no group or subgroup in two folds, unique samples, fold ids, class coverage, declared counts.

    ``expected``: numbers of each fold under ``n_samples``, ``n_groups`` or ``n_subgroups``.  ``totals``: those of ``audit_totals``, if they are there already.
    """
    of, failures = units.total_of, {}
    failures["unique samples"] = of("sample", "repeats")
    failures["groups in one fold"], failures["subgroups in one fold"] = of("grp", "spread"), of("subgroup", "spread")
    failures["fold numbers"] = of("sample", "outside")
    for t in tasks:
        failures[f"every {t} in every fold"] = of(t, "lacking")
    if expected:
        where = {"n_samples": ("sample", "rows_in"), "n_groups": ("grp", "keys_in"), "n_subgroups": ("subgroup", "keys_in")}
        have = lambda f, c: F.coalesce(F.try_element_at("totals", F.lit(where[c][0]))[where[c][1]][f], F.lit(0)) if 0 <= f < n_folds else F.lit(0)
        wrong = [(~units.every([have(f, c) == F.lit(n) for c, n in counts.items()])).cast("int") for f, counts in expected.items()]
        failures["declared fold counts"] = reduce(lambda x, y: x + y, wrong)
    return units.check_rows(audit_totals(samples, tasks, n_folds) if totals is None else totals, failures)


def training_coverage(samples: DataFrame, task: str, n_folds: int) -> DataFrame:
    """Classes that a training fold lacks: ``held_fold, label``; no rows if all are there."""
    have = roles(samples, n_folds).where("role = 'train'").select("held_fold", F.col(task).alias("label")).distinct()
    want = samples.select(F.col(task).alias("label")).distinct().withColumn("held_fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return want.select("held_fold", "label").join(have, ["held_fold", "label"], "left_anti")
