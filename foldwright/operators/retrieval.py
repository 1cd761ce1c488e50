"""Exact cosine top-K across held-out folds, and retrieval metrics.

Items have ``sample`` (string), ``grp``, ``fold``, ``label`` and ``features`` (array of numbers).
The gallery of a query is every item of another fold and another group.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import safe_divide
from ..functions.vectors import is_valid, unit
from ..sources.shared import materialise
from . import checks

KS = (5, 10, 15, 20)


def input_checks(items: DataFrame, n_folds: int | None = None) -> DataFrame:
    """Rules for items; with ``n_folds``, also that the folds are exactly 0 to ``n_folds`` - 1."""
    every = [] if n_folds is None else [
        checks.row_rule(items, F.col("fold").between(0, n_folds - 1), "fold numbers"),
        checks.check_row(items.agg(F.countDistinct("fold").alias("n")), "every fold", F.sum((F.col("n") != n_folds).cast("long")))]
    return checks.union_checks(
        *every,
        checks.unique_key(items, ["sample"], "unique items"),
        checks.within_one(items, "grp", "fold", "groups in one fold"),
        checks.row_rule(items, is_valid(F.col("features")), "vectors finite and not zero"))


def normalised(items: DataFrame) -> DataFrame:
    """Unit vectors; items whose vector is not valid are left out (``input_checks`` names them)."""
    return items.withColumn("features", unit(F.col("features"))).where(F.col("features").isNotNull())


#: Gallery rows that a task holds at most, and gallery parts there are at least, where there are rows for them.
SHELF, SHELVES = 65_536, 24


def best_on_shelf(x: np.ndarray, x_groups: np.ndarray, y: np.ndarray, y_groups: np.ndarray, rank: np.ndarray, k: int, step: int = 2048, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of the ``k`` best columns of each row, read ``step`` at a time, of which those of the row's group are barred; of ties the first by ``rank``.

    The product is made in single precision and finds what lies no lower than the k-th best so far, less twice the error
    of such a product of unit vectors; that little is computed again one by one in an order of sums that does not depend on
    the block, so the result does not depend on it and equal vectors are equally similar wherever they lie.  ``floor``: a similarity for each row, of which
    nothing lower is asked for.
    """
    off = 2 * (x.shape[1] + 8) * 2.0**-23
    narrow, meet = x.astype(np.float32), bool(np.isin(x_groups, y_groups).any())
    least = np.full(len(x), -2.0) if floor is None else floor
    floor, best = least.copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for j in range(0, len(y), step):
        part = y[j : j + step]
        sim = narrow @ part.T.astype(np.float32)
        if meet:
            sim[x_groups[:, None] == y_groups[j : j + step]] = -np.inf
        low = floor - off
        if (floor <= -2).any() and sim.shape[1] > k:
            low = np.maximum(low, np.maximum(np.partition(sim, sim.shape[1] - k, axis=1)[:, -k].astype(float), -2.0) - off)
        row, col = np.nonzero(sim >= low.astype(np.float32)[:, None])
        value = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[row[i : i + 4096]], part[col[i : i + 4096]]) for i in range(0, len(row), 4096))])
        row, col, value = (np.concatenate([old, new]) for old, new in zip(best, (row, col + j, value)))
        order = np.lexsort((rank[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        best = row[keep], col[keep], value[keep]
        last = place == k - 1
        floor[row[last]] = np.maximum(value[last], least[row[last]])
    keep = best[2] >= least[best[0]]
    return best[0][keep], best[1][keep], best[2][keep]


def on_shelves(rows: DataFrame, shelves: int, k: int) -> DataFrame:
    """``query, gallery, similarity``: of each shelf the ``k`` best of every query.

    ``rows``: ``shelf, query`` (false: a row of the gallery), ``sample, g, features``.  A task holds the gallery rows of a shelf and reads its queries past them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shelf = [], None
        for batch in batches:
            if not len(batch):
                continue
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            first = int(asks.argmax()) if asks.any() else len(batch)
            if first:
                held.append(batch.slice(0, first))
            if first == len(batch):
                continue
            if shelf is None:
                t = pa.Table.from_batches(held) if held else None
                ids = np.zeros(0, object) if t is None else t["sample"].to_numpy()
                order = np.argsort(ids, kind="stable")
                shelf = (ids[order], t["g"].to_numpy()[order], vectors_in(t["features"])[order]) if len(ids) else (ids, None, None)
                held = []
            if not len(shelf[0]):
                continue
            for low in range(first, len(batch), 1024):
                some = batch.slice(low, 1024)
                names = some.column("sample").to_numpy(zero_copy_only=False)
                row, col, value = best_on_shelf(vectors_in(some.column("features")), some.column("g").to_numpy(), shelf[2], shelf[1], np.arange(len(shelf[0])), k)
                yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.string()), pa.array(shelf[0][col], pa.string()), pa.array(value)], names=["query", "gallery", "similarity"])

    dealt = rows.repartitionById(shelves, "shelf").sortWithinPartitions("query")
    return dealt.select("query", "sample", "g", "features").mapInArrow(work, "query string, gallery string, similarity double")


def vectors_in(column) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def exact_topk(queries: DataFrame, gallery: DataFrame, k: int, rows_per_block: int = 2048) -> DataFrame:
    """``query, rank, gallery, similarity``: the k most similar gallery items, ties by id ascending (``pruned_topk`` spares blocks of clustered vectors).

    Items with a vector that is not valid fail the query.  The gallery is dealt by fold onto ``SHELVES`` shelves, more if one
    would hold over ``SHELF`` rows, fewer if they would hold under ``rows_per_block``.  A task holds one and reads all queries
    of other folds past it in blocks, each a matrix product, and the k best of each query leave.  Memory is bounded by a
    shelf; a query is shuffled once for each shelf, of which there are a fixed number up to ``SHELVES`` times ``SHELF`` rows.
    """
    bad = F.raise_error(F.lit("vectors must be finite and not zero")).cast("array<double>")
    q, g = (x.select("sample", F.xxhash64("grp").alias("g"), "fold", F.coalesce(unit(F.col("features")), bad).alias("features")) for x in (queries, gallery))
    sizes = [(r["fold"], r["count"]) for r in gallery.where("fold is not null").groupBy("fold").count().collect()]
    if not sizes:
        return g.select(F.col("sample").alias("query"), F.lit(0).alias("rank"), F.col("sample").alias("gallery"), F.lit(0.0).alias("similarity")).limit(0)
    largest = max(n for _, n in sizes)
    each = max(-(-largest // SHELF), min(-(-largest // rows_per_block), -(-SHELVES // len(sizes))))
    # Shelves are numbered fold by fold; a query is copied with the number of every one of another fold.
    kind = gallery.schema["fold"].dataType
    number = F.lit(None).cast("int")
    for i, (f, _) in enumerate(sizes):
        number = F.when(F.col("fold") == F.lit(f).cast(kind), F.lit(i)).otherwise(number)
    held = g.where("fold is not null").withColumn("shelf", (number * each + F.pmod(F.xxhash64("sample"), F.lit(each))).cast("int"))
    others = F.array(*[F.struct(F.lit(f).cast(kind).alias("f"), F.lit(i * each + j).alias("shelf")) for i, (f, _) in enumerate(sizes) for j in range(each)])
    aimed = q.withColumn("o", F.explode(others)).where("o.f <> fold").withColumn("shelf", F.col("o.shelf"))
    order = lambda x, asks: x.select("shelf", F.lit(asks).alias("query"), "sample", "g", "features")
    return best_of(on_shelves(order(held, False).unionByName(order(aimed, True)), len(sizes) * each, k), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "gallery")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "gallery", "similarity")


#: Room for rounding in the angular bounds of ``pruned_topk``.
ROUNDING = 1e-7


def spread_out(vectors: np.ndarray, m: int) -> np.ndarray:
    """``m`` of some unit vectors, each the farthest from those before it, so that every cluster of them has one."""
    near, at = np.full(len(vectors), -np.inf), [0]
    while len(at) < min(m, len(vectors)):
        near = np.maximum(near, vectors @ vectors[at[-1]])
        at.append(int(near.argmin()))
    return vectors[at]


def balls(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Items with ``ball`` (their nearest pivot) and ``angle`` to it, written; the group as a number ``g``."""
    shared = items.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sim = vectors_in(batch.column("features")) @ shared.value.T
                near = sim.argmax(axis=1)
                angle = np.arccos(np.clip(sim[np.arange(len(near)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "ball", "angle"])

    rows = items.select("sample", F.xxhash64("grp").alias("g"), "fold", "features")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns) + ", ball int, angle double"
    return materialise(rows.mapInArrow(place, schema), "balls")


def chained(pivots: np.ndarray) -> np.ndarray:
    """A place for each pivot in a chain from each to the nearest that is not in it yet."""
    place, left, at = np.zeros(len(pivots), np.int64), np.ones(len(pivots), bool), 0
    for i in range(len(pivots)):
        place[at], left[at] = i, False
        at = int(np.where(left, pivots @ pivots[at], -np.inf).argmax())
    return place


def shelved(gallery: DataFrame, pivots: np.ndarray, rows_per_block: int) -> tuple[DataFrame, DataFrame, int]:
    """The gallery's balls on shelves: ``g_fold, g_ball, shelf`` (every shelf that holds a part of a ball), the gallery with ``shelf``, and the number of shelves.

    Balls lie fold by fold along a chain of near pivots, so few shelves hold what a ball of queries may meet.  There are
    ``SHELVES`` shelves, more if one would hold over ``SHELF`` rows, fewer if they would hold under ``rows_per_block``.
    """
    spark = gallery.sparkSession
    sizes = gallery.groupBy("fold", "ball").agg(F.count("*").alias("n"))
    order = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(chained(pivots))], "ball int, place int"))  # a row for each pivot
    at = sizes.join(order, "ball").withColumn("stop", F.sum("n").over(Window.orderBy("fold", "place")))  # folds times pivots rows
    n = gallery.count()
    each = max(1, min(SHELF, max(rows_per_block, -(-n // SHELVES))))
    # A ball lies on every shelf that its range of places touches; a hash gives each of its rows one of the places.
    ranges = materialise(at.select("fold", "ball", "n", (F.col("stop") - F.col("n")).alias("start")), "shelves")
    number = lambda place: F.floor(place / each).cast("int")
    held = gallery.join(F.broadcast(ranges), ["fold", "ball"]).withColumn("shelf", number(F.col("start") + F.pmod(F.xxhash64("sample"), "n")))
    lies = ranges.select(F.col("fold").alias("g_fold"), F.col("ball").alias("g_ball"), F.explode(F.sequence(number(F.col("start")), number(F.col("start") + F.col("n") - 1))).alias("shelf"))
    return lies, held.drop("n", "start"), -(-n // each)


def past_shelves(queries: DataFrame, held: DataFrame, lies: DataFrame, couples: DataFrame, shelves: int, k: int) -> DataFrame:
    """``query, gallery, similarity``: of each shelf the ``k`` best of every query among the balls that its own ball meets there.

    ``queries`` have a ``floor``; what is less similar is left out.  ``couples``: ``q_fold, q_ball, g_fold, g_ball`` that meet.  A task holds a
    shelf, a query goes once to each shelf with a ball to meet, behind a row that names those of its ball.
    """
    gallery_ball = F.xxhash64("g_fold", "g_ball")
    aims = materialise(couples.join(F.broadcast(lies), ["g_fold", "g_ball"]).groupBy(F.col("q_fold").alias("fold"), F.col("q_ball").alias("ball"), "shelf").agg(F.collect_set(gallery_ball).alias("meets")), "aims")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shelf, meets, seen = [], None, None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            first = int((kinds > 0).argmax()) if (kinds > 0).any() else len(batch)
            if first:
                held.append(batch.slice(0, first))
            if first == len(batch):
                continue
            if shelf is None:
                t = pa.Table.from_batches(held) if held else None
                ids = np.zeros(0, object) if t is None else t["sample"].to_numpy()
                order = np.argsort(ids, kind="stable")
                shelf = (ids[order], t["g"].to_numpy()[order], vectors_in(t["features"])[order], t["ball"].to_numpy()[order]) if len(ids) else None
                held = []
            if shelf is None:
                continue
            balls = batch.column("ball").to_numpy()
            edges = [first, *(first + 1 + np.flatnonzero(balls[first + 1 :] != balls[first:-1])), len(batch)]
            for low, high in zip(edges[:-1], edges[1:]):
                if kinds[low] == 1:
                    meets, seen = np.flatnonzero(np.isin(shelf[3], np.array(batch.column("meets")[low].as_py(), np.int64))), balls[low]
                    low += 1
                if low < high and balls[low] != seen:
                    raise ValueError("queries without the balls they meet")
                y_groups, y = (shelf[1], shelf[2]) if len(meets) == len(shelf[0]) else (shelf[1][meets], shelf[2][meets])
                for i in range(low, high, 1024):
                    some = batch.slice(i, min(1024, high - i))
                    names, least = some.column("sample").to_numpy(zero_copy_only=False), some.column("floor").to_numpy()
                    row, col, value = best_on_shelf(vectors_in(some.column("features")), some.column("g").to_numpy(), y, y_groups, np.arange(len(y)), k, floor=least)
                    yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.string()), pa.array(shelf[0][meets[col]], pa.string()), pa.array(value)], names=["query", "gallery", "similarity"])

    def row(x: DataFrame, kind: int, **has) -> DataFrame:
        """The columns of every kind of row: 0 of the gallery, 1 the balls that a ball of queries meets, 2 a query."""
        types = {"sample": "string", "g": "long", "floor": "double", "features": "array<double>", "meets": "array<long>"}
        return x.select("shelf", F.lit(kind).alias("kind"), F.xxhash64("fold", "ball").alias("ball"), *[has[c].alias(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in types.items()])

    vector = {c: F.col(c) for c in ("sample", "g", "features")}
    asks = queries.join(F.broadcast(aims.groupBy("fold", "ball").agg(F.collect_list("shelf").alias("to"))), ["fold", "ball"]).withColumn("shelf", F.explode("to"))
    rows = row(held, 0, **vector).unionByName(row(aims, 1, meets=F.col("meets"))).unionByName(row(asks, 2, floor=F.col("floor"), **vector))
    # The gallery first, then ball after ball of queries, each behind the row that names what it meets.
    dealt = rows.repartitionById(shelves, "shelf").sortWithinPartitions(F.when(F.col("kind") > 0, 1).otherwise(0), "ball", "kind")
    return dealt.select("kind", "ball", "sample", "g", "floor", "features", "meets").mapInArrow(work, "query string, gallery string, similarity double")


def pruned_topk(queries: DataFrame, gallery: DataFrame, k: int, rows_per_block: int = 2048, most_pivots: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The result of ``exact_topk``, and ``q_fold, q_ball, g_fold, g_ball, met``: which couples of balls met.

    Items lie in balls around the nearest of some square root of n pivots (``most_pivots`` at most, spread out among
    four times as many items that a hash of the id chooses).  First each ball of queries meets the gallery balls of the same pivot; the least k-th similarity found there
    bounds the whole ball.  Then it meets those other balls alone that could hold something nearer: two balls whose
    pivots are far apart by more than both radii and the angle of that bound cannot.  Queries that found fewer than k
    bar nothing.  The result is exact, whatever the pivots; on vectors without clusters few couples are spared.
    Both times the gallery's balls lie on shelves past which queries are read, as in ``exact_topk``, so however many
    couples meet, a query is shuffled at most once for each shelf.
    """
    bad = F.raise_error(F.lit("vectors must be finite and not zero")).cast("array<double>")
    n = gallery.count()
    if not n:
        none = exact_topk(queries, gallery, k)
        return none, gallery.sparkSession.createDataFrame([], "q_fold int, q_ball int, g_fold int, g_ball int, met boolean")
    q, g = (x.withColumn("features", F.coalesce(unit(F.col("features")), bad)) for x in (queries, gallery))
    m = min(most_pivots, max(1, round(n**0.5)))
    pivots = spread_out(np.array([r["features"] for r in g.select("sample", "features").orderBy(F.xxhash64("sample"), "sample").limit(4 * m).collect()]), m)
    q, g = balls(q, pivots), balls(g, pivots)
    lies, held, shelves = shelved(g, pivots, rows_per_block)
    reach = g.groupBy(F.col("fold").alias("g_fold"), F.col("ball").alias("g_ball")).agg(F.max("angle").alias("g_radius"))
    own = q.select(F.col("fold").alias("q_fold"), F.col("ball").alias("q_ball")).distinct().join(F.broadcast(reach), F.expr("q_fold <> g_fold and q_ball = g_ball"))
    near = materialise(past_shelves(q.withColumn("floor", F.lit(-2.0)), held, lies, own.drop("g_radius"), shelves, k), "near")
    kth = near.groupBy("query").agg(F.array_sort(F.collect_list(-F.col("similarity"))).alias("s")).select(F.col("query").alias("sample"), F.when(F.size("s") >= k, -F.col("s")[k - 1]).alias("kth"))
    q = materialise(q.join(kth, "sample", "left").withColumn("floor", F.coalesce("kth", F.lit(-2.0))).drop("kth"), "bounded-queries")
    least = q.groupBy(F.col("fold").alias("q_fold"), F.col("ball").alias("q_ball")).agg(F.max("angle").alias("q_radius"), F.greatest(F.min("floor"), F.lit(-1.0)).alias("kth"))
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    apart = q.sparkSession.sparkContext.broadcast(between)

    @F.pandas_udf("double")
    def angle(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(apart.value[a.to_numpy(), b.to_numpy()])

    # Couples of balls, some n of them: square root of n on either side.
    couples = least.join(F.broadcast(reach), F.expr("q_fold <> g_fold")).withColumn("met", (F.col("q_ball") == F.col("g_ball")) | (
        angle("q_ball", "g_ball") - F.col("q_radius") - F.col("g_radius") <= F.acos(F.col("kth")) + F.lit(ROUNDING)))
    couples = materialise(couples.select("q_fold", "q_ball", "g_fold", "g_ball", "met"), "couples")
    far = past_shelves(q, held, lies, couples.where("met and q_ball <> g_ball"), shelves, k)
    return best_of(near.unionByName(far), k), couples


def with_labels(neighbours: DataFrame, items: DataFrame) -> DataFrame:
    """Add fold and label of the query, label of the neighbour and ``relevant``."""
    q = items.select(F.col("sample").alias("query"), "fold", F.col("label").alias("query_label"))
    g = items.select(F.col("sample").alias("gallery"), F.col("label").alias("gallery_label"))
    return neighbours.join(q, "query").join(g, "gallery").withColumn("relevant", (F.col("query_label") == F.col("gallery_label")).cast("int"))


def relevant_counts(items: DataFrame) -> DataFrame:
    """``query, n_relevant``: eligible gallery items of the query's label, by counts alone.

    All of the label, less those of its fold, less those of its group, plus those of both.
    """
    by = {"a": ["label"], "b": ["label", "fold"], "c": ["label", "grp"], "d": ["label", "fold", "grp"]}
    out = items.select("sample", "label", "fold", "grp")
    for name, keys in by.items():
        out = out.join(items.groupBy(*keys).agg(F.count("*").alias(name)), keys)
    return out.select(F.col("sample").alias("query"), (F.col("a") - F.col("b") - F.col("c") + F.col("d")).alias("n_relevant"))


def votes(labelled: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``query, k, vote``: the most frequent label of the k nearest, then the larger similarity sum, then the label."""
    at_k = labelled.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    per = at_k.groupBy("query", "k", "gallery_label").agg(F.count("*").alias("n"), F.sum("similarity").alias("s"))
    w = Window.partitionBy("query", "k").orderBy(F.desc("n"), F.desc("s"), "gallery_label")
    return per.withColumn("r", F.row_number().over(w)).where("r = 1").select("query", "k", F.col("gallery_label").alias("vote"))


def query_metrics(neighbours: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per query and k: returned, precision, recall, hit, average precision and majority vote.

    Precision divides by the items returned, average precision by the smaller of the relevant
    count and k; a query without neighbours has zeros and a wrong vote.
    """
    labelled = materialise(with_labels(neighbours, items), "neighbours")  # read by two branches
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = labelled.withColumn("hits_so_far", F.sum("relevant").over(w))
    at_k = running.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    per = at_k.groupBy("query", "k").agg(
        F.count("*").alias("n_returned"), F.sum("relevant").alias("hits"),
        F.sum(F.when(F.col("relevant") == 1, F.col("hits_so_far") / F.col("rank")).otherwise(F.lit(0.0))).alias("gain"))
    base = items.select(F.col("sample").alias("query"), "fold", "label").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    full = base.join(relevant_counts(items), "query").join(per, ["query", "k"], "left").join(votes(labelled, ks), ["query", "k"], "left")
    hits, n = F.coalesce("hits", F.lit(0)), F.coalesce("n_returned", F.lit(0))
    return full.select(
        "query", "fold", "k", n.cast("long").alias("n_returned"), F.col("n_relevant").cast("long").alias("n_relevant"),
        safe_divide(hits, n).alias("precision"), safe_divide(hits, F.col("n_relevant")).alias("recall"),
        (hits > 0).cast("double").alias("hit"),
        safe_divide(F.coalesce("gain", F.lit(0.0)), F.least("n_relevant", "k")).alias("average_precision"),
        F.coalesce((F.col("vote") == F.col("label")).cast("double"), F.lit(0.0)).alias("vote_correct"))


METRICS = ("precision", "recall", "hit", "average_precision", "vote_correct")


def mean_metrics(per_query: DataFrame, keys: list[str]) -> DataFrame:
    return per_query.groupBy(*keys).agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in METRICS])


def fold_and_pooled(per_query: DataFrame) -> DataFrame:
    """Means per (fold, k) and over all queries per k (``fold`` -1), in one pass by grouping sets."""
    sums = per_query.groupingSets([["fold", "k"], ["k"]], "fold", "k").agg(
        F.count("*").alias("n_queries"), F.grouping("fold").alias("pooled"), *[F.avg(m).alias(m) for m in METRICS])
    return sums.withColumn("fold", F.when(F.col("pooled") == 1, F.lit(-1)).otherwise(F.col("fold"))).drop("pooled")


def over_folds(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    """Long mean and sample SD over folds of each metric; the SD of one fold is 0."""
    cells = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = per_fold.select(*keys, F.expr(f"stack({len(METRICS)}, {cells}) as (metric, value)"))
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_folds"))


def attach_stratum(per_query: DataFrame, strata: DataFrame) -> DataFrame:
    """Stratum of each query by id; ``checks.row_rule`` on the result finds queries without one."""
    return per_query.join(strata.select(F.col("sample").alias("query"), "stratum"), "query", "left")


def held_out_retrieval(items: DataFrame, k: int = 20, ks: tuple[int, ...] = KS) -> dict[str, DataFrame]:
    """Neighbours, per-query metrics, fold and pooled means, and mean and SD over folds."""
    checks.require(input_checks(items))
    neighbours = materialise(exact_topk(items, items, k), "neighbours")
    per_query = materialise(query_metrics(neighbours, items, ks), "per-query")
    return {"neighbours": neighbours, "per_query": per_query, "means": fold_and_pooled(per_query),
            "over_folds": over_folds(mean_metrics(per_query, ["fold", "k"]), ["k"])}
