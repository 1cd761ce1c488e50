"""Stratified group bootstrap, paired randomisation tests and intervals.

Draws follow from (seed, stratum, slot) and the replicate alone, so they are the same on any partitioning
and after any recomputation; systems evaluated with one seed share their draws.  A stratum of many slices
splits the number of its draws along a tree, by binomial counts of a counter-based generator whose key names
the node: a slice walks down to its own count and draws that many slots, so the cost is linear in the groups.
A whole slice of such a stratum deals its draws as Poisson numbers and makes up for the difference (``spread``).
Statistics of a group (counts per class, or a sum and a count) are aggregated once.  A task then
takes slices of the groups of one stratum, makes the weights of all replicates for them as a matrix,
multiplies it by their statistics and adds up over its slices: what is shuffled is a row per group, and
a sum per task and replicate, never a row per group and replicate.
"""

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hash32
from ..sources.shared import materialise
from .compare import holm
from .evaluate import METRICS, counts_by_row
from .folds import numbered

#: Groups in a slice, replicates in a row of sums, and replicates drawn at once.
SLICE, CHUNK, AT_ONCE = 2048, 2000, 50
#: Tasks among which the slices are dealt, at least where there are as many; each sends its sums of all replicates once.
DEALT = 96
# The steps by which slots and replicates are counted on, and the multiplier of ``mix32``.
GOLDEN, START, MULTIPLIER = 2654435769, 362437, 73244475
COUNTS = ("tp", "actual", "predicted")


def check_parameters(replicates: int, level: float) -> None:
    if replicates < 1 or not 0 < level < 1:
        raise ValueError("replicates must be positive and the level between 0 and 1")


def mix32(x: np.ndarray) -> np.ndarray:
    """Scramble 32-bit numbers (multiply and xor-shift rounds)."""
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(MULTIPLIER)
    return (x >> np.uint32(16)) ^ x


def scrambled(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``mix32`` in place; ``room``: an array of the same shape."""
    for _ in range(2):
        np.bitwise_xor(np.right_shift(x, np.uint32(16), out=room), x, out=x)
        np.multiply(x, np.uint32(MULTIPLIER), out=x)
    return np.bitwise_xor(np.right_shift(x, np.uint32(16), out=room), x, out=x)


def counted(base: int, first: int, stop: int) -> np.ndarray:
    """The scrambled numbers ``first`` to ``stop`` of the sequence that begins at ``base``."""
    return mix32(((base + np.arange(first, stop, dtype=np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def stable_groups(groups: DataFrame) -> DataFrame:
    """``grp, stratum``, each group once (in each ``cohort``, if there is such a column); a group in two strata, or in none, fails the query."""
    key = [c for c in ("cohort", "grp") if c in groups.columns]
    one = groups.groupBy(*key).agg(F.min("stratum").alias("stratum"), F.max("stratum").alias("other"))
    fine = (F.col("stratum") == F.col("other")) & F.col("grp").isNotNull()
    return one.select(*key, F.when(fine, F.col("stratum")).otherwise(F.raise_error(F.lit("every group must lie in one stratum"))).alias("stratum"))


def group_positions(groups: DataFrame) -> DataFrame:
    """``grp, stratum, pos, n``: place of each group in its stratum (by digest of its id) and the stratum's size; ``cohort`` too, where ``groups`` has it."""
    one = stable_groups(groups)
    stratum = [c for c in one.columns if c != "grp"]
    sizes = one.groupBy(*stratum).agg(F.count("*").alias("n"))
    return numbered(one, stratum, F.md5(F.col("grp").cast("binary")), "grp", "pos").join(sizes, stratum)


def slice_counts(base: int, n: int, at: int, first: int, stop: int) -> np.ndarray:
    """How many of the ``n`` draws of a stratum fall into its slice ``at``, in replicates ``first`` (a multiple of ``CHUNK``) to ``stop``.

    A node of the tree is a range of slices; its left half takes a binomial part of its draws, by its part of the groups.
    """
    low, high, count = 0, -(-n // SLICE), np.full(stop - first, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * SLICE / (min(high * SLICE, n) - low * SLICE)
        node = np.random.Generator(np.random.Philox(key=np.array([base << 32 | first, low << 32 | high], np.uint64)))
        left = node.binomial(count, share)
        low, high, count = (low, middle, left) if at < middle else (middle, high, count - left)
    return count


#: Sizes of slices whose groups a number below 2^16 names as they are, the rate at which ``spread`` deals most draws, and the numbers below 2^16 that stand for 0, 1, 2 and on.
POWERS, RATE = [2**i for i in range(17)], 0.9
_PART = np.array([math.exp(-RATE) * RATE**k / math.factorial(k) for k in range(30)]) * 2**16
_REST = _PART - np.floor(_PART)


def spread(count: np.ndarray, key: tuple[int, ...], kind: type = float) -> np.ndarray:
    """``count`` draws, a number for each replicate, over the groups of a whole slice: a row of counts for each, exactly multinomial.

    Poisson numbers of one rate are multinomial given their sum, so most draws are dealt as such, one for each group, by numbers
    below 2^16; what these cannot tell apart is drawn from the rest of the distribution.  Draws that are then lacking are made one by
    one, and of too many a random part is kept.  Each use has a stream of random numbers of its own, which is read row by row.
    """
    edges = np.cumsum(np.floor(_PART)[np.floor(_PART) > 0]).astype(np.uint16)  # where 1, 2 and on begin, and at last what no place holds
    rests = np.cumsum(_REST) / _REST.sum()
    deal, rest, lack, cut = (np.random.SFC64(np.random.SeedSequence([*key, use])) for use in range(4))
    rest, cut = np.random.Generator(rest), np.random.Generator(cut)
    out = np.empty((len(count), SLICE), kind)
    for i in range(0, len(count), 4 * AT_ONCE):
        some, rows = count[i : i + 4 * AT_ONCE], out[i : i + 4 * AT_ONCE]
        x = deal.random_raw(len(some) * -(-SLICE // 4)).view(np.uint16).reshape(len(some), -1)[:, :SLICE]
        dealt = np.zeros(x.shape, np.uint8)
        for e in edges[:-1]:
            dealt += (x >= e).view(np.uint8)
        rows[:] = dealt
        odd = np.flatnonzero(x.max(axis=1) >= edges[-1])
        r, g = np.nonzero(x[odd] >= edges[-1])
        rows[odd[r], g] = np.searchsorted(rests, rest.random(len(r)), side="right")
        more = some - rows.sum(axis=1).astype(np.int64)
        for r in np.flatnonzero(more < 0):
            rows[r] = cut.multivariate_hypergeometric(rows[r].astype(np.int64), int(some[r]))
        more = np.maximum(more, 0)
        room = -(-more // 4) * 4
        picks = lack.random_raw(int(room.sum()) // 4).view(np.uint16) & np.uint16(SLICE - 1)
        of = np.repeat(np.arange(len(some)), room)
        mine = np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room) < more[of]
        np.add.at(rows.reshape(-1), (of * SLICE + picks)[mine], kind(1))
    return out


def weight_matrix(base: int, n: int, low: int, high: int, first: int, stop: int, kind: type = float) -> np.ndarray:
    """How often replicates ``first`` to ``stop`` draw the groups ``low`` to ``high``, a slice of a stratum of ``n`` groups."""
    width, at = high - low, low // SLICE
    count = slice_counts(base, n, at, first, stop)
    if n > SLICE == width and SLICE in POWERS:
        return spread(count, (base, first, at), kind)
    reps = counted(START, first, stop)
    if n > SLICE:  # each slice has slots of its own
        base = int(mix32(np.array([(base + (at + 1) * GOLDEN) & 0xFFFFFFFF], np.uint32))[0])
    slots, out = counted(base, 0, int(count.max())), np.zeros((stop - first, width), kind)
    x, room, pick = (np.empty(AT_ONCE * len(slots), t) for t in (np.uint32, np.uint32, np.int64))
    for i in range(0, stop - first, AT_ONCE):
        some = count[i : i + AT_ONCE]
        most = int(some.max())
        a, r, p = (v[: len(some) * most].reshape(len(some), most) for v in (x, room, pick))
        scrambled(np.bitwise_xor(reps[i : i + AT_ONCE, None], slots[None, :most], out=a), r)
        # The remainder by way of the quotient, which numpy divides several at a time.
        np.subtract(a, np.multiply(np.floor_divide(a, np.uint32(width), out=r), np.uint32(width), out=r), out=a)
        np.add(a, (np.arange(len(some)) * width)[:, None], out=p, casting="unsafe")
        least = int(some.min())
        if least < most:  # slots beyond a replicate's count fall into one more bin
            np.putmask(p[:, least:], np.arange(least, most) >= some[:, None], len(some) * width)
        out[i : i + AT_ONCE] = np.bincount(p.ravel(), minlength=len(some) * width + 1)[:-1].reshape(len(some), width)
    return out


def sign_matrix(token: np.ndarray, first: int, stop: int, kind: type = float) -> np.ndarray:
    """1 where replicates ``first`` to ``stop`` turn the sign of a group, by its ``token``; else 0."""
    out = np.empty((stop - first, len(token)), kind)
    for i in range(0, stop - first, AT_ONCE):
        x = counted(START, first + i, min(stop, first + i + AT_ONCE))[:, None] ^ token[None, :]
        out[i : i + AT_ONCE] = scrambled(x, np.empty_like(x)) & np.uint32(1)
    return out


def draws(groups: DataFrame, replicates: int, seed) -> DataFrame:
    """``replicate, grp, weight``: within each stratum as many groups as it has, drawn with replacement.

    Groups not drawn in a replicate have no row.  ``draw_counts`` tells of them without a row for each.
    """
    rows = _placed(groups, seed)[0]

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        n, low = int(pdf["n"].iloc[0]), int(pdf["slice"].iloc[0]) * SLICE
        names = pdf.sort_values("pos")["grp"].to_numpy()
        w = weight_matrix(int(pdf["base"].iloc[0]), n, low, low + len(names), int(pdf["first"].iloc[0]), min(replicates, int(pdf["first"].iloc[0]) + CHUNK))
        r, g = np.nonzero(w)
        return pd.DataFrame({"replicate": r + int(pdf["first"].iloc[0]), "grp": names[g], "weight": w[r, g].astype(np.int64)})

    chunks = rows.withColumn("base", F.col("bases")[0]).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(CHUNK))))
    return chunks.groupBy("stratum", "slice", "first").applyInPandas(expand, f"replicate int, grp {groups.schema['grp'].dataType.simpleString()}, weight long")


def draw_counts(groups: DataFrame, replicates: int, seed) -> DataFrame:
    """What ``draws`` gives each group: ``grp, n_replicates, n_drawn, most, digest``, as replicates that draw it, draws, most in one
    replicate and draws weighted by the number of the replicate, from 1.

    A task sums the weights of a slice over its replicates, so a group leaves it as one row.  A group that is never drawn has none.
    """
    rows, parts = _placed(groups, seed)
    rows = rows.withColumn("base", F.col("bases")[0]).repartitionById(parts, "part")

    def count(batches):
        for pdf in slices(batches):
            n, low = int(pdf["n"].iloc[0]), int(pdf["slice"].iloc[0]) * SLICE
            names = pdf.sort_values("pos")["grp"].to_numpy()
            found, drawn, most, digest = np.zeros((4, len(names)), np.int64)
            for first in range(0, replicates, CHUNK):
                w = weight_matrix(int(pdf["base"].iloc[0]), n, low, low + len(names), first, min(replicates, first + CHUNK))
                found += (w > 0).sum(axis=0)
                drawn += w.sum(axis=0).astype(np.int64)
                most = np.maximum(most, w.max(axis=0).astype(np.int64))
                digest += (np.arange(first + 1, first + len(w) + 1, dtype=float) @ w).astype(np.int64)
            out = pd.DataFrame({"grp": names, "n_replicates": found, "n_drawn": drawn, "most": most, "digest": digest})
            yield pa.RecordBatch.from_pandas(out[out["n_drawn"] > 0], preserve_index=False)

    def slices(batches):
        for pieces in by_unit(batches):
            yield pa.Table.from_batches(pieces).to_pandas()

    return rows.select("grp", "pos", "n", "slice", "base", "unit").sortWithinPartitions("unit").mapInArrow(
        count, f"grp {groups.schema['grp'].dataType.simpleString()}, n_replicates long, n_drawn long, most long, digest long")


def by_unit(batches):
    """Pieces of the batches of a task, which is sorted by ``unit``: a list for each of its values."""
    held, now = [], None
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)] if len(unit) else [0]
        for low, high in zip(edges[:-1], edges[1:]):
            if held and unit[low] != now:
                yield held
                held = []
            now = unit[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield held


def _placed(groups: DataFrame, seed, own: list[str | None] = [None]) -> tuple[DataFrame, int]:  # noqa: B006
    """Positions with ``slice``, ``part`` (the task that takes the slice), ``unit`` (stands for the slice), ``bases`` (of the draws) and ``token`` (of the signs); and the number of parts.

    ``own``: which draws to make, a base for each; null are those of ``seed`` alone.
    """
    key = [c for c in ("cohort", "grp") if c in groups.columns]
    groups = materialise(groups.select(*key, "stratum").distinct(), "resampled-groups")
    placed = group_positions(groups).withColumn("slice", F.floor(F.col("pos") / SLICE))
    strata = groups.groupBy(*[c for c in groups.columns if c != "grp"]).agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    parts = min(max(1, strata.agg(F.sum("slices")).first()[0] or 1), max(DEALT, groups.sparkSession.sparkContext.defaultParallelism))
    within = [c for c in groups.columns if c != "grp"]
    bases = F.array(*[hash32(F.lit(str(seed) if d is None else f"{seed}-{d}"), F.col("stratum")) for d in own])
    return placed.withColumns({
        "part": F.pmod(F.pmod(F.xxhash64(*within), F.lit(parts)) + F.col("slice"), F.lit(parts)).cast("int"), "unit": F.xxhash64(*within, "slice"),
        "bases": bases, "token": hash32(f"sign-{seed}", F.col("grp"))}), parts


def _coded(stats: DataFrame, keys: list[str], values: list[str], scope: list[str], series: DataFrame | None) -> tuple[DataFrame, list]:
    """A row for each group, with arrays of ``_code`` and values; and what the codes stand for: ``_code`` and the columns ``keys``.

    Whoever partitions ``stats`` by ``grp`` spares it a shuffle.  Codes are hashes; two keys of one hash fail.  ``series``: the
    keys that may occur, where they can be told without ``stats``.
    """
    code = F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())]).alias("_code")
    if series is None:
        stats = materialise(stats, "group-statistics")
    known = (stats if series is None else series).select(code, *keys).distinct().orderBy("_code").collect()  # a row for each statistic
    if len({r["_code"] for r in known}) < len(known):
        raise ValueError("two statistics have one hash")
    entry = F.struct(code, *[F.col(v).cast("double").alias(f"_v{j}") for j, v in enumerate(values)])
    packed = stats.groupBy(*scope, "grp").agg(F.collect_list(entry).alias("e"))
    return packed.select(*scope, "grp", F.col("e._code").alias("_code"), *[F.col(f"e._v{j}").alias(f"_v{j}") for j in range(len(values))]), known


def resampled_sums(stats: DataFrame, keys: list[str], values: list[str], groups: DataFrame, replicates: int, seed, kinds: tuple[str, ...] = ("draw",), series: DataFrame | None = None) -> DataFrame:
    """``keys..., kind, first``, and for each value an array: its sum over groups in replicates ``first``, ``first`` + 1 and on; and ``<value>_total``.

    ``stats``: ``keys..., grp`` and values, one row per key and group.  In kind ``draw`` a group counts as
    often as the replicate drew it, in kind ``flip`` if the replicate turns its sign (only keys whose column ``flips`` is true, if there is one).  If ``stats`` has a column ``draw``,
    each value of it has draws of its own; if both tables have a column ``cohort``, groups are those of their cohort.
    ``series``: values of ``keys``, ``cohort`` and ``draw`` that may occur, where they can be had without the sums of groups.
    A group is shuffled as one row; the slices of a task are read one after another and its sums leave it once, so they grow with ``DEALT``, not with the groups.
    """
    spark, nv = stats.sparkSession, len(values)
    scope = ["cohort"] if "cohort" in stats.columns and "cohort" in groups.columns else []
    every = list(dict.fromkeys([*keys, *(c for c in ("cohort", "draw") if c in stats.columns)]))
    packed, known = _coded(stats, every, values, scope, series)
    draw_of = [None if "draw" not in every or r["draw"] is None else str(r["draw"]) for r in known]
    own = sorted(set(draw_of), key=lambda d: (d is not None, d or "")) or [None]
    codes, drawn_by = np.array([r["_code"] for r in known], np.int64), np.array([own.index(d) for d in draw_of], np.int64)
    turns = np.array(["flips" not in every or bool(r["flips"]) for r in known], bool)
    placed, parts = _placed(groups, seed, own)
    rows = packed.join(placed, [*scope, "grp"], "left").withColumn("n", F.coalesce("n", F.raise_error(F.lit("a group has no stratum")).cast("long")))
    dealt = rows.select("part", "unit", "slice", "n", "pos", "bases", "token", "_code", *[f"_v{j}" for j in range(nv)]).repartitionById(parts, "part").sortWithinPartitions("unit")

    def work(batches):
        sums = {kind: np.zeros((replicates, len(codes), nv)) for kind in kinds}
        total, seen = np.zeros((len(codes), nv)), np.zeros(len(codes), bool)

        def take(pieces: list) -> None:
            """Add the sums of one slice."""
            t = pa.Table.from_batches(pieces)
            n, low = t["n"][0].as_py(), t["slice"][0].as_py() * SLICE
            high, bases = min(low + SLICE, n), t["bases"][0].as_py()
            at = t["pos"].to_numpy() - low
            token = np.zeros(high - low, np.uint32)
            token[at] = t["token"].to_numpy().astype(np.uint32)
            lists = t["_code"].combine_chunks()
            found, of = lists.flatten().to_numpy(), np.repeat(at, lists.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            if (codes[place] != found).any():
                raise ValueError("a statistic is not among the series")
            v = np.stack([t[f"_v{j}"].combine_chunks().flatten().to_numpy(zero_copy_only=False) for j in range(nv)], axis=1)
            for d in range(len(own)):
                here = drawn_by[place] == d
                cols, col = np.unique(place[here], return_inverse=True)
                if not len(cols):
                    continue
                m = np.zeros((high - low, len(cols), nv))
                np.add.at(m, (of[here], col), v[here])
                total[cols] += m.sum(axis=0)
                seen[cols] = True
                # Sums of whole numbers below 2^24 are exact in single precision, whatever their order.
                kind_of = np.float32 if (m == np.rint(m)).all() and np.abs(m).max() * 4 * SLICE < 2**24 else float
                for first in range(0, replicates, CHUNK):
                    stop = min(replicates, first + CHUNK)
                    for kind in kinds:
                        if kind == "flip":
                            mine = cols[turns[cols]]
                            w = sign_matrix(token, first, stop, kind_of) if len(mine) else None
                            part = m[:, turns[cols]]
                        else:
                            mine, part = cols, m
                            w = weight_matrix(bases[d], n, low, high, first, stop, kind_of)
                            if kind_of is np.float32 and w.sum(axis=1).max() > 4 * SLICE:
                                w = w.astype(float)
                        if len(mine):
                            sums[kind][first:stop, mine] += (w @ part.reshape(high - low, -1).astype(w.dtype)).reshape(stop - first, len(mine), nv)

        for pieces in by_unit(batches):
            take(pieces)
        for kind in kinds:
            found = np.flatnonzero(seen & turns) if kind == "flip" else np.flatnonzero(seen)
            for first in range(0, replicates, CHUNK) if len(found) else ():
                stop = min(replicates, first + CHUNK)
                ends = np.arange(len(found) + 1, dtype=np.int32) * (stop - first)
                cells = [pa.array(codes[found]), pa.array([kind] * len(found)), pa.array([first] * len(found), pa.int32())]
                for j in range(nv):
                    cells += [pa.ListArray.from_arrays(ends, np.ascontiguousarray(sums[kind][first:stop, found, j].T).ravel()), pa.array(total[found, j])]
                yield pa.RecordBatch.from_arrays(cells, names=["_code", "kind", "first", *[x for u in values for x in (u, f"{u}_total")]])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf
        out = pdf.iloc[:1].copy()
        for v in values:
            out[v] = [np.sum(np.stack(pdf[v].to_list()), axis=0)]
            out[f"{v}_total"] = pdf[f"{v}_total"].sum()
        return out

    schema = ", ".join(["_code long, kind string, first int", *[f"{v} array<double>, {v}_total double" for v in values]])
    added = dealt.mapInArrow(work, schema).groupBy("_code", "kind", "first").applyInPandas(add, schema)
    fields = ", ".join(["_code long", *[f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in every]])
    names = spark.createDataFrame([tuple(r) for r in known], fields)
    return added.join(F.broadcast(names), "_code").select(*keys, "kind", "first", *[x for v in values for x in (v, f"{v}_total")])


def rates_of(tp: np.ndarray, actual: np.ndarray, predicted: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Metrics from counts, classes along the first axis; classes that are missing count with zeros in the means."""
    with np.errstate(divide="ignore", invalid="ignore"):
        recall = np.where(actual > 0, tp / actual, 0.0)
        f1 = np.where(actual + predicted > 0, 2 * tp / (actual + predicted), 0.0)
        n = actual.sum(axis=0)
        return {"accuracy": np.where(n > 0, tp.sum(axis=0) / n, 0.0), "balanced_accuracy": recall.sum(axis=0) / universe, "macro_f1": f1.sum(axis=0) / universe,
                "weighted_f1": np.where(n > 0, (f1 * actual).sum(axis=0) / n, 0.0)}


class Sums:
    """Sums of one statistic: ``of(kind, value)`` gives replicates and total, with classes along the first axis where there are classes.

    Made from rows of ``resampled_sums`` for one key: wide (a column for each value, a row for each class), or long (a
    column ``value`` and a row for each ``cell``, the name of the value with its class after ``|``).
    """

    def __init__(self, pdf: pd.DataFrame):
        self.pdf, self.long = pdf.sort_values("first"), "cell" in pdf.columns

    def of(self, kind: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        rows, column = self.pdf[self.pdf["kind"] == kind], value
        if self.long:
            name = rows["cell"].str.split("|")
            rows, column = rows.assign(class_id=name.str[1])[name.str[0] == value], "value"
        if "class_id" not in rows or rows["class_id"].isna().all():
            return np.concatenate(rows[column].to_list()), rows[f"{column}_total"].iloc[0]
        parts = sorted(((int(c), part) for c, part in rows.groupby("class_id")), key=lambda x: x[0])
        return np.stack([np.concatenate(part[column].to_list()) for _, part in parts]), np.array([part[f"{column}_total"].iloc[0] for _, part in parts])


def percentiles(values: np.ndarray, level: float) -> dict:
    """Linear-interpolation percentiles: ``ci_low, ci_high, n_bootstrap``."""
    low, high = np.quantile(values, [(1 - level) / 2, 1 - (1 - level) / 2])
    return {"ci_low": low, "ci_high": high, "n_bootstrap": len(values)}


def p_value(null: np.ndarray, seen: float) -> float:
    return float((np.abs(null) >= abs(seen) - SLACK).sum() + 1) / (len(null) + 1)


def _finish(sums: DataFrame, keys: list[str], columns: str, finish) -> DataFrame:
    """One call of ``finish`` (``Sums``, a row) for each value of ``keys``; ``columns``: what its dicts add to them."""
    names = [c.split()[0] for c in columns.split(", ")]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(finish(Sums(pdf), pdf.iloc[0]), columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([*[f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys], columns])
    return sums.groupBy(*keys).applyInPandas(of, schema)


def with_universe(sums: DataFrame, classes: DataFrame) -> DataFrame:
    return sums.join(F.broadcast(classes.agg(F.countDistinct("class_id").alias("universe"))))  # one row


def group_class_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of each group: ``keys..., grp, class_id, tp, actual, predicted``."""
    return counts_by_row(rows, [*keys, "grp"])


def _class_series(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array("true_id", "pred_id")).alias("class_id")).distinct()


def classification_distribution(rows: DataFrame, groups: DataFrame, classes: DataFrame, keys: list[str], replicates: int, seed=0, by_seed: bool = False) -> DataFrame:
    """Every replicate of every metric: ``keys..., metric, first, estimate, replicates``, an array for each ``CHUNK`` replicates from ``first`` on.

    ``by_seed``: each value of the key ``seed`` has draws of its own; else all systems share them.  No task sees
    more of a system than its classes in one chunk of replicates.
    """
    check_parameters(replicates, 0.5)
    counts, series = group_class_counts(rows, keys), _class_series(rows, keys)
    if by_seed:
        counts, series = (x.withColumn("draw", F.col("seed").cast("string")) for x in (counts, series))

    def finish(sums: Sums, row) -> list[dict]:
        both = [sums.of("draw", c) for c in COUNTS]
        reps, point = rates_of(*[x for x, _ in both], int(row["universe"])), rates_of(*[t for _, t in both], int(row["universe"]))
        return [{"metric": m, "estimate": float(point[m]), "replicates": reps[m]} for m in METRICS]

    sums = resampled_sums(counts, [*keys, "class_id"], list(COUNTS), groups, replicates, seed, series=series)
    return _finish(with_universe(sums, classes), [*keys, "first"], "metric string, estimate double, replicates array<double>", finish)


#: In place of draws: the signs that a paired test turns.
FLIP = "flip"


class RunColumns:
    """Where the counts of a group lie in a row: samples of each class, then for each run and class its hits, then its predictions."""

    def __init__(self, runs: list[dict], n_classes: int):
        self.runs, self.n = runs, n_classes
        self.actual = np.arange(n_classes)

    def hits(self, run: int) -> np.ndarray:
        return self.n * (1 + run) + self.actual

    def predicted(self, run: int) -> np.ndarray:
        return self.n * (1 + len(self.runs) + run) + self.actual

    def of_runs(self, some: list[int]) -> np.ndarray:
        """Samples of each class, then hits and predictions of some runs."""
        return np.concatenate([self.actual, *[self.hits(i) for i in some], *[self.predicted(i) for i in some]])

    def metrics(self, x: np.ndarray, many: int) -> dict[str, np.ndarray]:
        """From the columns ``of_runs`` of that many runs as rows; runs along the last axis but one."""
        x = x.reshape(self.n * (1 + 2 * many), -1)
        tp, predicted = (x[self.n * (1 + i * many) : self.n * (1 + (i + 1) * many)].reshape(many, self.n, -1).transpose(1, 0, 2) for i in (0, 1))
        return rates_of(tp, np.repeat(x[: self.n, None], many, axis=1), predicted, self.n)


def class_ids(classes: DataFrame) -> np.ndarray:
    return np.array(sorted(r["class_id"] for r in classes.select("class_id").distinct().collect()), np.int64)


def _run_sums(samples: DataFrame, at: RunColumns, ids: np.ndarray, groups: DataFrame, replicates: int, seed, jobs: list[tuple], chunk: int) -> DataFrame:
    """``job, first, sums, total``, a row for each task, job and ``chunk`` replicates: sums over groups of the job's columns, and of all columns as they are.

    ``samples``: ``grp, true_id, preds``.  A job: its draws (null: those of ``seed`` alone; ``FLIP``: turned signs), its columns, and columns
    to take from them (null: none).  A group is shuffled as one row with its samples; a task counts the classes of a slice into one
    matrix and multiplies it by the weights of all replicates of each job.
    """
    if CHUNK % chunk:
        raise ValueError("chunk must divide CHUNK")
    n_runs, n_classes = len(at.runs), len(ids)
    own = list(dict.fromkeys(d for d, *_ in jobs if d != FLIP))
    whole = F.when(F.col("true_id").isNotNull() & (F.size("preds") == n_runs), F.col("preds").cast("array<tinyint>" if n_classes and 0 <= ids[0] and ids[-1] < 128 else "array<int>")).otherwise(F.raise_error(F.lit("every run must have a class")))
    packed = samples.groupBy("grp").agg(F.collect_list(F.struct(F.col("true_id").alias("t"), whole.alias("p"))).alias("e")).select(
        "grp", F.col("e.t").alias("true_id"), F.flatten("e.p").alias("preds"))
    placed, parts = _placed(groups, seed, own)
    rows = packed.join(placed, "grp", "left").withColumn("n", F.coalesce("n", F.raise_error(F.lit("a group has no stratum")).cast("long")))
    dealt = rows.select("part", "unit", "slice", "n", "pos", "bases", "token", "true_id", "preds").repartitionById(parts, "part").sortWithinPartitions("unit")

    def numbers(lists: pa.ListArray) -> np.ndarray:
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("every run must have a class")
        found = flat.to_numpy()
        if n_classes and np.array_equal(ids, np.arange(n_classes)) and found.min(initial=0) >= 0 and found.max(initial=0) < n_classes:
            return found.astype(np.int64)
        place = np.minimum(np.searchsorted(ids, found), n_classes - 1)
        if (ids[place] != found).any():
            raise ValueError("a class is not among the classes")
        return place

    def work(batches):
        sums = [np.zeros((replicates, len(plus))) for _, plus, _ in jobs]
        total, seen = np.zeros(n_classes * (1 + 2 * n_runs)), False
        for pieces in by_unit(batches):
            seen, t = True, pa.Table.from_batches(pieces)
            n, low, bases = t["n"][0].as_py(), t["slice"][0].as_py() * SLICE, t["bases"][0].as_py()
            width, lists, place = min(low + SLICE, n) - low, t["true_id"].combine_chunks(), t["pos"].to_numpy() - low
            group = np.repeat(place, lists.value_lengths().to_numpy())
            token = np.zeros(width, np.uint32)
            token[place] = t["token"].to_numpy().astype(np.uint32)
            true, pred = numbers(lists), numbers(t["preds"].combine_chunks()).reshape(-1, n_runs)
            cell = (group[:, None] * n_runs + np.arange(n_runs)) * n_classes + pred
            count = lambda x, many: np.bincount(x, minlength=width * many).reshape(width, many)
            counts = np.concatenate([count(group * n_classes + true, n_classes), *[count(x, n_runs * n_classes) for x in (cell[pred == true[:, None]], cell.ravel())]], axis=1)
            total += counts.sum(axis=0)
            for j, (d, plus, minus) in enumerate(jobs):
                m = counts[:, plus] if minus is None else counts[:, plus] - counts[:, minus]
                # Sums of whole numbers below 2^24 are exact in single precision, whatever their order.
                kind = np.float32 if np.abs(m).max(initial=0) * 4 * SLICE < 2**24 else float
                m = m.astype(kind)
                for first in range(0, replicates, CHUNK):
                    stop = min(replicates, first + CHUNK)
                    w = sign_matrix(token, first, stop, kind) if d == FLIP else weight_matrix(bases[own.index(d)], n, low, low + width, first, stop, kind)
                    if kind is np.float32 and w.sum(axis=1).max() > 4 * SLICE:
                        w = w.astype(float)
                    sums[j][first:stop] += w @ m.astype(w.dtype)
        for j in range(len(jobs)) if seen else ():
            for first in range(0, replicates, chunk):
                some = np.ascontiguousarray(sums[j][first : first + chunk].T)
                cells = [pa.array([j], pa.int32()), pa.array([first], pa.int32()), pa.array([some.ravel()], pa.list_(pa.float64())), pa.array([total], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["job", "first", "sums", "total"])

    return dealt.mapInArrow(work, "job int, first int, sums array<double>, total array<double>")


def _added(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Job, first replicate, sums and totals of rows of one job and chunk of ``_run_sums``."""
    added = np.zeros(len(pdf["sums"].iloc[0]))
    for x in pdf["sums"]:
        added += x
    return int(pdf["job"].iloc[0]), int(pdf["first"].iloc[0]), added, pdf["total"].sum()


def run_distribution(samples: DataFrame, runs: list[dict], groups: DataFrame, classes: DataFrame, replicates: int, seed=0, by_seed: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The result of ``classification_distribution`` where the predictions of a sample lie in one row: ``grp, true_id, preds``.

    ``preds`` has the predicted class of each of ``runs``, which name the keys (and ``seed`` for ``by_seed``); all classes must
    be among ``classes``.  Predictions are never rows of their own, and true classes are counted once for all runs of a
    draw (``_run_sums``).  ``chunk``: replicates in a row, a divisor of ``CHUNK``.
    """
    check_parameters(replicates, 0.5)
    ids = class_ids(classes)
    at, draw_of = RunColumns(runs, len(ids)), [str(r["seed"]) if by_seed else None for r in runs]
    own = sorted(set(draw_of), key=lambda d: d or "")
    mine = [[i for i, d in enumerate(draw_of) if d == o] for o in own]
    found = _run_sums(samples, at, ids, groups, replicates, seed, [(o, at.of_runs(of), None) for o, of in zip(own, mine)], chunk)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        job, first, added, total = _added(pdf)
        reps, point = at.metrics(added, len(mine[job])), at.metrics(total[at.of_runs(mine[job])], len(mine[job]))
        return pd.DataFrame([{"run": int(r), "metric": m, "first": first, "estimate": float(point[m][i, 0]), "replicates": reps[m][i]} for i, r in enumerate(mine[job]) for m in METRICS])

    found = found.groupBy("job", "first").applyInPandas(add, "run int, metric string, first int, estimate double, replicates array<double>")
    names = samples.sparkSession.createDataFrame([{"run": i, **r} for i, r in enumerate(runs)])
    return found.join(F.broadcast(names), "run").select(*list(runs[0]), "first", "metric", "estimate", "replicates")


def run_intervals(samples: DataFrame, runs: list[dict], groups: DataFrame, classes: DataFrame, replicates: int, level: float = 0.95, seed=0, by_seed: bool = False) -> DataFrame:
    """The result of ``classification_intervals`` from samples with the predictions of all ``runs``, as ``run_distribution`` takes them."""
    check_parameters(replicates, level)
    return distribution_intervals(run_distribution(samples, runs, groups, classes, replicates, seed, by_seed, chunk=500), list(runs[0]), level)


def distribution_intervals(distribution: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """``keys..., metric, estimate, ci_low, ci_high, n_bootstrap`` from a table of replicates, by exact percentiles with linear interpolation."""
    check_parameters(1, level)
    each = distribution.select(*keys, "metric", "estimate", F.explode("replicates").alias("value")).groupBy(*keys, "metric").agg(
        F.max("estimate").alias("estimate"), F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))).alias("ci"), F.count("*").alias("n_bootstrap"))
    return each.select(*keys, "metric", "estimate", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "n_bootstrap")


def classification_intervals(rows: DataFrame, groups: DataFrame, classes: DataFrame, keys: list[str], replicates: int, level: float = 0.95,
                             seed=0, by_seed: bool = False) -> DataFrame:
    """``keys..., metric, estimate, ci_low, ci_high, n_bootstrap`` of ``classification_distribution``."""
    check_parameters(replicates, level)
    return distribution_intervals(classification_distribution(rows, groups, classes, keys, replicates, seed, by_seed), keys, level)


def finite(value: str):
    """The value, or a failed query where it is null or not finite."""
    x = F.col(value).cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(good, x).otherwise(F.raise_error(F.lit(f"{value} must be finite")).cast("double"))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


#: Fixed value: eight times the distance from 1 to the next double.  A null value this close below the observed one counts as extreme, a difference this small as none.
SLACK = 8 * 2.220446049250313e-16
MEAN = "estimate double, ci_low double, ci_high double, n_bootstrap long"
TEST = "difference double, ci_low double, ci_high double, n_bootstrap long, probability_a_better double, p_value double"


def mean_result(sums: Sums, level: float) -> list[dict]:
    (s, s_total), (c, c_total) = sums.of("draw", "s"), sums.of("draw", "c")
    return [{"estimate": s_total / c_total, **percentiles(ratio(s, c), level)}]


def tested(reps: np.ndarray, null: np.ndarray, seen: float, level: float) -> dict:
    return {"difference": seen, **percentiles(reps, level), "probability_a_better": float((reps > SLACK).mean()), "p_value": p_value(null, seen)}


def mean_test_result(sums: Sums, level: float) -> list[dict]:
    (s, s_total), (c, c_total) = sums.of("draw", "s"), sums.of("draw", "c")
    return [tested(ratio(s, c), (s_total - 2 * sums.of("flip", "s")[0]) / c_total, s_total / c_total, level)]


def class_result(sums: Sums, universe: int, level: float) -> list[dict]:
    both = [sums.of("draw", c) for c in COUNTS]
    reps, point = rates_of(*[x for x, _ in both], universe), rates_of(*[t for _, t in both], universe)
    return [{"metric": m, "estimate": float(point[m]), **percentiles(reps[m], level)} for m in METRICS]


def class_test_result(sums: Sums, universe: int, level: float) -> list[dict]:
    drawn, turned = ({n: sums.of(kind, n) for n in SIDES} for kind in ("draw", "flip"))
    of = lambda get, side: rates_of(*[get(f"{c}_{side}") for c in COUNTS], universe)
    moved = {c: turned[f"{c}_b"][0] - turned[f"{c}_a"][0] for c in COUNTS}
    total = lambda n: drawn[n][1]
    null = lambda n: total(n)[:, None] + (moved[n[:-2]] if n[-1] == "a" else -moved[n[:-2]])
    seen, reps, nulls = ([of(get, side) for side in "ab"] for get in (total, lambda n: drawn[n][0], null))
    return [{"metric": m, **tested(reps[0][m] - reps[1][m], nulls[0][m] - nulls[1][m], float(seen[0][m] - seen[1][m]), level)} for m in METRICS]


SIDES = [f"{c}_{side}" for side in "ab" for c in COUNTS]


def group_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """Sum ``s`` and count ``c`` of ``value`` in each group."""
    return values.groupBy(*keys, "grp").agg(F.sum(finite("value")).alias("s"), F.count("*").alias("c"))


def group_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum ``s`` of ``a`` - ``b`` and count ``c`` in each group."""
    return pairs.groupBy(*keys, "grp").agg(F.sum(finite("a") - finite("b")).alias("s"), F.count("*").alias("c"))


def group_class_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both sides for each group and class: ``keys..., grp, class_id`` and ``SIDES``."""
    both = pairs.select(*keys, "grp", "true_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_id").alias("pred_id")),
                                                                  F.struct(F.lit("b").alias("side"), F.col("b_id").alias("pred_id")))).alias("s"))
    counts = group_class_counts(both.select(*keys, "grp", "true_id", "s.side", "s.pred_id"), [*keys, "side"])
    return counts.groupBy(*keys, "grp", "class_id").agg(*[F.coalesce(F.sum(F.when(F.col("side") == n[-1], F.col(n[:-2]))), F.lit(0)).alias(n) for n in SIDES])


def mean_intervals(values: DataFrame, groups: DataFrame, keys: list[str], replicates: int, level: float = 0.95, seed=0) -> DataFrame:
    """Group bootstrap of the mean of ``value`` over all rows: ``keys..., estimate, ci_low, ci_high, n_bootstrap``."""
    check_parameters(replicates, level)
    return _finish(resampled_sums(group_values(values, keys), keys, ["s", "c"], groups, replicates, seed, series=values.select(*keys).distinct()), keys, MEAN, lambda sums, row: mean_result(sums, level))


def paired_mean_test(pairs: DataFrame, groups: DataFrame, keys: list[str], replicates: int, level: float = 0.95, seed=0, series: DataFrame | None = None) -> DataFrame:
    """Mean of a - b: ``difference, ci_low, ci_high, probability_a_better, p_value, n_bootstrap``.

    ``pairs``: ``keys..., grp, a, b``.  The p-value counts group-wise sign flips at least as
    extreme as the observed difference, (extreme + 1) / (replicates + 1).  ``series``: the values of ``keys`` that may
    occur; where they are given, sums of groups need not be written first.
    """
    check_parameters(replicates, level)
    sums = resampled_sums(group_pairs(pairs, keys), keys, ["s", "c"], groups, replicates, seed, ("draw", "flip"), series)
    return _finish(sums, keys, TEST, lambda sums, row: mean_test_result(sums, level))


def paired_class_test(pairs: DataFrame, groups: DataFrame, classes: DataFrame, keys: list[str], replicates: int, level: float = 0.95, seed=0, series: DataFrame | None = None) -> DataFrame:
    """Differences of classification metrics of two systems that share draws.

    ``pairs``: ``keys..., sample, grp, true_id, a_id, b_id``.  Under the null the counts of a
    group are exchanged between the systems.  One row per key and metric, as ``paired_mean_test``, whose ``series`` it takes.
    """
    check_parameters(replicates, level)
    if series is not None:
        series = series.select(*keys).crossJoin(F.broadcast(classes.select("class_id").distinct()))
    sums = resampled_sums(group_class_pairs(pairs, keys), [*keys, "class_id"], SIDES, groups, replicates, seed, ("draw", "flip"), series)
    return _finish(with_universe(sums, classes), keys, f"metric string, {TEST}", lambda sums, row: class_test_result(sums, int(row["universe"]), level))


KINDS = ("mean", "mean difference", "classification", "classification difference")


def statistic(kind: str, cohort: str, rows: DataFrame, keys: list[str], universe: int = 0, own_draws: str | None = None, family: list[str] | None = None) -> DataFrame:
    """Group statistics of one kind as rows of the long table that ``statistics_run`` takes.

    ``kind``: ``mean`` (``keys..., grp, value``), ``mean difference`` (``keys..., grp, a, b``), ``classification`` (``keys...,
    grp, true_id, pred_id``) or ``classification difference`` (``keys..., grp, true_id, a_id, b_id``).  ``universe``: number of
    classes.  ``own_draws``: a key of which each value has draws of its own.  ``family``: keys within which tests are corrected.
    """
    per = (group_values, group_pairs, group_class_counts, group_class_pairs)[KINDS.index(kind)](rows, keys)
    names = {"mean": ["s", "c"], "mean difference": ["s", "c"], "classification": list(COUNTS), "classification difference": SIDES}[kind]
    suffix = F.concat(F.lit("|"), F.col("class_id").cast("string")) if "classification" in kind else F.lit("")
    cells = F.explode(F.array(*[F.struct(F.concat(F.lit(n), suffix).alias("cell"), F.col(n).cast("double").alias("value")) for n in names]))
    return per.withColumn("v", cells).select(
        F.lit(kind).alias("statistic"), F.lit(cohort).alias("cohort"), (F.col(own_draws).cast("string") if own_draws else F.lit(None).cast("string")).alias("draw"),
        F.to_json(F.struct(*keys)).alias("series"), F.to_json(F.struct(*family)).alias("family") if family else F.lit(None).cast("string").alias("family"),
        F.lit(universe).alias("universe"), F.lit("difference" in kind).alias("flips"), "v.cell", "grp", "v.value")


def run_statistics(samples: DataFrame, runs: list[dict], groups: DataFrame, classes: DataFrame, cohort: str, families: list[tuple], replicates: int, level: float = 0.95, seed=0, metrics: bool = True) -> DataFrame:
    """Statistics of one cohort whose samples have the predictions of all ``runs`` in one row (``grp, true_id, preds``), as ``statistics_run`` takes for ``more``.

    ``families``: what the runs of a pair share besides ``seed``, what differs, its reference and its alternative.  Mean differences of every
    family; with ``metrics`` classification of each run, with draws of its seed, and classification differences of the first family.  All of it follows
    from the counts of classes by run of a group, so each draw of a slice is made once and multiplies one matrix.
    """
    check_parameters(replicates, level)
    ids = class_ids(classes)
    at, place = RunColumns(runs, len(ids)), {tuple(sorted(r.items())): i for i, r in enumerate(runs)}
    pairs = []  # family, place in it, the column shared, run a (alternative), run b (reference)
    for f, (held, varied, reference, alternative) in enumerate(families):
        for i, r in enumerate(runs):
            other = place.get(tuple(sorted({**r, varied: reference}.items())))
            if r[varied] == alternative and other is not None:
                pairs.append((f, held, i, other))
    of_seed = {s: [i for i, r in enumerate(runs) if r["seed"] == s] for s in sorted({r["seed"] for r in runs})} if metrics else {}
    every = list(range(len(runs)))
    shared = at.of_runs(every) if metrics else np.concatenate([at.actual, *[at.hits(i) for i in every]])
    # Of the counts whose signs are turned only differences of the two sides are asked for.
    kinds = [[at.hits, at.predicted] if metrics and f == 0 else [at.hits] for f, *_ in pairs]
    turned = [np.concatenate([count(x) for (_, _, *ab), many in zip(pairs, kinds) for count in many for x in (ab[side],)] or [at.actual[:0]]) for side in (0, 1)]
    jobs = [*[(str(s), at.of_runs(of), None) for s, of in of_seed.items()], (None, shared, None), (FLIP, *turned)]
    n = len(ids)

    def text(r: dict, *keys: str) -> str:
        return json.dumps({k: r[k] for k in keys}, separators=(",", ":"), ensure_ascii=False)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        job, first, added, total = _added(pdf)
        x, out = added.reshape(len(jobs[job][1]), -1), []

        def row(statistic: str, r: dict, held: str | None, metric: str | None, role: str, seen: float, values: np.ndarray) -> None:
            keys = [held, "seed"] if held else [k for k in r if k != "task"]
            out.append((statistic, text(r, *keys), text(r, held) if held else None, metric, role, first, float(seen), values))

        if job < len(of_seed):
            some = list(of_seed.values())[job]
            reps, point = at.metrics(added, len(some)), at.metrics(total[at.of_runs(some)], len(some))
            for i, r in enumerate(some):
                for m in METRICS:
                    row("classification", runs[r], None, m, "reps", point[m][i, 0], reps[m][i])
            return pd.DataFrame(out, columns=COLUMNS)
        flip, c, done = jobs[job][0] == FLIP, total[at.actual].sum(), 0
        whole = at.metrics(total, len(runs)) if metrics else None
        reps = at.metrics(added, len(runs)) if metrics and not flip else None
        for (f, held, a, b), many in zip(pairs, kinds):
            seen = (total[at.hits(a)] - total[at.hits(b)]).sum()
            if flip:
                moved = x[done : done + n * len(many)]
                done += n * len(many)
                row("mean difference", runs[a], held, None, "null", seen / c, (seen - 2 * moved[:n].sum(axis=0)) / c)
            else:
                row("mean difference", runs[a], held, None, "reps", seen / c, ratio((x[at.hits(a)] - x[at.hits(b)]).sum(axis=0), x[at.actual].sum(axis=0)))
            if len(many) < 2:
                continue
            if flip:  # what leaves side a comes to side b
                hits, predicted, actual = moved[:n], moved[n:], np.repeat(total[at.actual][:, None], x.shape[1], axis=1)
                sides = [rates_of(total[at.hits(i)][:, None] - sign * hits, actual, total[at.predicted(i)][:, None] - sign * predicted, n) for i, sign in ((a, 1), (b, -1))]
            for m in METRICS:
                values = sides[0][m] - sides[1][m] if flip else reps[m][a] - reps[m][b]
                row("classification difference", runs[a], held, m, "null" if flip else "reps", whole[m][a, 0] - whole[m][b, 0], values)
        return pd.DataFrame(out, columns=COLUMNS)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        reps, null = (pdf[pdf["role"] == role].sort_values("first")["values"].to_list() for role in ("reps", "null"))
        found = tested(np.concatenate(reps), np.concatenate(null), one["seen"], level) if null else percentiles(np.concatenate(reps), level)
        return pd.DataFrame([{"statistic": one["statistic"], "series": one["series"], "family": one["family"], "metric": one["metric"], "value": one["seen"], **found}], columns=[c.split()[0] for c in FOUND.split(", ")])

    keys = ["statistic", "series", "family", "metric"]
    parts = _run_sums(samples, at, ids, groups, replicates, seed, jobs, 500 if CHUNK % 500 == 0 else CHUNK).groupBy("job", "first").applyInPandas(
        add, "statistic string, series string, family string, metric string, role string, first int, seen double, values array<double>")
    return parts.groupBy(*keys).applyInPandas(finish, FOUND).withColumn("cohort", F.lit(cohort))


COLUMNS = ["statistic", "series", "family", "metric", "role", "first", "seen", "values"]
FOUND = "statistic string, series string, family string, metric string, value double, ci_low double, ci_high double, n_bootstrap long, probability_a_better double, p_value double"


def statistics_run(long: DataFrame, groups: DataFrame, replicates: int, level: float = 0.95, seed=0, more: DataFrame | None = None) -> DataFrame:
    """All statistics of a result set with the weights of each slice of groups made once for everything that shares its draws.

    ``long``: union of ``statistic`` tables, written already, as it is read twice; ``groups``: ``cohort, grp, stratum``.  Rows ``statistic, cohort, series, metric, value,
    ci_low, ci_high, n_bootstrap, probability_a_better, p_value, p_holm``; what a statistic lacks is null; p-values are
    corrected within statistic, cohort, metric and family.  The results equal those of the functions for one statistic.
    ``more``: results of ``run_statistics``, of other cohorts.
    """
    check_parameters(replicates, level)
    keys = ["statistic", "cohort", "series", "family", "universe"]
    sums = resampled_sums(long, [*keys, "draw", "flips", "cell"], ["value"], groups, replicates, seed, ("draw", "flip"), series=long)

    def finish(sums: Sums, row) -> list[dict]:
        kind, universe = row["statistic"], int(row["universe"])
        if kind == "mean":
            out = mean_result(sums, level)
        elif kind == "mean difference":
            out = mean_test_result(sums, level)
        else:
            out = class_result(sums, universe, level) if kind == "classification" else class_test_result(sums, universe, level)
        return [{"metric": None, **r, "value": r.get("estimate", r.get("difference"))} for r in out]

    columns = "metric string, value double, ci_low double, ci_high double, n_bootstrap long, probability_a_better double, p_value double"
    done = _finish(sums, keys, columns, finish)
    if more is not None:
        done = materialise(done.drop("universe").unionByName(more), "statistics")
    tests, rest = done.where("p_value is not null"), done.where("p_value is null")
    corrected = holm(tests, "p_value", ["statistic", "cohort", "metric", "family"])
    order = ["statistic", "cohort", "series", "metric", "value", "ci_low", "ci_high", "n_bootstrap", "probability_a_better", "p_value", "p_holm"]
    return corrected.select(*order).unionByName(rest.withColumn("p_holm", F.lit(None).cast("double")).select(*order))
