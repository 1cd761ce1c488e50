"""Near duplicates by ProbMinHash.

A text is the weighted set of its runs of five words, a run's weight being how often it occurs.
Each element has a Poisson process, seeded by its hash, whose rate is its weight; every arrival
falls on a random component of the signature, and a component keeps the element that arrives
first.  An element stops as soon as its next arrival is later than all components (early
termination).  Two signatures agree in a component with probability equal to the probability
Jaccard similarity of the texts.

Texts with equal weighted sets are one *node* from the start.  Bands of the signature propose
pairs, every proposed pair is verified by the exact probability Jaccard of the two texts, and
classes are the connected components of verified pairs.

Two levels keep large groups from becoming all their pairs.  First, 32 bands of 4 components: in
each bucket the members are verified against one leader.  Nodes in buckets whose members still
have different labels get a second signature of 4096 components: 80 bands of 8, and one bit of
each component, hashed from its element and its place.  A bucket of the second level is cut into
slices of about 500 nodes; a task gets two slices, compares the packed bits of nodes with different
labels by exclusive or, and lets a pair pass once, in the first band it shares, and only if its
estimate is not 5.2 standard errors below the bound.  So no link is lost to the choice of leaders,
and what leaves the task is one row for each pair near the bound.  A pair at similarity 0.8 is lost by the
first bands in one case of 2 × 10^7, by the second in one of 2 × 10^6, by the bits in one of 10^7;
nearer pairs less often.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import documents, free_name, materialise
from .textgrid import U64, Grid, clean, mix, slices, windows

WORDS, SIMILARITY = 5, 0.8
#: Components (a power of two), bands and rows of a band, at the first and at the second level.
LEVELS = ((128, 32, 4), (4096, 80, 8))
#: Standard errors below the bound at which two signatures of the second level are told apart.
SURE = 5.2
#: Nodes in a slice of a bucket of the second level, and pairs of nodes that a task compares at once.
SLICE, AT_ONCE = 512, 1 << 15


def shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text: document, element hash, weight; ordered by document.

    Words are lower-cased.  A text of fewer than ``size`` words is one element, a text without words has none.
    """
    g = Grid([t.lower() for t in texts])
    words = g.hashes()
    run, at = windows(words, g.doc, size)
    doc, parts = [g.doc[at]], [run]
    for short in range(1, size):
        run, at = windows(words, g.doc, short)
        whole = g.words[g.doc[at]] == short
        doc.append(g.doc[at][whole])
        parts.append(mix(run[whole] + U64(short)))
    d, h = np.concatenate(doc), np.concatenate(parts)
    both = mix(h ^ (d.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(both)
    ordered = both[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(order)])))
    some = order[first]
    back = np.argsort(d[some], kind="stable")
    return d[some][back], h[some][back], count[back].astype(np.int64)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n × m element hashes; 0 for documents without elements). ``m``: a power of two."""
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, U64)
    limit = np.full(n, np.inf)
    d, h, w, t = doc, element, weight.astype(float), np.zeros(len(doc))
    arrival, block = 1, 1
    while len(d):
        count = np.arange(arrival, arrival + block, dtype=U64)
        draw = mix((h[:, None] + count[None, :] * U64(0x9E3779B97F4A7C15)).ravel())
        gap = -np.log(((draw >> U64(12)).astype(float) + 0.5) * 2.0**-52).reshape(len(d), block) / w[:, None]
        time = t[:, None] + np.cumsum(gap, axis=1)
        slot = (draw & U64(m - 1)).astype(np.int64).reshape(len(d), block) + d[:, None] * m
        ok = time < limit[d][:, None]
        flat_t, flat_s = time[ok], slot[ok]
        owner = np.broadcast_to(h[:, None], time.shape)[ok]
        np.minimum.at(best, flat_s, flat_t)
        won = best[flat_s] == flat_t
        who[flat_s[won]] = owner[won]
        touched = np.unique(d)
        limit[touched] = best.reshape(n, m)[touched].max(axis=1)
        t = time[:, -1]
        live = t < limit[d]
        d, h, w, t = d[live], h[live], w[live], t[live]
        arrival += block
        block = max(1, min(block * 2, 1024, 1_000_000 // max(len(d), 1))) if arrival > 2 else 1
    return who.reshape(n, m)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def sketch(texts: list[str], size: int = WORDS, m: int = LEVELS[0][0], count: int = LEVELS[0][1], rows: int = LEVELS[0][2]) -> pd.DataFrame:
    """Per text: ``k1``, ``k2`` (hash of the weighted set), ``bands`` (hash of each band; none without words), ``bits`` (one of each component)."""
    n = len(texts)
    doc, element, weight = shingles(texts, size)
    keys = []
    for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        part = mix(element * U64(salt) + weight.astype(U64))
        total = np.zeros(n, U64)
        np.add.at(total, doc, part)
        keys.append(as_long(total))
    whole = signatures(doc, element, weight, n, m)
    sig = whole[:, : count * rows].reshape(n, count, rows)
    rolled = np.zeros((n, count), U64)
    for k in range(rows):
        rolled = rolled * U64(0x9FB21C651E98DF25) + sig[:, :, k]
    bands = as_long(mix(rolled * U64(0xD6E8FEB86659FD93) + np.arange(count, dtype=U64)))
    # A bit of the element and the component: bits of the element alone would be equal in all components that hold it.
    bit = mix(whole + np.arange(m, dtype=U64) * U64(0x9E6C63D0876A9A47)) >> U64(63)
    bits = np.packbits(bit.astype(np.uint8), axis=1)
    empty = np.bincount(doc, minlength=n) == 0
    return pd.DataFrame({"k1": keys[0], "k2": keys[1], "bands": [bands[i][:0] if empty[i] else bands[i] for i in range(n)], "bits": [x.tobytes() for x in bits]})


def probability_jaccard(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given as ascending distinct hashes and weights."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = aw
    y[np.searchsorted(every, b)] = bw
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(-ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    above = np.cumsum(xs)
    below = ys.sum() - np.cumsum(ys)
    c = np.flatnonzero(common[order])
    last = np.searchsorted(-r, -r[c], "right") - 1  # elements whose ratio is at least this one's
    return float((1.0 / (above[last] / xs[c] + below[last] / ys[c])).sum())


def similarities(texts: list[str], left: np.ndarray, right: np.ndarray, similarity: float, size: int) -> np.ndarray:
    """Exact probability Jaccard of the pairs ``texts[left[i]], texts[right[i]]``; 0 where it is surely below ``similarity``.

    Common elements are found for all pairs by one sort.  Where no element repeats it is the plain
    Jaccard; elsewhere the overlap of the two distributions bounds it from above, and pairs beyond
    that bound are evaluated one by one.
    """
    doc, element, weight = shingles(texts, size)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = np.diff(ends)
    total = np.bincount(doc, weights=weight, minlength=len(texts))
    n = len(left)

    def members(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.repeat(np.arange(n), count[side])
        first = np.concatenate(([0], np.cumsum(count[side])[:-1])) if n else np.zeros(0, np.int64)
        return pair, np.arange(len(pair)) - first[pair] + ends[side][pair]

    (pair_a, at_a), (pair_b, at_b) = members(left), members(right)
    pair, at = np.concatenate((pair_a, pair_b)), np.concatenate((at_a, at_b))
    key = mix(element[at] ^ (pair.astype(U64) * U64(0x9FB21C651E98DF25)))
    order = np.argsort(key, kind="stable")  # of equal keys, the left text's comes first
    ordered = key[order]
    twin = np.flatnonzero(ordered[1:] == ordered[:-1])
    x, y = order[twin], order[twin + 1]
    share_x, share_y = weight[at[x]] / total[left[pair[x]]], weight[at[y]] / total[right[pair[x]]]
    common = np.bincount(pair[x], minlength=n)
    overlap = np.bincount(pair[x], weights=np.minimum(share_x, share_y), minlength=n)
    na, nb = count[left], count[right]
    plain = (total[left] == na) & (total[right] == nb)
    out = np.where(na + nb > 0, common / np.maximum(na + nb - common, 1), 1.0)
    out[~plain] = 0.0
    for i in np.flatnonzero(~plain & (overlap >= similarity - 1e-9)).tolist():
        sets = []
        for t in (left[i], right[i]):
            e, w = element[ends[t] : ends[t + 1]], weight[ends[t] : ends[t + 1]]
            o = np.argsort(e)
            sets += [e[o], w[o]]
        out[i] = probability_jaccard(*sets)
    return out


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs ``a, b`` of node ids with their exact ``similarity`` appended, those that reach the bound.

    ``texts``: ``id, text``.  Both joins are plain shuffles on the id, which Spark can split where one
    leader has very many members.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cut in slices([len(x) + len(y) for x, y in zip(batch["a_text"], batch["b_text"])], 2_000_000):
                part = batch.iloc[cut]
                code, distinct = pd.factorize(pd.concat([part["a_text"], part["b_text"]], ignore_index=True))
                like = similarities(list(distinct), code[: len(part)], code[len(part) :], similarity, size)
                ok = like >= similarity - 1e-12
                yield pd.DataFrame({"a": part["a"].to_numpy()[ok], "b": part["b"].to_numpy()[ok], "similarity": like[ok]})

    return both.mapInPandas(exact, "a long, b long, similarity double")


def star(links: DataFrame, larger: bool) -> DataFrame:
    """Links of each id's larger (or else smaller) neighbours to the smallest id it sees, as ``a > b``; components stay as they are.

    Minima are pre-aggregated and then joined, so a hub is never collected.
    """
    both = links.union(links.select("b", "a")) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if larger:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, label`` (smallest id of its component) for every id of the edges ``a, b``.

    Alternating stars, until every id has one smaller neighbour, which has none.  Each round is a written table.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    for _ in range(most_rounds):
        parents = now.groupBy("a").agg(F.count("*").alias("n"))
        tops = now.select(F.col("b").alias("a")).distinct()
        if parents.join(tops, "a", "left_semi").union(parents.where("n > 1").select("a", "n")).isEmpty():
            break
        now = materialise(star(materialise(star(now, True), "cc-edges"), False), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def first_labels(links: DataFrame) -> DataFrame:
    """``id, label`` after one round of stars, followed for four steps: equal labels mean one component, which may still have several."""
    step = star(materialise(star(links, True), "near-stars"), False).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    for _ in range(2):
        further = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = step.join(further, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return step


def labelled(rows: DataFrame, labels: DataFrame, column: str = "id", out: str = "label") -> DataFrame:
    """``rows`` with the label of ``column``, which is the id itself where it has none."""
    named = labels.select(F.col("id").alias(column), F.col("label").alias(out))
    return rows.join(named, column, "left").withColumn(out, F.coalesce(out, column))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels instead of ids."""
    both = labelled(labelled(edges.select("a", "b"), labels, "a", "la"), labels, "b", "lb")
    return both.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()


def row_id(key, text, kind: T.DataType = T.LongType()):
    """A long for each row: its id, where that is an integer, else a hash of it; of rows without one, a negative hash of their text."""
    named = key.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(key.cast("string")).bitwiseAND(F.lit((1 << 63) - 1))
    return F.coalesce(F.when(key.isNotNull(), named), -1 - F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 62)))


def sketched(rows: DataFrame, size: int, m: int, count: int, band_rows: int) -> DataFrame:
    """``id, text`` to ``id, k1, k2, bands, bits``.  Write it before exploding ``bands``: the filter that
    Spark infers for the explosion would else run the sketches once more, below any join.
    """

    @F.pandas_udf("k1 long, k2 long, bands array<long>, bits binary")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            cuts = slices([len(t) + 4 * m for t in texts], 4_000_000)
            parts = [sketch(texts[cut], size, m, count, band_rows) for cut in cuts]
            yield pd.concat(parts or [sketch([], size, m, count, band_rows)], ignore_index=True)

    return rows.select("id", sketches("text").alias("s")).select("id", "s.*")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to as many tasks as shuffles have: Spark would else size the tasks by bytes, and few bytes can be much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """``id, class_id`` per distinct id: the smallest id of the class of near duplicates that the row belongs to.

    Ids may be of any type and keep it.  Null texts count as empty; all texts without words are
    copies of one another.  Rows without id are rows of their own, one for each distinct text: their
    ``id`` is null, and their class is named by its smallest id, null where it has none.  Repeated
    rows are in one class; rows that share an id but not a text are linked through that id.
    """
    kind = docs.schema[key].dataType
    classes, nameless = _classes(docs, key, text, similarity, size)
    if isinstance(kind, T.IntegralType) and not nameless:
        return classes.select(F.col("id").cast(kind).alias("id"), F.col("class_id").cast(kind).alias("class_id"))
    rows = docs.select(row_id(F.col(key), F.col(text), kind).alias("node"), F.col(key).alias("id")).distinct()
    named = rows.join(classes.withColumnRenamed("id", "node"), "node")
    smallest = named.groupBy("class_id").agg(F.min("id").alias("name"))
    return named.join(smallest, "class_id").select("id", F.col("name").alias("class_id"))


def _classes(docs: DataFrame, key: str, text: str, similarity: float, size: int) -> tuple[DataFrame, int]:
    """``id, class_id`` by ``row_id``, and how many rows have no id."""
    watch = Observation()
    base = docs.select(row_id(F.col(key), F.col(text), docs.schema[key].dataType).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    counted = docs.observe(watch, F.sum(F.col(key).isNull().cast("long")).alias("nameless"))
    counted = counted.select(row_id(F.col(key), F.col(text), docs.schema[key].dataType).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    first = materialise(sketched(counted, size, *LEVELS[0]).drop("bits"), "near-sketches")
    nodes = materialise(first.groupBy("k1", "k2").agg(F.min("id").alias("node")), "near-nodes")  # written, so that the join can split a large group of copies
    member = materialise(first.join(nodes, ["k1", "k2"]).select(
        "id", "node", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")), "near-members")
    # Ids whose rows hold different texts tie the nodes of these texts.
    same_id = member.join(member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z"), "id").select("a", F.col("node").alias("b"))

    banded = member.where("bands is not null").select("id", F.posexplode("bands").alias("band", "bucket"))
    heads = banded.groupBy("band", "bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    shared = materialise(banded.join(heads, ["band", "bucket"]), "near-shared")
    # Only texts that share a bucket are needed from here on; the table is written, so that no later stage shuffles the others.
    texts = materialise(base.join(shared.select("id").distinct(), "id", "left_semi"), "near-texts")
    leaders = shared.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    found = materialise(verify(leaders, texts, similarity, size).select("a", "b"), "near-found")
    labels = materialise(first_labels(found), "near-labels")

    mixed = labelled(shared.select("id", "band", "bucket"), labels)
    heads = mixed.groupBy("band", "bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")
    unclear = mixed.join(heads.select("band", "bucket"), ["band", "bucket"], "left_semi").select("id", "label").distinct()
    long = materialise(sketched_with_label(texts.join(unclear, "id"), size), "near-long")
    more = materialise(verify(materialise(apart(long, most_unlike(similarity)), "near-pairs"), texts, similarity, size).select("a", "b"), "near-found")
    merged = components(relabelled(found.union(more).union(same_id), labels))
    named = labelled(labelled(member.select("id", "node"), labels, "node", "label"), merged, "label", "class_id")
    return named.groupBy("id").agg(F.min("class_id").alias("class_id")), watch.get["nameless"] or 0


def sketched_with_label(rows: DataFrame, size: int) -> DataFrame:
    """``id, text, label`` to ``id, label, bands, bits`` of the second level."""
    rows = spread(rows, "id")
    longs = sketched(rows.withColumn("id", F.struct("id", "label")), size, *LEVELS[1])
    return longs.select("id.id", "id.label", "bands", "bits")


def most_unlike(similarity: float, m: int = LEVELS[1][0]) -> float:
    """Unequal bits beyond which two texts count as less similar than ``similarity``."""
    differ = (1 - similarity) / 2  # share of unequal bits at the bound: half of the unequal components
    return m * differ + SURE * (m * differ * (1 - differ)) ** 0.5


def unlike(bits: np.ndarray, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which pairs of rows of ``bits`` differ in at most ``most`` places.  A quarter of the bits rules out most others."""
    m = bits.shape[1] * 64
    part = bits.shape[1] // 4
    loose = most / m * part * 64 + SURE * (most / m * (1 - most / m) * part * 64) ** 0.5
    some = np.flatnonzero(np.bitwise_count(bits[a, :part] ^ bits[b, :part]).sum(axis=1, dtype=np.int64) <= loose)
    return some[np.bitwise_count(bits[a[some]] ^ bits[b[some]]).sum(axis=1, dtype=np.int64) <= most]


def pairs_in_runs(size: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside consecutive runs of these sizes, about ``at_once`` (or one row's) at a time."""
    end = np.repeat(np.cumsum(size), size)  # where each row's run ends
    row = np.arange(len(end))
    partners = end - row - 1
    upto = np.cumsum(partners)
    begin = 0
    while begin < len(row):
        done = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, done + at_once, "right")))
        a = np.repeat(row[begin:stop], partners[begin:stop])
        first = np.concatenate(([0], np.cumsum(partners[begin:stop])[:-1]))
        yield a, a + 1 + np.arange(len(a)) - np.repeat(first, partners[begin:stop])
        begin = stop


def near_pairs(block: np.ndarray, band: np.ndarray, slot: np.ndarray, inner: np.ndarray, ids: np.ndarray, label: np.ndarray,
               names: np.ndarray, bits: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids in one block (rows of a block lie together) with different labels and near bits, in the first band they share.

    ``inner``: the block holds one slice; else only pairs from different slices (``slot``) count.
    """
    edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((edge, [len(block)])))
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pairs_in_runs(size, AT_ONCE):
        some = (label[a] != label[b]) & (inner[a] | (slot[a] != slot[b]))
        a, b = a[some], b[some]
        some = unlike(bits, a, b, most)
        a, b = a[some], b[some]
        some = (names[a] == names[b]).argmax(axis=1) == band[a]
        low.append(np.minimum(ids[a[some]], ids[b[some]]))
        high.append(np.maximum(ids[a[some]], ids[b[some]]))
    return np.concatenate(low), np.concatenate(high)


def apart(long: DataFrame, most_bits: float, slice_rows: int = SLICE) -> DataFrame:
    """Pairs ``a < b`` of nodes (``id, label, bands, bits``) that share a bucket, have different labels and differ in at most ``most_bits`` bits.

    Members of a bucket fall into slices by a hash of their id, those with its commonest label into
    slices of their own, which are never compared with one another.  Every other pair of slices is
    a block, and a block is a few hundred rows, however large the bucket is.  Each pair passes once.
    """
    long = long.dropDuplicates(["id", "bits"])
    banded = long.select("id", "label", F.posexplode("bands").alias("band", "bucket"))
    sizes = banded.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"))
    heads = (sizes.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("main"))
             .where("labels > 1")
             .select("band", "bucket", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / slice_rows).cast("int").alias("tame"),
                     F.ceil((F.col("n") - F.col("main.n")) / slice_rows).cast("int").alias("wild")))
    rows = banded.join(heads, ["band", "bucket"])
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("slot", F.when(F.col("label") == F.col("main"), F.col("wild") + of(F.col("tame"))).otherwise(of(F.col("wild"))))
    others = F.when(F.col("label") == F.col("main"), F.sequence(F.lit(0), F.col("wild") - 1)).otherwise(F.sequence(F.lit(0), F.col("wild") + F.col("tame") - 1))
    rows = rows.withColumn("other", F.explode(others)).select(
        "id", "label", "band", "slot", (F.col("slot") == F.col("other")).alias("inner"),
        F.xxhash64("band", "bucket", F.least("slot", "other"), F.greatest("slot", "other")).alias("block"))
    held = rows.join(long.select("id", "bands", "bits"), "id").repartition("block").sortWithinPartitions("block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def paired(rows: pd.DataFrame) -> pd.DataFrame:
            names = np.stack([np.asarray(x, np.int64) for x in rows["bands"]])
            bits = np.frombuffer(b"".join(rows["bits"]), U64).reshape(len(rows), -1)
            plain = [rows[c].to_numpy() for c in ("block", "band", "slot", "inner", "id", "label")]
            a, b = near_pairs(*plain, names, bits, most_bits)
            return pd.DataFrame({"a": a, "b": b})

        rest = None
        for batch in batches:  # a block may run on into the next batch
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = int(np.searchsorted(batch["block"].to_numpy(), batch["block"].iloc[-1])) if len(batch) else 0
            if cut:
                yield paired(batch.iloc[:cut])
            rest = batch.iloc[cut:]
        if rest is not None and len(rest):
            yield paired(rest)

    return held.mapInPandas(compare, "a long, b long")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, the one that stays in each class, and the number of rows in it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_classes(docs).select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``; of rows that share the kept id, one stays."""
    tag = free_name(docs, "id_of_row")
    kept = _classes(docs, key, text, SIMILARITY, WORDS)[0].where("id = class_id").select(F.col("id").alias(tag))
    return (docs.withColumn(tag, row_id(F.col(key), F.col(text), docs.schema[key].dataType)).join(kept, tag, "left_semi")
            .dropDuplicates([tag]).select(*docs.columns))
