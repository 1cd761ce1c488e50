import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foldwright.llm import position_crc, target_draw as td

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, percent=5):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(x)) for side in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets))))
    out = []
    for key, x in rows:
        g = grams(x)
        weight = sum(gain(bucket(f)) for f in g)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [i for i, (_, x) in enumerate(rows) if len(words_of(x)) >= 20]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for place, i in enumerate(able[: percent * len(able) // 100]):
        out[i][4] = place + 1
    return out


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 400_000).astype(np.uint8)
    size = np.concatenate((rng.integers(1, 66, 4000), rng.integers(60, 2000, 200), [64, 65, 128, 129, 70_000, 300_000]))
    start = rng.integers(0, 90_000, len(size))
    got = position_crc.crc32(buf, start, start + size)
    raw = buf.tobytes()
    assert got.tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
    assert position_crc.crc32(buf, start[:0], start[:0]).tolist() == []


def corpus():
    rng = random.Random(9)
    pool = ["Été", "of", "the", "ÄB", "x9", "漢字", "a\xa0b", "river", "MIX", "zz"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice((" ", "-", "\n", ". ", "\x00")) for _ in range(rng.choice((0, 3, 19, 20, 60))))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "!!! ..."), (903, "w" * 9000 + " " + "v " * 30), (904, "one two " * 30_000), (None, "null key " * 12)]
    return rows + [rows[4]] * 3, ["the river of x9", None, "", "the river the river"]


def test_equals_brute_force(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(k, x, 1, 2) for k, x in rows], "doc_id long, text string, score int, _at int").repartition(5)
    bench = spark.createDataFrame([(x, 3) for x in target], "text string, doc_id int")
    for percent in (5, 60):
        got = td.resample(docs, bench, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)) for r in brute(rows, target, percent=percent))


def test_ties_and_ranges(spark):
    """Equal scores are ranked by key over many ranges; rows alike in all get places of their own."""
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), True) for i in range(3000)] + [(5000, 2, True)] * 900 + [(6000, 9, False)]
    df = spark.createDataFrame(rows, "k long, score long, able boolean").repartition(7).withColumn("_row", F.monotonically_increasing_id())
    out = [tuple(r) for r in td.drawn(df, F.col("able"), [F.desc("score"), F.asc("k"), F.asc("_row")], 50, "place").drop("_row", "able").collect()]
    able = sorted([(k, s) for k, s, ok in rows if ok], key=lambda r: (-r[1], r[0]))
    assert sorted((p, k, s) for k, s, p in out if p) == [(i + 1, *r) for i, r in enumerate(able[: len(able) // 2])]
    assert len(out) == len(rows) and (6000, 9, None) in out


def test_empty_tables(spark):
    rows, target = corpus()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    assert td.resample(docs.limit(0), bench).count() == 0
    got = td.resample(docs, bench.limit(0))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)) for r in brute(rows, []))
