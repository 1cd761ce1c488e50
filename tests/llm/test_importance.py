import math
import random

import numpy as np

from foldwright.llm import importance as im


def corpus(spark, n=300):
    rng = random.Random(7)
    good, bad = ["river", "stone", "walks", "slowly", "and", "sings"], ["$$$", "buy", "###", "now", "click"]
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=rng.randint(5, 60))), i % 4 > 0) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, int(g)) for i, _, g in rows if i % 3 == 0], "doc_id long, quality int"), rows


def test_resampling_keeps_target_like_documents(spark):
    docs, labels, rows = corpus(spark)
    out = {r["doc_id"]: r for r in im.resample(docs, labels).collect()}
    share = sum(g for i, _, g in rows if i % 3 == 0) / 100
    assert sum(r["kept"] for r in out.values()) == round(share * len(rows))
    kept = [out[i]["kept"] for i, _, g in rows if g]
    assert sum(kept) / len(kept) > 0.97 and all(0 <= r["score"] <= 1 for r in out.values())


def test_ratios_equal_brute_force(spark):
    docs, labels, rows = corpus(spark, 80)
    dims = 512
    counts = {True: np.zeros(dims), False: np.zeros(dims)}
    known = {i for i, _, g in rows if i % 3 == 0 and g}
    for i, t, _ in rows:
        b = np.bincount(im.buckets([t], dims)[0], minlength=dims)
        counts[False] += b
        counts[True] += b if i in known else 0
    p, q = counts[True] + 1, counts[False] + 1
    for r in im.resample(docs, labels, dims=dims).collect():
        t = rows[r["doc_id"]][1]
        want = sum(math.log(p[k] / p.sum()) - math.log(q[k] / q.sum()) for k in im.buckets([t], dims)[0])
        assert math.isclose(r["log_ratio"], want, abs_tol=1e-6)
    assert list(im.buckets(["ab!! cd"], 10**9)[1]) == [0] * 5  # ab, !!, cd and two pairs


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) ** 5 for _ in range(5000)] + [0.25] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 2500, 5300):
        assert im.kth_largest(df, "v", k, bins=8, few=10) == sorted(values, reverse=True)[k - 1]
    assert im.kth_largest(df, "v", 0) == math.inf and im.kth_largest(df.limit(0), "v", 3) == math.inf


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "w " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = im.resample(docs, none).collect()
    assert len(out) == 4 and all(r["kept"] for r in out)
    assert im.resample(docs.limit(0), none).count() == 0
    clash = docs.withColumns({"kept": im.F.lit(1), "score": im.F.lit(2)})
    assert im.resample(clash, none).columns == im.resample(docs, none).columns


def test_kept_rows_are_the_gumbel_top_k(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int")
    out = im.resample(docs, labels, share=0.2, seed=5).collect()
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", im.gumbel(im.F.col("doc_id"), 5).alias("g")).collect()}
    assert abs(sum(noise.values()) / 300 - 0.5772) < 0.25  # the mean of standard Gumbel noise
    keys = {r["doc_id"]: r["log_ratio"] + noise[r["doc_id"]] for r in out}
    assert {r["doc_id"] for r in out if r["kept"]} == set(sorted(keys, key=keys.get, reverse=True)[:60])
