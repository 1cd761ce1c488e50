import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.functions import vectors
from foldwright.operators import checks, pooling, retrieval

ITEM = "sample string, grp string, fold int, label string, features array<double>"


def test_ties_go_to_the_smaller_id_and_own_group_is_barred(spark):
    q = spark.createDataFrame([("q", "same", 0, "A", [1.0, 0.0])], ITEM)
    g = spark.createDataFrame([("z", "same", 1, "A", [1.0, 0.0]), ("b", "other_b", 1, "A", [1.0, 0.0]), ("a", "other_a", 1, "A", [1.0, 0.0])], ITEM)
    assert [r["gallery"] for r in retrieval.exact_topk(q, g, 2).orderBy("rank").collect()] == ["a", "b"]


def test_three_folds(spark):
    rows = [(f"s{i}", f"p{i}", i // 2, "AB"[i % 2], [1.0, 0.0] if i % 2 == 0 else [0.0, 1.0]) for i in range(6)]
    out = retrieval.held_out_retrieval(spark.createDataFrame(rows, ITEM), 2, (1, 2))
    means = out["means"].where("fold >= 0").collect()
    assert len(means) == 6 and all(r["hit"] == 1 and r["average_precision"] == 1 for r in means if r["k"] == 1)
    checks.require(retrieval.input_checks(spark.createDataFrame(rows, ITEM)))


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03d}", f"g{i // 3}", (i // 3) % 3, "ab"[i % 2], rng.normal(size=6).tolist()) for i in range(60)]
    items = spark.createDataFrame(rows, ITEM)
    got = {(r["query"], r["rank"]): r["gallery"] for r in retrieval.exact_topk(items, items, 5, block).collect()}
    v = np.array([r[4] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i, r in enumerate(rows):
        ok = [j for j, s in enumerate(rows) if s[1] != r[1] and s[2] != r[2]]
        want = sorted(ok, key=lambda j: (-(v[i] @ v[j]), rows[j][0]))[:5]
        assert [got[r[0], k + 1] for k in range(5)] == [rows[j][0] for j in want]
    counts = {r["query"]: r["n_relevant"] for r in retrieval.relevant_counts(items).collect()}
    for r in rows:
        assert counts[r[0]] == sum(s[1] != r[1] and s[2] != r[2] and s[3] == r[3] for s in rows)


def test_query_without_neighbours_has_zeros(spark):
    items = spark.createDataFrame([("a", "g", 0, "x", [1.0]), ("b", "h", 0, "x", [1.0])], ITEM)
    row = retrieval.query_metrics(retrieval.exact_topk(items, items, 3), items, (1,)).where("query = 'a'").first()
    assert (row["n_returned"], row["precision"], row["vote_correct"]) == (0, 0.0, 0.0)


def test_invalid_vectors_are_reported_and_left_out(spark):
    items = spark.createDataFrame([("a", "g", 0, "x", [0.0, 0.0]), ("b", "h", 1, "x", [1.0, float("nan")]), ("c", "i", 2, "x", None), ("d", "j", 0, "x", [1.0, 2.0])], ITEM)
    assert retrieval.normalised(items).count() == 1
    assert "FAIL" in [r["status"] for r in retrieval.input_checks(items).collect()]


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 3.0])], "a array<double>, b array<double>").select(
        vectors.unit(F.col("a")), vectors.dot(F.col("a"), F.col("b")), vectors.argmax(F.array(F.lit(0.5), F.lit(0.5))), vectors.softmax(F.array(F.lit(0.0), F.lit(0.0))),
        vectors.max_abs_diff(F.col("a"), F.col("b"))).first()
    assert row[0] == [0.6, 0.8] and row[1] == 15.0 and row[2] == 0 and row[3] == [0.5, 0.5] and row[4] == 2.0


def test_pooling(spark):
    patches = spark.createDataFrame([("s", i, [float(i * 5 + d) / 7 for d in range(5)]) for i in range(256)], "sample string, patch_index int, features array<double>")
    one = pooling.as_vectors(pooling.pool_mean_max(patches, 256)).first()
    x = np.arange(1280).reshape(256, 5) / 7
    assert np.allclose(one["grid_mean"], x.mean(0), rtol=1e-6) and np.allclose(one["grid_max"], x.max(0), rtol=1e-6)
    assert pooling.pool_mean_max(patches, 255).count() == 0 and pooling.patch_count_violations(patches, 255).count() == 1
    tokens = spark.createDataFrame([("s", i, [2.0 if i == 0 else 1000.0 if i < 5 else 3.0] * 8) for i in range(261)], "sample string, token_index int, features array<double>")
    assert pooling.token_vectors(pooling.token_pool(tokens)).first()["features"] == [2.0] * 8 + [3.0] * 8


def test_tiles(spark):
    t = {r["tile"]: r for r in pooling.tile_grid(spark.createDataFrame([("s",)], "sample string")).collect()}
    assert len(t) == 257 and (t[1]["row"], t[1]["col"]) == (0, 1) and (t[16]["row"], t[16]["col"]) == (1, 0)
    assert tuple(t[255][c] for c in ("left", "top", "right", "bottom")) == (3840, 3840, 4096, 4096)
    assert tuple(t[-1][c] for c in ("left", "top", "right", "bottom")) == (1936, 1936, 2160, 2160)


@pytest.mark.parametrize("pivots,block", [(1, 1000), (9, 20), (64, 5)])
def test_pruned_neighbours_equal_all_pairs(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(f"{i:03d}", f"g{i // 3}", (i // 3) % 3, "a", (centres[i % 12] + rng.normal(size=8) * (0.1 if i % 5 else 3.0)).tolist()) for i in range(400)]
    rows += [(f"copy{i}", f"c{i}", i % 3, "a", rows[7][4]) for i in range(9)]  # equal vectors: ties at the k-th place
    items = spark.createDataFrame(rows, ITEM)
    want = sorted((r["query"], r["rank"], r["gallery"], round(r["similarity"], 12)) for r in retrieval.exact_topk(items, items, 6).collect())
    found, _ = retrieval.pruned_topk(items, items, 6, block, pivots)
    assert sorted((r["query"], r["rank"], r["gallery"], round(r["similarity"], 12)) for r in found.collect()) == want
    few, _ = retrieval.pruned_topk(items.where("sample < '005'"), items, 500, block, pivots)  # k larger than the gallery
    assert few.count() == retrieval.exact_topk(items.where("sample < '005'"), items, 500).count()
    assert retrieval.pruned_topk(items, items.limit(0), 3)[0].count() == 0


def test_most_couples_of_clustered_balls_are_spared(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(f"{i:04d}", f"g{i}", i % 3, "a", (centres[i % 40] + rng.normal(size=16) * 0.02).tolist()) for i in range(2000)]
    items = spark.createDataFrame(rows, ITEM)
    found, couples = retrieval.pruned_topk(items, items, 10)
    met = couples.agg(F.avg(F.col("met").cast("double"))).first()[0]
    print("couples of balls that met:", met)
    assert met < 0.3 and found.count() == 20_000


def test_queries_are_dealt_once_for_each_shelf_not_for_each_block(spark, monkeypatch):
    seen, plain = [], retrieval.on_shelves
    monkeypatch.setattr(retrieval, "on_shelves", lambda rows, shelves, k: seen.append((shelves, rows.count())) or plain(rows, shelves, k))
    items = spark.range(600).selectExpr("cast(id as string) sample", "cast(id as string) grp", "cast(id % 3 as int) fold", "array(cast(id as double), 1.0, id % 7 - 3.5) features")
    few = retrieval.exact_topk(items, items, 3, rows_per_block=2).collect()
    assert seen == [(24, 600 + 600 * 16)]
    assert sorted(map(tuple, few)) == sorted(map(tuple, retrieval.exact_topk(items, items, 3).collect()))


def test_pruned_queries_are_dealt_once_for_each_shelf_not_for_each_couple(spark, monkeypatch):
    rng, seen = np.random.default_rng(5), []
    items = spark.createDataFrame([(f"{i:04d}", f"g{i}", i % 3, "a", rng.normal(size=16).tolist()) for i in range(600)], ITEM)
    plain = type(items).repartitionById
    monkeypatch.setattr(type(items), "repartitionById", lambda rows, n, by: seen.append((n, rows.where("kind = 0").count(), rows.where("kind = 2").count())) or plain(rows, n, by))
    found, couples = retrieval.pruned_topk(items, items, 3, rows_per_block=10)
    assert couples.where("met").count() > 2500  # without clusters most couples meet
    assert len(seen) == 2 and all(shelves == 24 and gallery == 600 and asks <= 600 * 18 for shelves, gallery, asks in seen)
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.exact_topk(items, items, 3).collect()))


def test_best_on_shelf_is_the_sorted_whole(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(90, 8))
    y[40:80] = y[:40]  # equal vectors: the first by rank wins
    y /= np.linalg.norm(y, axis=1)[:, None]
    x, groups = np.concatenate([y[:30], -y[:3]]), np.arange(90) % 13
    row, col, value = retrieval.best_on_shelf(x, np.arange(33) % 13, y, groups, np.arange(90), 6, step=7)
    for i in range(33):
        sim = np.einsum("ij,ij->i", np.repeat(x[i : i + 1], 90, axis=0), y)
        sim[groups == i % 13] = -np.inf
        want = np.lexsort((np.arange(90), -sim))[:6]
        assert col[row == i].tolist() == want.tolist() and value[row == i].tolist() == sim[want].tolist()
