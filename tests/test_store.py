import threading

import pytest

from foldwright.operators import pooling
from foldwright.sources import store, tables

SCHEMA = tables.feature_schema(("center",))


def rows(spark, ids, width=3, provenance="1", model="m"):
    return spark.createDataFrame([(i, model, [1.0] * width, True, {"run": provenance}) for i in ids], SCHEMA)


def ids(spark, path, version=None):
    return sorted(r["sample"] for r in store.snapshot(spark, path, version).collect())


def test_appends_are_commits(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.snapshot(spark, path) is None and store.commits(spark, path) == []
    assert store.append(rows(spark, "ab"), path, "one") == 1
    assert store.append(rows(spark, "bc"), path, "two", base=1) == 2
    assert ids(spark, path) == ["a", "b", "c"] and ids(spark, path, 1) == ["a", "b"]
    assert store.append(rows(spark, "bc"), path, "two") == 2 and len(store.commits(spark, path)) == 2  # repeated
    with pytest.raises(store.StaleBase):
        store.append(rows(spark, "d"), path, "three", base=1)
    assert store.append(rows(spark, "x", width=5, model="other"), path, "three") == 3


def test_what_a_model_agrees_in_may_not_change(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append(rows(spark, "a"), path, "one", {"image": "png"})
    for bad in (rows(spark, "b", width=4), rows(spark, "b", provenance="2")):
        with pytest.raises(ValueError, match="differ from the store"):
            store.append(bad, path, "two", {"image": "png"})
    with pytest.raises(ValueError, match="metadata"):
        store.append(rows(spark, "b"), path, "two", {"image": "tif"})
    with pytest.raises(ValueError, match="one model differ"):
        store.append(rows(spark, "b").union(rows(spark, "c", width=4)), path, "two", {"image": "png"})
    with pytest.raises(ValueError, match="twice"):
        store.append(rows(spark, "bb"), path, "two", {"image": "png"})
    assert ids(spark, path) == ["a"]


def test_a_killed_append_leaves_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.append(rows(spark, "a"), path, "one")
    with monkeypatch.context() as m:
        m.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.append(rows(spark, "ab"), path, "two")
    assert ids(spark, path) == ["a"]
    assert store.append(rows(spark, "ab"), path, "two") == 2 and ids(spark, path) == ["a", "b"]


def test_two_appends_at_once_store_each_sample_once(spark, tmp_path, monkeypatch):
    path, gate, create, failed = str(tmp_path / "s"), threading.Barrier(2, timeout=60), store._create, []
    waits = {"x": True, "y": True}

    def slow(spark, where, text):  # both have written their rows before either commits
        run = text.split('"run": "')[1][0]
        if waits.pop(run, False):
            gate.wait()
        with lock:
            return create(spark, where, text)

    lock = threading.Lock()
    monkeypatch.setattr(store, "_create", slow)

    def go(name, some):
        try:
            store.append(rows(spark, some), path, name)
        except Exception as e:
            failed.append(e)

    jobs = [threading.Thread(target=go, args=x) for x in (("x", "abc"), ("y", "bcd"))]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert not failed and ids(spark, path) == ["a", "b", "c", "d"] and len(store.commits(spark, path)) == 2


def test_completion_is_marked_when_all_rules_hold(spark, tmp_path):
    path, wanted = str(tmp_path / "s"), spark.createDataFrame([("a",), ("b",)], "sample string")
    store.append(rows(spark, "a"), path, "one")
    with pytest.raises(ValueError, match="ids as expected"):
        store.complete(spark, path, wanted, "m", 3, ["center"])
    assert store.completed_at(spark, path, "m") is None
    store.append(rows(spark, "b"), path, "two")
    assert store.complete(spark, path, wanted, "m", 3, ["center"]) == store.completed_at(spark, path, "m") == 2


def test_a_set_of_tables_is_published_whole(spark, tmp_path, monkeypatch):
    path, one, two = str(tmp_path / "set"), spark.range(5).toDF("k"), rows(spark, "ab").select("sample")
    with pytest.raises(ValueError, match="nothing"):
        store.published(spark, path)
    assert store.publish({"one": one, "two": two}, path) == 1
    with monkeypatch.context() as m:  # killed before its commit
        m.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.publish({"one": one.limit(1)}, path)
    assert {n: d.count() for n, d in store.published(spark, path).items()} == {"one": 5, "two": 2}
    assert store.publish({"one": one.limit(1)}, path) == 2 and store.published(spark, path)["one"].count() == 1 and store.published(spark, path, 1)["one"].count() == 5
    one.write.mode("append").parquet(f"{path}/data/set={store.commits(spark, path)[1]['run']}/one")
    with pytest.raises(ValueError, match="not the table"):
        store.published(spark, path)


def patches(spark, some):
    return spark.createDataFrame([(s, i, [float(i), -float(i) * 2]) for s, i in some], "sample string, patch_index int, features array<double>")


def test_states_of_several_runs_make_whole_samples(spark):
    every = [("a", i) for i in range(10)] + [("b", i) for i in range(10) if i != 7] + [("c", 0)]
    declared = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), ("d", 2)], "sample string, want int")
    one, two = pooling.partial_pool(patches(spark, [x for x in every if x[1] < 6]), 3), pooling.partial_pool(patches(spark, [x for x in every if x[1] >= 6]), 3)
    whole, left = pooling.finish_pool(one, declared)
    assert {r["sample"] for r in whole.collect()} == {"c"} and {(r["sample"], r["have"]) for r in left.collect()} == {("a", 6), ("b", 6), ("d", 0)}
    whole, left = pooling.finish_pool(one.union(two).union(two), declared)  # the second run came twice
    assert {(r["sample"], r["have"]) for r in left.collect()} == {("b", 9), ("d", 0)}
    want = {(r["sample"], r["dim"]): (r["n_patches"], r["mean"], r["max"]) for r in pooling.pool_mean_max(patches(spark, every)).where("sample <> 'b'").collect()}
    assert {(r["sample"], r["dim"]): (r["n_patches"], r["mean"], r["max"]) for r in whole.collect()} == want
    torn = pooling.partial_pool(patches(spark, [("a", 6), ("a", 7)]), 3)  # another content of one range
    assert {(r["sample"], r["have"]) for r in pooling.finish_pool(one.union(two).union(torn), declared)[1].collect()} >= {("a", -1)}
    with pytest.raises(Exception, match="come once"):
        pooling.partial_pool(patches(spark, [("a", 1), ("a", 1)])).collect()
    assert pooling.finish_pool(one.limit(0), declared)[0].count() == 0
