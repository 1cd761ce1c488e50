import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foldwright.operators import checks, lineage
from foldwright.sources import files, streams, tables


def png(width, height, bits=8, colour=2):
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_metadata(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿a,b,c\n1,,NA\n02,\"\",x\n".encode())
    df = tables.read_metadata(spark, str(p), ["a", "b"])
    assert sorted(map(tuple, df.collect())) == [("02", "", "x"), ("1", "", "NA")]
    with pytest.raises(ValueError, match="missing"):
        tables.read_metadata(spark, str(p), ["z"])
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_metadata(spark, str(empty), ["a"])


def test_release_files(spark, tmp_path):
    for name, text in (("x.bin", b"one"), ("y.bin", b"two")):
        (tmp_path / name).write_bytes(text)
    lst = tmp_path.parent / "list.tsv"
    lst.write_text("".join(f"1\t{i}\t{n}\t3\t{hashlib.md5(t).hexdigest()}\tu\n" for i, (n, t) in enumerate((("x.bin", b"one"), ("y.bin", b"two")))))
    want = tables.read_release_list(spark, str(lst)).select(F.col("filename").alias("file_name"), F.col("bytes").alias("size_bytes"), "md5")
    found = files.identities(spark, str(tmp_path))
    assert files.verification_summary(files.verify(found, want, digest="md5")).first()["status"] == "PASS"
    (tmp_path / "x.bin").write_bytes(b"onf")
    rows = {r["file_name"]: r["status"] for r in files.verify(files.identities(spark, str(tmp_path)), want, digest="md5").collect()}
    assert rows == {"x.bin": "digest differs", "y.bin": "PASS"}


IDENTITY = "role string, path string, size_bytes long, sha256 string"


def test_lineage(spark):
    one = spark.createDataFrame([("in", "p", 1, "AA")], IDENTITY)
    other = one.withColumn("sha256", F.lit("BB"))
    for rule in (lineage.same_lineage, lineage.consumed_of_produced, lineage.exact_inputs):
        checks.require(rule(one, one))
        assert rule(other, one).first()["status"] == "FAIL"
    checks.require(lineage.bound_paths(other, one))
    assert lineage.bound_paths(one.withColumn("path", F.lit("q")), one).first()["status"] == "FAIL"
    for empty in (one.limit(0),):
        assert {rule(*x).first()["status"] for rule in (lineage.same_lineage, lineage.exact_inputs) for x in ((one, empty), (empty, one), (empty, empty))} == {"FAIL"}
        assert lineage.bound_paths(one, empty).first()["status"] == lineage.bound_paths(empty, empty).first()["status"] == "FAIL"


def test_a_lost_copy_of_an_equal_file_is_lost(spark):
    two = spark.createDataFrame([("in", "a/x", 5, "AA"), ("in", "a/y", 5, "AA")], IDENTITY)
    one = two.where("path = 'a/x'")
    assert lineage.same_lineage(two, one).first()["status"] == "FAIL"
    assert [(r["status"], r["path"]) for r in lineage.differences(two, one).collect()] == [("lost", "a/y")]


def test_paths_are_spelt_in_many_ways(spark):
    one = spark.createDataFrame([("in", "/Data/a/x.bin", 5, "ab"), ("in", "/data/b", 5, "cd")], IDENTITY)
    two = spark.createDataFrame([("in", "file:///data/./c/../A//X.BIN", 5, "AB"), ("in", "\\DATA\\b", 5, "CD")], IDENTITY)
    checks.require(lineage.same_lineage(one, two))
    keys = spark.createDataFrame([("../a",), ("/../a/..",), ("a/b/../../c",), ("",), (None,)], "p string").select(lineage.path_key(F.col("p")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["a", "/", "c", "", None]


def test_differences_are_rows(spark):
    first = [("in", "same", 1, "A"), ("in", "edited", 1, "B"), ("in", "old/1", 2, "C"), ("in", "old/2", 2, "C"), ("in", "gone", 3, "D"), ("up", "same", 1, "A")]
    second = [("in", "same", 1, "A"), ("in", "edited", 9, "E"), ("in", "new/1", 2, "C"), ("in", "fresh", 4, "F"), ("up", "same", 1, "A"), ("up", "same", 1, "A"), ("up", "gone", 3, "D")]
    got = {(r["role"], r["status"], r["path"] and r["path"][:4], r["new_path"]) for r in lineage.differences(*[spark.createDataFrame(x, IDENTITY) for x in (first, second)]).collect()}
    assert got == {("in", "changed", "edit", "edited"), ("in", "moved", "old/", "new/1"), ("in", "lost", "old/", None), ("in", "lost", "gone", None), ("in", "added", None, "fresh"), ("up", "added", None, "gone")}


def test_images(spark, tmp_path):
    d = tmp_path / "part_01"
    d.mkdir()
    (d / "a.png").write_bytes(png(4096, 4096))
    (d / "b.PNG").write_bytes(png(10, 10))
    (d / "c.png").write_bytes(png(4096, 4096, 16))
    (d / "d.png").write_bytes(b"no")
    (d / "e.txt").write_bytes(b"no")
    listed = tables.list_files(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in listed.collect()) == ["a.png", "b.PNG", "c.png", "d.png"]
    checks.require(tables.listing_checks(listed))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(str(tmp_path))
    got = {r["file_name"]: r["error"] for r in files.image_headers(raw, 4096, 4096).collect()}
    assert got == {"a.png": None, "b.PNG": "wrong size", "c.png": "not 8-bit RGB", "d.png": "not a PNG"}


def test_files_are_read_in_chunks(spark, tmp_path):
    contents = {"a b%20.bin": b"0123456789" * 1000, "empty.bin": b"", "é.bin": b"x" * 99}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = streams.digests(tables.list_files(spark, str(tmp_path), "*.bin"), chunk=64).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"], r["md5"]) for r in got} == {
        n: (len(d), hashlib.sha256(d).hexdigest().upper(), hashlib.md5(d).hexdigest()) for n, d in contents.items()}
    assert max(r["largest_read"] for r in got) == 64
    heads = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in streams.first_bytes(tables.list_files(spark, str(tmp_path), "*.bin"), 26).collect()}
    assert heads == {n: d[:26] for n, d in contents.items()}


def test_a_file_longer_than_a_cell_is_digested_in_bounded_chunks(spark, tmp_path):
    with open(tmp_path / "long.bin", "wb") as f:
        f.seek(2**31 + 5)  # a hole: no disk is used
        f.write(b"end")
    row = streams.digests(tables.list_files(spark, str(tmp_path), "*.bin")).first()
    assert row["size_bytes"] == 2**31 + 8 and row["largest_read"] == streams.CHUNK


def test_image_summary(spark):
    headers = spark.createDataFrame([("p", "a", None), ("p", "b", "wrong size"), ("p", "c", "not a PNG")], "path string, file_name string, error string")
    row = files.image_summary(headers).first()
    assert (row["n_images"], row["n_good"], row["n_wrong_size"], row["n_not_png"], row["n_wrong_kind"], row["first_failures"], row["status"]) == (3, 1, 1, 1, 0, ["b", "c"], "FAIL")
    assert files.image_summary(headers.where("error is null")).first()["status"] == "PASS" and files.image_summary(headers.limit(0)).first()["status"] == "FAIL"


def test_feature_store(spark, tmp_path):
    path, schema = str(tmp_path / "store"), tables.feature_schema()
    row = lambda i, prov: (i, "m", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], True, {"run": prov})
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    tables.append_features(spark.createDataFrame([row("a", "1")], schema), path, None)
    store = spark.read.parquet(path)
    assert [r["sample"] for r in tables.pending(samples, store).collect()] == ["b"]
    with pytest.raises(ValueError, match="provenance"):
        tables.append_features(spark.createDataFrame([row("b", "2")], schema), path, store)
    assert "FAIL" in [r["status"] for r in tables.validate_features(store, samples, 3, ["center"]).collect()]
    tables.append_features(spark.createDataFrame([row("a", "1"), row("b", "1")], schema), path, store)
    full = spark.read.parquet(path)
    checks.require(tables.validate_features(full, samples, 3, ["center", "grid_mean", "grid_max"]))
    assert tables.read_features(spark, path, "m", "center").count() == 2
    checks.require(tables.read_exact(full, 2))
    with pytest.raises(ValueError):
        checks.require(tables.read_exact(full, 3))


def test_sinks_and_import(spark, tmp_path):
    df = spark.createDataFrame([("k1", [1.0, 2.0], "mean")], "old_key string, features array<double>, pooling string")
    keys = spark.createDataFrame([("k1", "s1")], "old_key string, sample string")
    assert tables.import_vectors(df, keys, {"pooling": "mean"}, 2).first()["sample"] == "s1"
    with pytest.raises(ValueError):
        tables.import_vectors(df, keys, {"pooling": "max"}, 2)
    tables.write_results(keys, str(tmp_path / "o"), compress=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 1


def test_import_is_one_to_one(spark):
    df = spark.createDataFrame([("k1", [1.0]), ("k2", [2.0])], "old_key string, features array<double>")
    for pairs in ([("k1", "s1")], [("k1", "s1"), ("k2", "s1")], [("k1", "s1"), ("k2", "s2"), ("k3", "s3")]):
        with pytest.raises(ValueError, match="one to one"):
            tables.import_vectors(df, spark.createDataFrame(pairs, "old_key string, sample string"), {}, 1)


def test_store_refuses_another_width(spark, tmp_path):
    path, schema = str(tmp_path / "store"), tables.feature_schema()
    row = lambda i, m, n: (i, m, [1.0] * 3, [1.0] * n, [1.0] * 3, True, {"run": "1"})
    tables.append_features(spark.createDataFrame([row("a", "m", 3)], schema), path, None)
    with pytest.raises(ValueError, match="width"):
        tables.append_features(spark.createDataFrame([row("b", "m", 4)], schema), path, spark.read.parquet(path))
    tables.append_features(spark.createDataFrame([row("a", "other", 4)], schema), path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("rows", [46, 57])
def test_last_sample_of_fewer_patches_is_pooled_as_its_sql_says(spark, tmp_path, rows):
    """Of 46 vectors the tenth sample has one patch and none that is left out; of 57 the twelfth has two, all of the first run."""
    import duckdb

    from foldwright.plans import artefacts  # noqa: F401
    from foldwright.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS vec_id, CAST(list_transform(range(64), lambda d: sin(i * 64 + d)) AS FLOAT[]) AS embedding, 1 AS label FROM range({rows}) t(i)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = QUERIES["pooled_in_two_runs"](spark, str(tmp_path)).select("sample", "dim", "version").collect()
    want = con.execute(ORACLE_SQL["pooled_in_two_runs"]).df()
    assert sorted(map(tuple, got)) == sorted(zip(want["sample"], want["dim"], want["version"]))
