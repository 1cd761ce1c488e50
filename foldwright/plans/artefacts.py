"""Queries on sources, manifests, stores, releases and report inputs, with the SQL that gives the same rows."""

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, vectors
from ..functions.digest import json_digest, table_fingerprint
from ..operators import checks, compare, evaluate, folds, lineage, manifest, pooling, report, resample, retrieval
from ..sources import files as file_source
from ..sources import store, streams
from ..sources import tables as table_source
from ..sources.shared import materialise, shared_dir
from . import bindings as b
from .queries import (_MEAN_TEST, _MEANS, _OVER, _ROW, _SLACK, _TEST_COLUMNS, ORACLE_SQL, SEEDED, _metrics, _paired, _per_query, _fingerprint_sql, _probabilities, each_task,
                      longs, other_family, query, rounded)

# Manifest ------------------------------------------------------------------------------------------------------------


def _metadata(spark, sf_dir) -> DataFrame:
    """Orders as the rows of a metadata file, every column a string."""
    o = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    corners = [F.concat(F.lit(f"{c}:"), key).alias(c) for c in manifest.REQUIRED[7:]]
    return o.select(F.concat("c_name", F.lit(".svs_roi_"), key, F.lit(".png")).alias("slide_name"), F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("patient_idx"), key.alias("roi_idx"),
                    F.col("c_mktsegment").alias("diagnosis_raw"), F.col("c_mktsegment").alias("diagnosis"), F.col("o_orderstatus").alias("differentiation"), F.col("o_orderpriority").alias("growth_pattern"), *corners)


def _files(metadata: DataFrame) -> DataFrame:
    name = F.regexp_replace("slide_name", r"\.svs", "")
    return metadata.select(F.concat(F.lit("part_"), (F.col("roi_idx").cast("long") % 3).cast("string"), F.lit("/"), name).alias("path"), name.alias("file_name"))


def _read_back(df: DataFrame) -> DataFrame:
    """Through a CSV file with a header, as metadata comes."""
    path = f"{shared_dir(df.sparkSession)}/metadata-{uuid.uuid4().hex}"
    table_source.write_results(df, path)
    return table_source.read_metadata(df.sparkSession, path, list(manifest.REQUIRED))


_BASE = """SELECT CAST(o_orderkey AS VARCHAR) AS key, c_name, CAST(c_custkey AS VARCHAR) AS cust, c_mktsegment AS stratum, o_orderkey, o_orderstatus, o_orderpriority, o_custkey,
    c_mktsegment || '::patient_idx=' || c_custkey AS grp, c_name || '_roi_' || o_orderkey AS roi FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(f"SELECT grp || '::' || roi AS sample, grp, c_name AS subgroup, key AS member, stratum, 'part_' || o_orderkey % 3 || '/' || roi || '.png' AS path FROM ({_BASE})")
def manifest_build(spark, sf_dir):
    """Metadata read from CSV, ids derived, every row with its file; all gates must pass."""
    m = _metadata(spark, sf_dir)
    rows, gate = manifest.build(_read_back(m), _files(m))
    checks.require(gate)
    return rows.select("sample", "grp", "subgroup", "member", "stratum", "path")


@query(_ROW.format(f"""WITH m AS ({_BASE}), r AS (SELECT *, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE grp END AS got, grp || '::' || roi AS sample FROM m WHERE o_orderkey % 50 <> 0)
    SELECT 'required_columns' AS name, count(CASE WHEN key IS NULL THEN 1 END) AS bad FROM m UNION ALL SELECT 'unique file names', count(*) - count(DISTINCT roi) FROM m
    UNION ALL SELECT 'a file for every row', count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) FROM m UNION ALL SELECT 'a row for every file', count(CASE WHEN o_orderkey % 60 = 1 THEN 1 END) FROM m
    UNION ALL SELECT 'ids derived', count(CASE WHEN got IS NULL THEN 1 END) FROM r UNION ALL SELECT 'unique samples', count(*) - count(DISTINCT sample) FROM r UNION ALL SELECT 'unique names', count(*) - count(DISTINCT roi) FROM r
    UNION ALL SELECT 'ids equal their derivation', count(CASE WHEN got IS NULL THEN 1 END) FROM r UNION ALL SELECT 'group fixes stratum', count(*) FROM (SELECT got FROM r GROUP BY got HAVING count(DISTINCT stratum) > 1)"""))
def manifest_gates(spark, sf_dir):
    """The gates of a build from which files are missing, to which others were added, and whose groups were lost in some rows."""
    m = _metadata(spark, sf_dir)
    key = F.col("roi_idx").cast("long")
    added = m.where(key % 60 == 1).select(F.concat(F.lit("loose/"), "roi_idx").alias("path"), F.concat(F.lit("loose_"), "roi_idx").alias("file_name"))
    derived = manifest.derive(m)
    rows, gate = manifest.match_files(derived, _files(m.where(key % 50 != 0)).unionByName(added))
    rows = rows.withColumn("grp", F.when(key % 41 != 0, F.col("grp")))
    return checks.union_checks(checks.required_columns(m, list(manifest.REQUIRED)), gate, manifest.identity_checks(rows))


def _old(m: DataFrame) -> DataFrame:
    split = F.when(F.col("roi_idx").cast("long") % 4 == 0, "test").otherwise("train")
    return m.select("diagnosis", "patient_idx", F.concat(F.lit("SMC_"), F.regexp_replace("slide_name", r"\.svs_roi_.*$", ".svs")).alias("wsi"), "roi_idx", split.alias("split"), "differentiation", "growth_pattern")


@query(f"SELECT grp || '::' || roi AS sample, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM ({_BASE})")
def old_split_import(spark, sf_dir):
    m = _metadata(spark, sf_dir)
    rows, gate = manifest.import_old_split(manifest.derive(m), _old(m))
    checks.require(gate)
    return rows


@query(_ROW.format(f"""WITH m AS ({_BASE}) SELECT 'unique manifest keys' AS name, count(*) - count(DISTINCT roi) AS bad FROM m
    UNION ALL SELECT 'unique old keys', count(CASE WHEN o_orderkey % 30 = 3 THEN 1 END) FROM m WHERE o_orderkey % 25 <> 0
    UNION ALL SELECT 'old split matches the manifest', sum(CASE WHEN o_orderkey % 25 = 0 THEN 1 WHEN o_orderkey % 9 = 0 AND o_orderstatus <> 'F' THEN CASE WHEN o_orderkey % 30 = 3 THEN 2 ELSE 1 END ELSE 0 END) FROM m"""))
def old_split_gates(spark, sf_dir):
    """The gates of an old split that lacks samples, repeats some and has other values in a shared column."""
    m = _metadata(spark, sf_dir)
    key = F.col("roi_idx").cast("long")
    old = _old(m).where(key % 25 != 0).withColumn("differentiation", F.when(key % 9 == 0, "F").otherwise(F.col("differentiation")))
    return manifest.import_old_split(manifest.derive(m), old.unionByName(old.where(key % 30 == 3)))[1]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sample, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE '.00' END END AS cleaned FROM orders")
def clean_index(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(key, F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 1, ".0").otherwise(".00"))
    return b.table(spark, sf_dir, "orders").select(key.alias("sample"), identity.clean_index(raw).alias("cleaned"))


# Releases and lineage ------------------------------------------------------------------------------------------------


def _release(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as published files: what was recorded, read from a TSV, and what is found, with files lost, changed and added."""
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.col("p_partkey").cast("string"), F.lit(".bin")).alias("filename"), F.col("p_size").cast("long").alias("bytes"),
                                              F.md5(F.col("p_name").cast("binary")).alias("md5"))
    path = f"{shared_dir(spark)}/release-{uuid.uuid4().hex}"
    p.select(F.lit(1).alias("a"), "k", "filename", "bytes", "md5", F.lit("u").alias("url")).write.option("sep", "\t").csv(path)
    want = table_source.read_release_list(spark, path).select(F.col("filename").alias("file_name"), F.col("bytes").alias("size_bytes"), "md5")
    k = F.col("k")
    found = p.where(k % 11 != 0).select(F.when(k % 19 == 0, F.concat(F.lit("new_"), "filename")).otherwise(F.col("filename")).alias("file_name"),
                                        (F.col("bytes") + (k % 13 == 0).cast("int")).alias("size_bytes"), F.when(k % 17 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(F.upper("md5")).alias("md5"))
    return found, want


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 19 = 0 THEN 'missing' WHEN p_partkey % 13 = 0 THEN 'size differs' WHEN p_partkey % 17 = 0 THEN 'digest differs' ELSE 'PASS' END AS status FROM part)
    SELECT k || '.bin' AS file_name, status FROM p UNION ALL SELECT 'new_' || k || '.bin', 'not recorded' FROM p WHERE k % 19 = 0 AND k % 11 <> 0""")
def release_verify(spark, sf_dir):
    return file_source.verify(*_release(spark, sf_dir), digest="md5").select("file_name", "status")


@query("""SELECT count(*) + count(CASE WHEN p_partkey % 19 = 0 AND p_partkey % 11 <> 0 THEN 1 END) AS n_files,
    count(CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN 1 END) AS n_matched, 'FAIL' AS status FROM part""")
def release_summary(spark, sf_dir):
    return file_source.verification_summary(file_source.verify(*_release(spark, sf_dir), digest="md5"))


# Parts as files of a first run, and of a second one in which files were lost, changed, moved and added and paths are spelt otherwise.
_RUNS = """one AS (SELECT p_brand AS role, 'in/' || p_brand || '/' || p_partkey AS key, CAST(p_size AS BIGINT) AS size_bytes, upper(sha256(p_name)) AS sha256, p_partkey AS k FROM part),
    two AS (SELECT role, CASE WHEN k % 31 = 0 THEN 'moved/' || k ELSE key END AS key, size_bytes, CASE WHEN k % 23 = 0 THEN 'CHANGED ' || sha256 ELSE sha256 END AS sha256 FROM one WHERE k % 29 <> 0
            UNION ALL SELECT role, 'new/' || k, size_bytes, sha256 FROM one WHERE k % 37 = 0),
    a AS (SELECT role, lower(key) AS key, size_bytes, sha256 FROM one), b AS (SELECT role, lower(key) AS key, size_bytes, sha256 FROM two),
    gone AS (SELECT * FROM a EXCEPT SELECT * FROM b), come AS (SELECT * FROM b EXCEPT SELECT * FROM a)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    one = p.select(F.col("p_brand").alias("role"), F.concat_ws("/", F.lit("in"), "p_brand", k.cast("string")).alias("path"), F.col("p_size").alias("size_bytes"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), k.alias("k"))
    k = F.col("k")
    spelt = F.when(k % 5 == 0, F.upper("path")).when(k % 5 == 1, F.concat(F.lit("./in/x/..//"), F.substring("path", 4, 1000))).when(k % 5 == 2, F.translate("path", "/", "\\")).otherwise(F.col("path"))
    path = F.when(k % 31 == 0, F.concat(F.lit("moved/"), k.cast("string"))).otherwise(spelt)
    two = one.where(k % 29 != 0).withColumns({"path": path, "sha256": F.when(k % 23 == 0, F.concat(F.lit("changed "), "sha256")).otherwise(F.col("sha256"))})
    return one.drop("k"), two.unionByName(one.where(k % 37 == 0).withColumn("path", F.concat(F.lit("new/"), k.cast("string")))).drop("k")


@query(_ROW.format(f"""WITH {_RUNS} SELECT 'same inputs' AS name, (SELECT count(*) FROM gone) + (SELECT count(*) FROM come) AS bad
    UNION ALL SELECT 'inputs are recorded', count(*) FROM (SELECT key FROM b EXCEPT SELECT key FROM a)
    UNION ALL SELECT 'inputs were produced', count(*) FROM (SELECT key, size_bytes, sha256 FROM b EXCEPT SELECT key, size_bytes, sha256 FROM a)
    UNION ALL SELECT 'inputs are the given files', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"""))
def lineage_check(spark, sf_dir):
    """The rules of lineage on two runs, the second of which read other files."""
    one, two = _runs(spark, sf_dir)
    return checks.union_checks(lineage.same_lineage(one, two), lineage.bound_paths(two, one), lineage.consumed_of_produced(two, one), lineage.exact_inputs(two, one))


@query(f"""WITH {_RUNS}, changed AS (SELECT g.role, g.key, c.size_bytes AS new_size_bytes, c.sha256 AS new_sha256, g.size_bytes, g.sha256 FROM gone g JOIN come c ON g.role = c.role AND g.key = c.key),
    l AS (SELECT *, row_number() OVER (PARTITION BY role, size_bytes, sha256 ORDER BY md5(key), key) AS place FROM gone WHERE (role, key) NOT IN (SELECT (role, key) FROM changed)),
    r AS (SELECT *, row_number() OVER (PARTITION BY role, size_bytes, sha256 ORDER BY md5(key), key) AS place FROM come WHERE (role, key) NOT IN (SELECT (role, key) FROM changed))
    SELECT role, 'changed' AS status, key AS old_key, key AS new_key, size_bytes, sha256, new_size_bytes, new_sha256 FROM changed
    UNION ALL SELECT coalesce(l.role, r.role), CASE WHEN l.key IS NULL THEN 'added' WHEN r.key IS NULL THEN 'lost' ELSE 'moved' END, l.key, r.key, l.size_bytes, l.sha256, r.size_bytes, r.sha256
    FROM l FULL JOIN r ON l.role = r.role AND l.size_bytes = r.size_bytes AND l.sha256 = r.sha256 AND l.place = r.place""")
def lineage_differences(spark, sf_dir):
    """Every file of two runs that is not in both: changed, moved, lost or added."""
    return lineage.differences(*_runs(spark, sf_dir)).withColumns({"old_key": lineage.path_key(F.col("path")), "new_key": lineage.path_key(F.col("new_path"))}).drop("path", "new_path")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sample, sha256('{\"key\":\"' || o_orderkey || '\",\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def record_digests(spark, sf_dir):
    """Digest of a record's JSON, its keys in order whatever order they were put in."""
    key = F.col("o_orderkey").cast("string")
    return b.table(spark, sf_dir, "orders").select(key.alias("sample"), json_digest(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), key)).alias("digest"))


# Files ---------------------------------------------------------------------------------------------------------------

#: Bytes of a PNG's beginning: signature, length and name of the first chunk; width, height, bits and colour follow.
_PNG = "89504E470D0A1A0A0000000D49484452"


def _images(spark, sf_dir) -> str:
    """Write a file for each supplier, most of them beginnings of good images, some of another size or kind, some no image; the folder."""
    k = F.col("s_suppkey")
    number = lambda n: F.lpad(F.hex(n), 8, "0")
    head = F.concat(F.lit(_PNG), number(F.when(k % 7 == 0, 100).otherwise(4096)), number(F.lit(4096)), F.when(k % 11 == 0, "10").otherwise("08"), F.when(k % 13 == 0, "06").otherwise("02"))
    content = F.when(k % 17 == 0, F.col("s_name").cast("binary")).otherwise(F.concat(F.unhex(head), F.repeat("s_name", (k % 50).cast("int")).cast("binary")))
    name = F.concat(F.lit("part_"), (k % 5).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".PNG").when(k % 19 == 0, ".txt").otherwise(".png"))
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    streams.write_files(b.table(spark, sf_dir, "supplier").select(name.alias("name"), content.alias("content")), folder).write.format("noop").mode("overwrite").save()
    return folder


_IMAGES = """i AS (SELECT s_suppkey AS k, s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.PNG' ELSE '.png' END AS file_name, CASE WHEN s_suppkey % 17 = 0 THEN 'not a PNG' WHEN s_suppkey % 7 = 0 THEN 'wrong size'
    WHEN s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 THEN 'not 8-bit RGB' END AS error FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 19 <> 0)"""


@query(f"WITH {_IMAGES} SELECT file_name, error FROM i")
def image_headers(spark, sf_dir):
    """The header of every image file below a folder, of which the first bytes alone are read."""
    return file_source.read_headers(table_source.list_files(spark, _images(spark, sf_dir), directories="part_*"), 4096, 4096).select("file_name", "error")


@query(f"""WITH {_IMAGES} SELECT count(*) AS n_images, count(*) - count(error) AS n_good, count(CASE WHEN error = 'not a PNG' THEN 1 END) AS n_not_png, count(CASE WHEN error = 'wrong size' THEN 1 END) AS n_wrong_size,
    count(CASE WHEN error = 'not 8-bit RGB' THEN 1 END) AS n_wrong_kind, (SELECT string_agg(file_name, ',' ORDER BY file_name) FROM (SELECT file_name FROM i WHERE error IS NOT NULL ORDER BY file_name LIMIT 20)) AS failures,
    CASE WHEN count(error) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM i""")
def image_gate(spark, sf_dir):
    """Counts and verdict over the headers of a folder of images."""
    headers = file_source.read_headers(table_source.list_files(spark, _images(spark, sf_dir)), 4096, 4096)
    return file_source.image_summary(materialise(headers, "headers")).withColumn("first_failures", F.concat_ws(",", "first_failures")).withColumnRenamed("first_failures", "failures")


@query("""WITH f AS (SELECT s_suppkey AS k, s_suppkey || '.bin' AS file_name, repeat(s_name, CAST(s_suppkey % 90 AS INTEGER)) AS content FROM supplier)
    SELECT file_name, CAST(strlen(content) AS BIGINT) AS size_bytes, upper(sha256(content)) AS sha256, md5(content) AS md5,
        CASE WHEN k % 23 = 0 THEN 'not recorded' WHEN k % 29 = 0 AND k % 90 > 0 THEN 'digest differs' WHEN k % 31 = 0 THEN 'size differs' ELSE 'PASS' END AS status FROM f""")
def written_identities(spark, sf_dir):
    """Identities of files that were written, read in chunks of a thousand bytes, against a recorded list that lacks some and has others wrong."""
    k, folder = F.col("s_suppkey"), f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    content = F.repeat("s_name", (k % 90).cast("int"))
    s = b.table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(k.cast("string"), F.lit(".bin")).alias("name"), content.alias("content"))
    streams.write_files(s, folder).write.format("noop").mode("overwrite").save()
    k = F.col("k")
    digest = F.sha2(F.when((k % 29 == 0) & (k % 90 > 0), F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256)
    size = F.octet_length("content") + F.when((k % 31 == 0) & ~((k % 29 == 0) & (k % 90 > 0)), 1).otherwise(0)
    recorded = s.where(k % 23 != 0).select(F.col("name").alias("file_name"), size.alias("size_bytes"), digest.alias("sha256"))
    found = materialise(file_source.identities(spark, folder, "*.bin", chunk=1000), "identities")
    status = file_source.verify(found, recorded).select("file_name", "status")
    return found.drop("path").join(status, "file_name")


_SUMMARY_SQL = "(SELECT fold, count(DISTINCT grp) AS n_groups, count(DISTINCT subgroup) AS n_subgroups, count(*) AS n_samples, count(DISTINCT status) AS n_status, count(DISTINCT priority) AS n_priority FROM split GROUP BY fold)"


@query(b.sql(["split"], " UNION ALL ".join(_fingerprint_sql(*x) for x in (
    ("split", "split", {**dict.fromkeys(("sample", "subgroup", "grp", "stratum", "priority", "status"), "string"), "fold": "int"}),
    ("folds", "folds", {"grp": "string", "stratum": "string", "n_samples": "bigint", "n_subgroups": "bigint", "fold": "int"}),
    ("summary", _SUMMARY_SQL, {"fold": "int", **dict.fromkeys(("n_groups", "n_subgroups", "n_samples", "n_status", "n_priority"), "bigint")})))))
def fold_artefacts(spark, sf_dir):
    """Split, folds and summary published as one set, read back, and the fingerprint of each."""
    path, samples = f"{shared_dir(spark)}/fold-artefacts-{uuid.uuid4().hex}", materialise(b.cohort(spark, sf_dir), "cohort")
    groups = materialise(b.fold_table(spark, sf_dir, samples), "folds")
    made = folds.apply_folds(samples, groups)
    store.publish({"split": made, "folds": groups, "summary": folds.fold_summary(made, list(b.TASKS))}, path)
    return reduce(DataFrame.unionByName, [table_fingerprint(df).withColumn("name", F.lit(name)) for name, df in store.published(spark, path).items()])


# Feature stores ------------------------------------------------------------------------------------------------------


def _store(spark, sf_dir) -> DataFrame:
    """Embeddings as rows of a feature store: the vector, its double and its mean with the next dimension."""
    e = b.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("sample"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model_id"), F.col("embedding").cast("array<float>").alias("center"),
                    F.transform(F.col("embedding").cast("array<float>"), lambda x: (x * 2).cast("float")).alias("grid_mean"), F.lit(True).alias("completed"), F.create_map(F.lit("run"), F.lit("1")).alias("provenance"), "vec_id")


@query("SELECT CAST(vec_id AS VARCHAR) AS sample, CAST(unnest(range(64)) AS BIGINT) AS dim, round(CAST(unnest(embedding) AS DOUBLE) * 2, 6) + 0.0 AS value FROM embeddings WHERE vec_id % 2 = 1")
def feature_store_scan(spark, sf_dir):
    """A store filled in two runs, the second of which appends what the first left out; one model and one representation are read."""
    rows, path = _store(spark, sf_dir), f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    store.append(rows.where("vec_id % 5 <> 0").drop("vec_id"), path, "first")
    store.append(rows.drop("vec_id"), path, "second")
    whole = store.snapshot(spark, path)
    checks.require(table_source.read_exact(whole, rows.count()))
    return table_source.features_of(whole, "m1", "grid_mean").select("sample", F.posexplode(vectors.as_double(F.col("features"))).alias("dim", "value"))


@query("""SELECT sample, dim, round(mean, 6) + 0.0 AS mean, round(max, 6) + 0.0 AS max, version FROM (
    SELECT CAST(vec_id // 5 AS VARCHAR) AS sample, dim, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(max(x) AS FLOAT) AS DOUBLE) AS max,
        CAST(CASE WHEN (vec_id // 5) % 3 = 0 OR max(vec_id % 5) < 2 THEN 1 ELSE 2 END AS BIGINT) AS version
    FROM (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY vec_id // 5, dim
    HAVING (vec_id // 5) % 7 <> 2 OR count(CASE WHEN vec_id % 5 = 3 THEN 1 END) = 0)""")
def pooled_in_two_runs(spark, sf_dir):
    """Patches that come in two runs, pooled into a feature store: after the first run some samples are whole, after the second all but those that lack a patch.

    The second run is tried twice, as after a failure; the store has each sample once, and tells with which commit it came.
    """
    path, k = f"{shared_dir(spark)}/pooled-{uuid.uuid4().hex}", F.col("sample").cast("long")
    patches = b.patches(spark, sf_dir).where((k % 7 != 2) | (F.col("patch_index") != 3))
    early = (k % 3 == 0) | (F.col("patch_index") < 2)
    states = [materialise(pooling.partial_pool(p, 2), "pool-states") for p in (patches.where(early), patches.where(~early))]
    declared = b.patches(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("want"))
    # The last sample may have fewer than five patches: of less than three, all come in the first run; of less than four, none is left out.
    for run, have in (("first", states[:1]), ("second", states), ("second", states)):
        whole, _ = pooling.finish_pool(reduce(DataFrame.unionByName, have), declared)
        rows = pooling.as_vectors(whole).withColumns({"model_id": F.lit("m"), "completed": F.lit(True), "provenance": F.create_map(F.lit("encoder"), F.lit("e1"))})
        store.append(rows, path, run, {"patches": "5"})
    both = store.snapshot(spark, path)
    first = store.snapshot(spark, path, 1).select("sample").withColumn("version", F.lit(1))
    return both.join(first, "sample", "left").select("sample", F.coalesce("version", F.lit(2)).alias("version"), F.posexplode(F.arrays_zip("grid_mean", "grid_max")).alias("dim", "v")).select(
        "sample", "dim", F.col("v.grid_mean").alias("mean"), F.col("v.grid_max").alias("max"), "version")


@query(_ROW.format("""SELECT 'unique ids' AS name, count(CASE WHEN vec_id % 83 = 0 THEN 1 END) AS bad FROM embeddings
    UNION ALL SELECT 'vectors of one width, finite', sum(CASE WHEN vec_id % 89 = 0 OR vec_id % 79 = 0 THEN CASE WHEN vec_id % 83 = 0 THEN 2 ELSE 1 END ELSE 0 END) FROM embeddings
    UNION ALL SELECT 'all rows complete', sum(CASE WHEN vec_id % 97 = 0 THEN CASE WHEN vec_id % 83 = 0 THEN 2 ELSE 1 END ELSE 0 END) FROM embeddings
    UNION ALL SELECT 'one provenance', CASE WHEN count(DISTINCT vec_id % 2) > 1 THEN 1 ELSE 0 END FROM embeddings
    UNION ALL SELECT 'ids as expected', count(CASE WHEN vec_id % 7 = 0 THEN 1 END) FROM embeddings"""))
def feature_validate(spark, sf_dir):
    """The rules of a store that has repeated ids, vectors of zeros or another width, open rows and two origins, against a shorter list of samples."""
    s, v = _store(spark, sf_dir), F.col("vec_id")
    s = s.unionByName(s.where(v % 83 == 0))
    bad = s.withColumns({"center": F.when(v % 89 == 0, F.transform("center", lambda x: (x * 0).cast("float"))).when(v % 79 == 0, F.slice("center", 1, 63)).otherwise(F.col("center")),
                         "completed": v % 97 != 0, "provenance": F.create_map(F.lit("run"), F.col("model_id"))})
    samples = b.table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").cast("string").alias("sample"))
    return table_source.validate_features(bad, samples, 64, ["center"])


@query("SELECT 'new-' || vec_id AS sample, CAST(unnest(range(64)) AS BIGINT) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings")
def feature_import(spark, sf_dir):
    """Vectors of an earlier run under the names of this one."""
    e = b.table(spark, sf_dir, "embeddings")
    key = F.concat(F.lit("old/"), F.col("vec_id").cast("string"))
    old = e.select(key.alias("old_key"), vectors.as_double(F.col("embedding")).alias("features"), F.lit("mean").alias("pooling"))
    rows = table_source.import_vectors(old, e.select(key.alias("old_key"), F.concat(F.lit("new-"), F.col("vec_id").cast("string")).alias("sample")), {"pooling": "mean"}, 64)
    return rows.select("sample", F.posexplode("features").alias("dim", "value"))


@query("SELECT CAST(vec_id AS VARCHAR) AS sample, round(list_dot_product(v, v[33:64] || v[1:32]), 6) + 0.0 AS product FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def vector_dot(spark, sf_dir):
    """Each vector's product with itself, its halves exchanged."""
    x = vectors.as_double(F.col("features"))
    return b.items(spark, sf_dir).select("sample", vectors.dot(x, vectors.concat_vectors(F.slice(x, 33, 32), F.slice(x, 1, 32))).alias("product"))


@query(b.sql(["items"], _ROW.format("""SELECT 'fold numbers' AS name, count(CASE WHEN CAST(sample AS BIGINT) % 91 = 0 THEN 1 END) AS bad FROM items UNION ALL SELECT 'every fold', 1
    UNION ALL SELECT 'unique items', count(*) - count(DISTINCT sample) FROM items UNION ALL SELECT 'groups in one fold', count(DISTINCT CASE WHEN CAST(sample AS BIGINT) % 91 = 0 THEN grp END) FROM items
    UNION ALL SELECT 'vectors finite and not zero', count(CASE WHEN CAST(sample AS BIGINT) % 77 = 0 THEN 1 END) FROM items""")))
def retrieval_input_checks(spark, sf_dir):
    """The rules for items of which some lie in a fold that is not declared, and some have no vector."""
    x, k = b.items(spark, sf_dir), F.col("sample").cast("long")
    return retrieval.input_checks(x.withColumn("fold", F.when(k % 91 == 0, 7).otherwise(F.col("fold"))).withColumn("features", F.when(k % 77 != 0, F.col("features"))), b.N_FOLDS)


# Results and reports -------------------------------------------------------------------------------------------------


@query(b.sql(["seed_rows"], f"SELECT model, strategy, task, metric, {rounded('mean', 'sd')}, n_seeds FROM seed_rows"))
def probability_reeval(spark, sf_dir):
    """Stored fold probabilities evaluated anew, task by task, behind their checks."""
    rows = _probabilities(spark, sf_dir)
    labelled = materialise(b.long_labels(b.cohort(spark, sf_dir)).join(F.broadcast(b.classes(spark, sf_dir)), ["task", "label"]).select("task", "sample", "grp", "class_id"), "labelled")

    def of(task: str) -> DataFrame:
        samples = labelled.where(F.col("task") == task).select("sample", "grp", F.col("class_id").alias("true_id"))
        done = evaluate.evaluate_probabilities(rows.where(F.col("task") == task), samples, b.classes(spark, sf_dir).where(F.col("task") == task).drop("task"), b.SYSTEM)
        checks.require(done["checks"])
        return done["seed_summary"]

    return each_task(of)


@query(b.sql(["preds"], _ROW.format("""WITH p AS (SELECT *, CAST(sample AS BIGINT) AS k FROM preds WHERE NOT (model = 'beta' AND CAST(sample AS BIGINT) % 31 = 0))
    SELECT 'each sample once per system and seed' AS name, (SELECT count(*) FROM preds WHERE model = 'beta' AND CAST(sample AS BIGINT) % 31 = 0) AS bad
    UNION ALL SELECT 'probabilities in range', count(CASE WHEN k % 37 = 0 THEN 1 END) FROM p UNION ALL SELECT 'probabilities sum to one', count(CASE WHEN k % 43 = 0 OR k % 37 = 0 THEN 1 END) FROM p
    UNION ALL SELECT 'one class count', 0""")))
def probability_checks(spark, sf_dir):
    """The rules for probabilities of which rows were lost, some leave 0..1 and some do not sum to one."""
    k, p = F.col("sample").cast("long"), F.col("probs")
    rows = _probabilities(spark, sf_dir).where(~((F.col("model") == "beta") & (k % 31 == 0)))
    moved = F.when(k % 37 == 0, F.transform(p, lambda x: x * 3)).when(k % 43 == 0, F.transform(p, lambda x: x / 2)).otherwise(p)
    return evaluate.probability_checks(rows.withColumn("probs", moved), b.cohort(spark, sf_dir), SEEDED)


@query(b.sql(["metrics"], _ROW.format("""WITH m AS (SELECT *, n_samples + CASE WHEN model = 'alpha' AND seed = 303 THEN 1 ELSE 0 END AS n FROM metrics WHERE NOT (model = 'beta' AND seed = 505))
    SELECT 'unique system and seed' AS name, count(*) - count(DISTINCT (model, strategy, task, seed)) AS bad FROM m
    UNION ALL SELECT 'one protocol', CASE WHEN count(DISTINCT seed = 101) > 1 THEN 1 ELSE 0 END FROM m UNION ALL SELECT 'no fold rows', count(CASE WHEN strategy = 'center' THEN 1 END) FROM m
    UNION ALL SELECT 'every seed of every system', (SELECT count(*) FROM metrics) - count(*) FROM m
    UNION ALL SELECT 'constant n_samples', count(*) FROM (SELECT model FROM m GROUP BY model, strategy, task HAVING count(DISTINCT n) > 1)
    UNION ALL SELECT 'positive n_samples', count(CASE WHEN n <= 0 THEN 1 END) FROM m
    UNION ALL SELECT 'accuracy within 0 and 1', count(CASE WHEN seed = 202 OR accuracy > 1 OR accuracy < 0 THEN 1 END) FROM m
    UNION ALL SELECT 'balanced_accuracy within 0 and 1', count(CASE WHEN seed = 404 OR balanced_accuracy > 1 OR balanced_accuracy < 0 THEN 1 END) FROM m
    UNION ALL SELECT 'macro_f1 within 0 and 1', count(CASE WHEN (strategy = 'center' AND task = 'status') OR macro_f1 > 1 OR macro_f1 < 0 THEN 1 END) FROM m
    UNION ALL SELECT 'weighted_f1 within 0 and 1', count(CASE WHEN weighted_f1 > 1 OR weighted_f1 < 0 THEN 1 END) FROM m""")))
def report_inputs(spark, sf_dir):
    """The gate of report tables on rows of two protocols, with fold rows, a lost seed, counts that change and metrics that are no number, infinite or negative."""
    m = _metrics(spark, sf_dir).where("not (model = 'beta' and seed = 505)")
    m = m.withColumns({"accuracy": F.when(F.col("seed") == 202, float("nan")).otherwise(F.col("accuracy")), "balanced_accuracy": F.when(F.col("seed") == 404, float("inf")).otherwise(F.col("balanced_accuracy")),
                       "macro_f1": F.when((F.col("strategy") == "center") & (F.col("task") == "status"), -0.25).otherwise(F.col("macro_f1"))})
    bad = m.withColumns({"protocol_id": (F.col("seed") == 101).cast("string"), "fold": F.when(F.col("strategy") == "center", 0),
                         "n_samples": F.col("n_samples") + ((F.col("model") == "alpha") & (F.col("seed") == 303)).cast("int")})
    return report.input_checks(bad, b.SYSTEM, list(b.SEEDS), ["n_samples"])


def _bundle(spark, sf_dir, broken: bool) -> dict[str, DataFrame]:
    """Parts of a report with intervals of means for intervals; ``broken``: a seed was lost, retrieval consumed other files and some intervals lack a bound."""
    predictions, classes = b.evaluation(spark, sf_dir, deal="grp")
    metrics = materialise(evaluate.system_metrics(predictions, classes, SEEDED, ["task"]), "metrics")
    hits = predictions.withColumn("value", (F.col("true_id") == F.col("pred_id")).cast("double"))
    intervals = materialise(each_task(lambda t: resample.mean_intervals(hits.where(F.col("task") == t), b.signature_groups(b.cohort(spark, sf_dir), t), SEEDED, b.REPLICATES)), "intervals")
    one, two = _runs(spark, sf_dir)
    if broken:
        metrics = metrics.where("not (model = 'beta' and seed = 505)")
        intervals = intervals.withColumn("ci_high", F.when(F.col("seed") == 101, F.col("ci_low") - 1).otherwise(F.col("ci_high")))
    per_fold = retrieval.mean_metrics(_per_query(spark, sf_dir), ["fold", "k"])
    return report.report_bundle(metrics, per_fold, intervals, list(b.TASKS), list(b.SEEDS), evaluate.per_class(predictions, classes, SEEDED, ["task"]),
                                evaluate.confusion(predictions, classes, SEEDED, ["task"]), (one, two if broken else one))


_KS = (5, 10, 15, 20)


@query(b.sql(["per_query"], f"""SELECT s.*, 'READY' AS verdict, {", ".join(f"r.map_at_{k}" for k in _KS)}, (SELECT count(*) FROM ({ORACLE_SQL['per_class_summary']})) AS n_per_class, (SELECT count(*) FROM ({ORACLE_SQL['confusion_seed_sd']})) AS n_confusion,
    (SELECT count(*) FROM part) AS n_files, CAST(40 AS BIGINT) AS n_intervals FROM ({ORACLE_SQL['summary_table']}) s CROSS JOIN (
    SELECT {", ".join(f"max(CASE WHEN k = {k} AND metric = 'average_precision' THEN printf('%.3f ± %.3f', mean, sd) END) AS map_at_{k}" for k in _KS)} FROM (
    WITH f AS (SELECT fold, k, {_MEANS} FROM per_query GROUP BY fold, k) {_OVER})) r"""))
def report_bundle(spark, sf_dir):
    """The summary table of a report, whose gate must pass, with the retrieval cells and the sizes of the other tables beside it."""
    made = _bundle(spark, sf_dir, False)
    checks.require(made["checks"])
    size = lambda t, c: F.broadcast(made[t].agg(F.count("*").alias(c)))
    out = made["summary"].join(F.broadcast(checks.roll_up(made["checks"]).select("verdict"))).join(F.broadcast(made["retrieval"].select(*[f"map_at_{k}" for k in _KS])))
    return out.join(size("per_class", "n_per_class")).join(size("confusion", "n_confusion")).join(size("provenance", "n_files")).join(size("intervals", "n_intervals"))


@query(b.sql(["metrics"], _ROW.format(f"""WITH {_RUNS}, m AS (SELECT * FROM metrics WHERE NOT (model = 'beta' AND seed = 505))
    SELECT 'unique system and seed' AS name, 0 AS bad UNION ALL SELECT 'every seed of every system', (SELECT count(*) FROM metrics) - count(*) FROM m
    UNION ALL SELECT 'constant n_samples', count(*) FROM (SELECT model FROM m GROUP BY model, strategy, task HAVING count(DISTINCT n_samples) > 1)
    UNION ALL SELECT 'positive n_samples', count(CASE WHEN n_samples <= 0 THEN 1 END) FROM m
    {" ".join(f"UNION ALL SELECT '{m} within 0 and 1', count(CASE WHEN {m} NOT BETWEEN 0 AND 1 THEN 1 END) FROM m" for m in evaluate.METRICS)}
    UNION ALL SELECT 'intervals have bounds', count(CASE WHEN seed = 101 THEN 1 END) FROM metrics
    UNION ALL SELECT 'same inputs', (SELECT count(*) FROM gone) + (SELECT count(*) FROM come)""")))
def report_bundle_blocked(spark, sf_dir):
    """The gate of a report that must not be made."""
    gate = _bundle(spark, sf_dir, True)["checks"]
    try:
        checks.require(gate)
    except ValueError:
        return gate
    raise AssertionError("a report of other inputs and a lost seed was let through")


_ORDERS = {"task": ["priority", "status"], "metric": ["macro_f1", "accuracy"], "model": ["beta"], "strategy": []}


@query(b.sql(["seed_rows"], """SELECT model, strategy, task, metric, row_number() OVER (ORDER BY CASE task WHEN 'priority' THEN 0 ELSE 1 END, task,
    CASE metric WHEN 'macro_f1' THEN 0 WHEN 'accuracy' THEN 1 ELSE 2 END, metric, CASE model WHEN 'beta' THEN 0 ELSE 1 END, model, strategy) - 1 AS position FROM seed_rows"""))
def ordered_table(spark, sf_dir):
    """Rows of the summary in a declared order; values that are not declared come after, by name."""
    s = evaluate.seed_summary(_metrics(spark, sf_dir), b.SYSTEM)
    return report.with_position(s.select("model", "strategy", "task", "metric"), _ORDERS)


@query("""SELECT * FROM (SELECT 'first' AS what, CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25)
    UNION ALL SELECT * FROM (SELECT 'failed', CAST(o_orderkey AS BIGINT), o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20)""")
def first_rows(spark, sf_dir):
    """A pilot subset, the first rows by id, and the first rows that break a rule."""
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    pilot, failed = report.first_n(o, ["o_orderkey"], 25), report.first_failures(o, F.col("o_orderstatus") != "P", ["o_orderkey"])
    return pilot.withColumn("what", F.lit("first")).unionByName(failed.withColumn("what", F.lit("failed")))


@query("""SELECT m AS model, s AS strategy, t AS task FROM (SELECT DISTINCT p_brand AS m FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) OR p_brand = (SELECT max(p_brand) FROM part))
    CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) CROSS JOIN (SELECT DISTINCT c_mktsegment AS t FROM customer)""")
def experiment_grid(spark, sf_dir):
    """Experiments over the brands, states and segments that occur, for the first and the last brand."""
    names = lambda t, c: sorted(r[0] for r in b.table(spark, sf_dir, t).select(c).distinct().collect())
    brands = names("part", "p_brand")
    return report.experiment_grid(spark, brands, names("orders", "o_orderstatus"), names("customer", "c_mktsegment"), ", ".join({brands[0], brands[-1]}))


# Two encoders compared -----------------------------------------------------------------------------------------------

_CHAIN = ("items", "normed", "nn", "rel", "votes", "runs", "at_k", "per_query")
for _n in _CHAIN:
    b.PARTS[f"half_{_n}"] = re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"half_\1", b.PARTS[_n]).replace("CAST(embedding AS DOUBLE[])", "CAST(embedding AS DOUBLE[])[1:32]")
    b.NEEDS[f"half_{_n}"] = [f"half_{x}" if x in _CHAIN else x for x in b.NEEDS.get(_n, [])]

_ENCODERS = f"""pos AS (SELECT *, {b.mix32(f"((base + pos * {resample.GOLDEN}) % 4294967296)")} AS d FROM (SELECT grp, row_number() OVER (ORDER BY md5(grp), grp) - 1 AS pos, count(*) OVER () AS n,
        {b.hex32("'0|all'")} AS base, {b.hex32("'sign-0|' || grp")} AS token FROM (SELECT DISTINCT grp FROM items))),
    w AS (SELECT replicate, q.grp, count(*) AS weight FROM (SELECT replicate, {b.mix32("x")} % n AS pick FROM (SELECT replicate, n, xor(d, e) AS x FROM pos CROSS JOIN reps)) s JOIN pos q ON q.pos = s.pick GROUP BY ALL),
    flips AS (SELECT replicate, grp, {b.mix32("x")} % 2 AS flip FROM (SELECT replicate, grp, xor(token, e) AS x FROM pos CROSS JOIN reps)),
    s AS (SELECT x.k, i.grp, sum(x.average_precision - y.average_precision) AS s, count(*) AS c FROM per_query x JOIN half_per_query y ON x.query = y.query AND x.k = y.k JOIN items i ON x.query = i.sample GROUP BY ALL),
    seen AS (SELECT k, sum(s) / sum(c) AS difference FROM s GROUP BY k),
    r AS (SELECT k, replicate, sum(s * weight) / sum(c * weight) AS value FROM s JOIN w ON s.grp = w.grp GROUP BY ALL),
    q AS (SELECT k, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, count(*) AS n_bootstrap, avg(CASE WHEN value > {_SLACK} THEN 1.0 ELSE 0.0 END) AS probability_a_better FROM r GROUP BY k),
    nul AS (SELECT k, replicate, sum(CASE WHEN flip = 1 THEN -s ELSE s END) / sum(c) AS value FROM s JOIN flips f ON s.grp = f.grp GROUP BY ALL),
    p AS (SELECT nul.k, (sum(CASE WHEN abs(value) >= abs(difference) - {_SLACK} THEN 1 ELSE 0 END) + 1) / {b.REPLICATES + 1}.0 AS p_value FROM nul JOIN seen ON nul.k = seen.k GROUP BY ALL)"""


@query(b.sql(["per_query", "half_per_query", "reps"], f"""SELECT {longs('k')}, {rounded('difference', 'ci_low', 'ci_high', 'probability_a_better', 'p_value')}, n_bootstrap FROM (WITH {_ENCODERS}
    SELECT seen.k, difference, ci_low, ci_high, probability_a_better, p_value, n_bootstrap FROM seen JOIN q ON seen.k = q.k JOIN p ON seen.k = p.k)"""))
def paired_retrieval_test(spark, sf_dir):
    """Average precision of whole vectors against that of their first halves, query by query, with a group bootstrap and sign flips."""
    x = b.items(spark, sf_dir)
    half = x.withColumn("features", F.slice("features", 1, 32))
    metric = lambda items: retrieval.query_metrics(retrieval.exact_topk(items, items, 20), items).join(x.select(F.col("sample").alias("query"), "grp"), "query")
    pairs = compare.agreeing(compare.aligned(metric(x), metric(half), ["k", "query"], ["grp", "fold", "n_relevant"], "average_precision"))
    return resample.paired_mean_test(pairs, x.select("grp", F.lit("all").alias("stratum")).distinct(), ["k"], b.REPLICATES)


def _part(statistic: str, cohort: str, series: list[str], source: str, value: str, metric: str = "CAST(NULL AS VARCHAR)", tested: bool = False, held: str = "") -> str:
    """Rows of ``statistics_run`` from the SQL of a single statistic; tests corrected within ``held`` and the metric."""
    # Tests are corrected by unrounded p-values, as the query does, and rounded in the end.
    shown = ("value", "ci_low", "ci_high", "probability_a_better", "p_value")
    source = source.replace(rounded("difference", *shown[1:]), ", ".join(("difference", *shown[1:]))) if tested else source
    names = ", ".join(f"'{c}': {c}" for c in series)
    p = "probability_a_better, p_value" if tested else "CAST(NULL AS DOUBLE) AS probability_a_better, CAST(NULL AS DOUBLE) AS p_value"
    rows = f"""SELECT '{statistic}' AS statistic, {cohort} AS cohort, CAST(to_json({{{names}}}) AS VARCHAR) AS series, {metric} AS metric, {value} AS value, ci_low, ci_high, n_bootstrap, {p}{f", {held} AS held" if tested else ""} FROM ({source})"""
    if not tested:
        return f"SELECT *, CAST(NULL AS DOUBLE) AS p_holm FROM ({rows})"
    w = "PARTITION BY cohort, metric, held"
    ends = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in shown)
    return f"""SELECT * EXCLUDE (rank, m, held) REPLACE ({ends}), round(least(1.0, max(p_value * (m - rank + 1)) OVER ({w} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS p_holm FROM (
        SELECT *, row_number() OVER ({w} ORDER BY p_value, series) AS rank, count(*) OVER ({w}) AS m FROM ({rows}))"""


_BOTH = ("average_precision", "vote_correct")
_EACH = lambda name: " UNION ALL ".join(f"SELECT *, '{m}' AS measure FROM ({ORACLE_SQL[name].replace('s.average_precision', 's.' + m).replace('x.average_precision - y.average_precision', f'x.{m} - y.{m}').replace('sum(average_precision) AS s', f'sum({m}) AS s')})" for m in _BOTH)
_OTHER_MEAN_TEST = b.every_task(b.sql(["preds", "weights", "flips"], other_family(f"SELECT strategy, {longs('seed')}, {_TEST_COLUMNS} FROM ({_MEAN_TEST})")), named=True)


def _statistics(spark, sf_dir, whole: bool) -> DataFrame:
    """Statistics of the two tasks and of retrieval, each cohort with groups and strata of its own, over draws made once; ``whole``: with the classification metrics."""
    cohort = materialise(b.cohort(spark, sf_dir).drop("subgroup"), "cohort")
    rows, classes = b.evaluation_by_sample(spark, sf_dir, deal="grp", samples=cohort)
    families = [(held, varied, reference, alternative) for _, held, varied, reference, (alternative,) in b.FAMILIES]
    of = lambda x, t: x.where(F.col("task") == t)
    made = [resample.run_statistics(of(rows, t), b.runs_of(t), b.signature_groups(cohort, t), of(classes, t), t, families, b.REPLICATES, metrics=whole) for t in b.TASKS]
    parts = []
    x = b.items(spark, sf_dir)
    named = x.select(F.col("sample").alias("query"), "grp")
    full, half = (materialise(retrieval.query_metrics(retrieval.exact_topk(i, i, 20), i).join(named, "query"), "per-query") for i in (x, x.withColumn("features", F.slice("features", 1, 32))))
    for m in _BOTH:
        key = F.lit(m).alias("measure")
        parts.append(resample.statistic("mean", "retrieval", full.select(key, "k", "grp", F.col(m).alias("value")), ["measure", "k"]))
        pairs = compare.agreeing(compare.aligned(full, half, ["k", "query"], ["grp", "fold", "n_relevant"], m))
        parts.append(resample.statistic("mean difference", "retrieval", pairs.select(key, "k", "grp", "a", "b"), ["measure", "k"], family=["measure"]))
    groups = x.select("grp", F.lit("all").alias("stratum")).distinct().withColumn("cohort", F.lit("retrieval"))
    long = materialise(reduce(DataFrame.unionByName, parts), "group-statistics")
    return resample.statistics_run(long, groups, b.REPLICATES, more=reduce(DataFrame.unionByName, made))


@query()
def statistics_run(spark, sf_dir):
    """Every statistic of a result set at once: intervals of classification metrics by seed, paired tests of both declared families, and intervals and paired tests of two retrieval measures.

    One statement for all of it needs too much memory; its parts have SQL (``statistics_tests``, ``bootstrap_ci_by_seed``, ``paired_class_test``), and a test compares.
    """
    return _statistics(spark, sf_dir, True)


@query(" UNION ALL ".join([
    _part("mean difference", "task", ["strategy", "seed"], ORACLE_SQL["paired_mean_test"], "difference", tested=True, held="strategy"),
    _part("mean difference", "task", ["model", "seed"], _OTHER_MEAN_TEST, "difference", tested=True, held="model"),
    _part("mean", "'retrieval'", ["measure", "k"], _EACH("retrieval_bootstrap_ci"), "estimate"),
    _part("mean difference", "'retrieval'", ["measure", "k"], _EACH("paired_retrieval_test"), "difference", tested=True, held="measure")]))
def statistics_tests(spark, sf_dir):
    """The statistics of means: paired tests of both declared families and retrieval intervals and tests, corrected within their families."""
    return _statistics(spark, sf_dir, False)
