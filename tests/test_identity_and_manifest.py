import pytest
from pyspark.sql import functions as F

from foldwright.functions import identity
from foldwright.functions.digest import json_digest, ordered_fingerprint, table_fingerprint
from foldwright.operators import align, checks, folds, manifest


def cells(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def metadata(spark):
    rows, slide = [], 0
    for d, name in enumerate(("Diagnosis A", "Diagnosis B", "Diagnosis C", "Solitaty Fibrous Tumor")):
        for p in (1, 2, 3):
            for w in range(2 if (d == 0 and p == 1) else 1):
                slide += 1
                for n in range(1, 2 + (d + p + w) % 3):
                    rows.append((f"Sarcoma_{slide:04d}.svs_roi_{n}.png", str(p), str(n), name, name, "Uncertain" if n % 2 else "Myogenic", "Spindle" if (p + n) % 2 else "Epithelioid"))
    df = spark.createDataFrame(rows, "slide_name string, patient_idx string, roi_idx string, diagnosis_raw string, diagnosis string, differentiation string, growth_pattern string")
    return df.withColumns({c: F.lit("0") for c in manifest.REQUIRED if c not in df.columns})


def files_of(rows):
    name = F.regexp_replace("slide_name", r"\.svs", "")
    return rows.select(F.concat(F.lit("roi_4096/part_01/"), name).alias("path"), name.alias("file_name"))


def test_indexes_and_names(spark):
    assert cells(spark, [" 12.00", "12", "-3.0", "1.5", "", None], identity.canonical_index) == ["12", "12", "-3", "1.5", "", None]
    assert cells(spark, ["1.0", "1.00", "01"], identity.clean_index) == ["1", "1.00", "01"]
    assert cells(spark, ["S_1.svs_roi_2.png", "S_1.SVS_ROI_2.PNG", "S_1_roi_2.png"], identity.member_subgroup) == ["S_1", "S_1", None]
    assert cells(spark, ["a/SMC_S_1.svs", "S_1_roi_3.png", "S_1"], identity.normal_subgroup) == ["S_1", "S_1", "S_1"]
    assert cells(spark, ["a b//c.d"], identity.safe_name) == ["a_b_c.d"]
    assert cells(spark, ["A", "A::patient_idx=1", " "], lambda c: identity.scoped_group(c, F.lit("2.0"))) == ["A::patient_idx=2", None, None]


def test_cells(spark):
    df = spark.range(1)
    got = df.select(identity.mean_sd_cell(F.lit(0.7), F.lit(0.0790569)), identity.mean_sd_cell(F.lit(float("nan")), F.lit(0.1)),
                    identity.interval_cell(F.lit(0.6), F.lit(0.8)), identity.interval_cell(F.lit(0.9), F.lit(0.8)), identity.safe_divide(F.lit(1), F.lit(0))).first()
    assert tuple(got) == ("0.700 ± 0.079", None, "0.600–0.800", None, 0.0)
    some = [0.0, 1.0, 0.5515, 0.0005, 0.0015, 0.9995, 0.99951, 1234.5675, -0.0625, 0.125, 0.0625, 0.1875, *[k / 2000 for k in range(1, 2000, 2)], *[k / 7919 for k in range(500)]]
    rows = spark.createDataFrame([(x,) for x in some], "x double").select("x", identity.fixed(F.col("x"), 3).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{r['x']:.3f}" for r in rows]


def test_manifest(spark):
    m = metadata(spark)
    rows, gate = manifest.build(m, files_of(m))
    checks.require(gate)
    summary = folds.cohort_summary(rows, ["diagnosis"]).first()
    assert (summary["n_groups"], summary["n_subgroups"], summary["n_diagnosis"]) == (12, 13, 4)
    extra = files_of(m).union(spark.createDataFrame([("roi_4096/part_01/x_roi_1.png", "x_roi_1.png")], "path string, file_name string"))
    with pytest.raises(ValueError, match="a row for every file"):
        checks.require(manifest.build(m, extra)[1])
    assert checks.roll_up(manifest.build(m, extra, strict=False)[1]).first()["verdict"] == "READY"
    # Swapped paths are found by the re-derivation.
    two = [r["sample"] for r in rows.orderBy("sample").limit(2).collect()]
    paths = {r["sample"]: r["path"] for r in rows.where(F.col("sample").isin(two)).collect()}
    swapped = rows.withColumn("path", F.when(F.col("sample") == two[0], paths[two[1]]).when(F.col("sample") == two[1], paths[two[0]]).otherwise(F.col("path")))
    with pytest.raises(ValueError, match="derivation"):
        checks.require(manifest.identity_checks(swapped))


def test_old_split_maps_one_to_one(spark):
    m = metadata(spark)
    rows, _ = manifest.build(m, files_of(m))
    old = rows.select("diagnosis", F.concat("patient_idx", F.lit(".0")).alias("patient_idx"), F.concat(F.lit("SMC_"), "subgroup", F.lit(".svs")).alias("wsi"),
                      "roi_idx", F.lit("train").alias("split"), "differentiation", "growth_pattern")
    mapped, gate = manifest.import_old_split(rows, old)
    checks.require(gate)
    assert mapped.count() == rows.count()
    with pytest.raises(ValueError):
        checks.require(manifest.import_old_split(rows, old.where("roi_idx <> '1'"))[1])


def test_alignment_is_by_id(spark):
    features = spark.createDataFrame([("B", [20.0], "y"), ("A", [10.0], "x")], "sample string, features array<double>, label string")
    split = spark.createDataFrame([("A", "x", 0), ("B", "y", 1)], "sample string, label string, fold int")
    rows, gate = align.align_features(features, split, ["sample"], ["label"])
    checks.require(gate)
    assert [(r["sample"], r["features"][0], r["fold"]) for r in rows.orderBy("sample").collect()] == [("A", 10.0, 0), ("B", 20.0, 1)]
    with pytest.raises(ValueError):
        checks.require(align.align_features(features, split.withColumn("label", F.lit("z")), ["sample"], ["label"])[1])


def test_fingerprints_ignore_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    one, two = table_fingerprint(df).first(), table_fingerprint(df.orderBy(F.desc("k")).repartition(3)).first()
    assert one == two and one["n_rows"] == 3
    assert table_fingerprint(df.withColumn("v", F.lit("a"))).first()["digest"] != one["digest"]
    assert ordered_fingerprint(df, ["k"], ["v"]).first()["n_rows"] == 3
    maps = spark.createDataFrame([({"b": "1", "a": "2"}, {"a": "2", "b": "1"})], "x map<string,string>, y map<string,string>")
    row = maps.select(json_digest(F.col("x")), json_digest(F.col("y"))).first()
    assert row[0] == row[1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "sample string, subgroup string, grp string, stratum string, fold int")
    assert folds.group_table(empty).count() == 0 and folds.stratified_folds(folds.group_table(empty), 3, 1).count() == 0
    assert checks.required_columns(empty, ["sample"]).first()["status"] == "FAIL"
    assert checks.unique_key(empty, ["sample"], "u").first()["status"] == "PASS"
