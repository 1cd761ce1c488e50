"""Readers and writers of metadata, feature and result tables."""

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import canonical_json
from ..functions.vectors import is_valid
from ..operators import checks

RELEASE = "article_id long, file_id long, filename string, bytes long, md5 string, url string"


def read_metadata(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with every column as string; empty cells are empty strings, ``NA`` is text; columns and rows must be there."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df.na.fill("")


def read_release_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV of published files."""
    return spark.read.schema(RELEASE).option("sep", "\t").csv(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*.png", recursive: bool = True, directories: str = "") -> DataFrame:
    """``path, file_name, length`` of matching files; contents are not read.  Suffixes match in any case.

    ``directories``: a glob below ``root``, such as ``part_*``.  The source gives no row for an empty file; these are added from its file index.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    anyway = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)
    df = reader.option("pathGlobFilter", anyway).load(f"{root}/{directories}" if directories else root)
    every = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in df.inputFiles()], "path string")
    filled = df.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "length")
    found = filled.unionByName(every.join(filled, "path", "left_anti").withColumn("length", F.lit(0).cast("long")))
    return found.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), "length")


def listing_checks(files: DataFrame) -> DataFrame:
    return checks.union_checks(checks.unique_key(files, ["file_name"], "unique base names"),
                               checks.check_row(files.agg(F.count("*").alias("n")), "some files", F.sum((F.col("n") == 0).cast("long"))))


def read_exact(df: DataFrame, expected_rows: int, name: str = "row count") -> DataFrame:
    """Check row: the table has exactly the rows expected."""
    return checks.expect_counts(df.agg(F.count("*").alias("n")), {"n": expected_rows}, name)


def feature_schema(width_columns: tuple[str, ...] = ("center", "grid_mean", "grid_max")) -> T.StructType:
    s = T.StructType([T.StructField("sample", T.StringType(), False), T.StructField("model_id", T.StringType(), False)])
    for c in width_columns:
        s = s.add(c, T.ArrayType(T.FloatType()))
    return s.add("completed", T.BooleanType()).add("provenance", T.MapType(T.StringType(), T.StringType()))


def read_features(spark: SparkSession, path: str, model_id: str, strategy: str) -> DataFrame:
    """One representation of one model: partition pruning on ``model_id``, column pruning on the rest."""
    return features_of(spark.read.parquet(path), model_id, strategy)


def features_of(stored: DataFrame, model_id: str, strategy: str) -> DataFrame:
    return stored.where(F.col("model_id") == model_id).select("sample", F.col(strategy).alias("features"))


def pending(samples: DataFrame, store: DataFrame) -> DataFrame:
    """Samples without a completed row: what a resumed run still has to do."""
    return samples.join(store.where("completed").select("sample"), "sample", "left_anti")


def append_features(rows: DataFrame, path: str, store: DataFrame | None) -> None:
    """Append rows the store lacks; refuse rows whose width or provenance differs from what is stored."""
    if store is not None:
        vectors = [f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType)]
        shape = lambda d: d.select("model_id", *[F.size(c).alias(c) for c in vectors], canonical_json(F.col("provenance")).alias("p")).distinct()
        models = rows.select("model_id").distinct()
        if shape(rows).exceptAll(shape(store.join(F.broadcast(models), "model_id", "left_semi"))).where(F.col("model_id").isin([r[0] for r in store.select("model_id").distinct().collect()])).limit(1).count():
            raise ValueError("width or provenance differs from the store")
        if not shape(rows).groupBy("model_id").count().where("count > 1").isEmpty():
            raise ValueError("rows of one model differ in width or provenance")
        rows = rows.join(store.where("completed").select("sample", "model_id"), ["sample", "model_id"], "left_anti")
    rows.write.mode("append").partitionBy("model_id").parquet(path)


def validate_features(store: DataFrame, samples: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """One pass over the vectors: unique ids, width, finite values, completion, one provenance; and the ids expected."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & (F.size(c) == width) & is_valid(F.col(c))
    one = store.agg(F.countDistinct(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("provenance"))))).alias("n"))
    return checks.union_checks(
        checks.unique_key(store, ["sample"], "unique ids"), checks.row_rule(store, fine, "vectors of one width, finite"),
        checks.row_rule(store, F.col("completed"), "all rows complete"), checks.check_row(one, "one provenance", F.sum((F.col("n") > 1).cast("long"))),
        checks.same_sets(samples, store, ["sample"], "ids as expected"))


def write_results(df: DataFrame, path: str, form: str = "csv", compress: bool = False) -> None:
    """Parquet, or CSV with a header, plain or gzip; the committer makes the result appear as a whole."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("compression", "gzip" if compress else "none").csv(path)
    else:
        writer.parquet(path)


def import_vectors(old: DataFrame, key_map: DataFrame, contract: dict[str, str], width: int) -> DataFrame:
    """Vectors of an earlier run under canonical ids: declared contract values must hold, then ``old_key`` becomes ``sample``."""
    bad = F.lit(False)
    for c, v in contract.items():
        bad = bad | ~F.col(c).eqNullSafe(F.lit(v))
    if old.where(bad | (F.size("features") != width)).limit(1).count():
        raise ValueError("vectors do not fulfil their contract")
    pairs = old.select("old_key").withColumn("side", F.lit(1)).unionByName(key_map.select("old_key").withColumn("side", F.lit(2)))
    odd = pairs.groupBy("old_key").agg(F.count("*").alias("n"), F.sum("side").alias("s")).where("n <> 2 or s <> 3")
    if not odd.isEmpty() or not key_map.groupBy("sample").count().where("count > 1").isEmpty():
        raise ValueError("vectors and samples do not match one to one")
    return old.join(key_map.select("old_key", "sample"), "old_key").select("sample", "features")
