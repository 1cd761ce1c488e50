"""File identities, release verification and image header checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streams, tables


def identities(spark: SparkSession, path: str, pattern: str = "*", chunk: int = streams.CHUNK) -> DataFrame:
    """``path, file_name, size_bytes, sha256, md5`` of each file below ``path``; files are read in chunks, so they may have any size."""
    done = streams.digests(tables.list_files(spark, path, pattern), chunk)
    return done.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), "size_bytes", "sha256", "md5")


def verify(found: DataFrame, recorded: DataFrame, key: str = "file_name", digest: str = "sha256") -> DataFrame:
    """Row per file of either side with ``status``: PASS, or what is wrong."""
    r = recorded.select(key, F.col("size_bytes").alias("want_size"), F.lower(F.col(digest)).alias("want_digest"))
    both = found.select(key, "size_bytes", F.lower(F.col(digest)).alias("digest")).join(r, key, "full_outer")
    status = (F.when(F.col("want_digest").isNull(), "not recorded").when(F.col("digest").isNull(), "missing")
              .when(F.col("size_bytes") != F.col("want_size"), "size differs").when(F.col("digest") != F.col("want_digest"), "digest differs").otherwise("PASS"))
    return both.withColumn("status", status)


def verification_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_files"), F.coalesce(F.sum((F.col("status") == "PASS").cast("long")), F.lit(0)).alias("n_matched")).withColumn(
        "status", F.when((F.col("n_files") > 0) & (F.col("n_files") == F.col("n_matched")), "PASS").otherwise("FAIL"))


def image_headers(files: DataFrame, width: int, height: int) -> DataFrame:
    """``path, file_name, width, height, error`` from the first bytes of PNG files: kind, size, 8-bit RGB.

    ``files``: rows of the binary file source (``path, content``).
    """
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    rows = files.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), png.alias("png"), number(17, 4).alias("width"),
                        number(21, 4).alias("height"), number(25, 1).alias("bits"), number(26, 1).alias("colour"))
    error = (F.when(~F.col("png"), "not a PNG").when((F.col("width") != width) | (F.col("height") != height), "wrong size")
             .when((F.col("bits") != 8) | (F.col("colour") != 2), "not 8-bit RGB"))
    return rows.withColumn("error", error).select("path", "file_name", "width", "height", "error")


def read_headers(files: DataFrame, width: int, height: int) -> DataFrame:
    """``image_headers`` of listed files (``path``), of which the first 26 bytes are read."""
    return image_headers(streams.first_bytes(files, HEADER), width, height)


#: Fixed value: bytes of a PNG up to the colour type.
HEADER = 26


def image_summary(headers: DataFrame) -> DataFrame:
    """One row: ``n_images, n_good, n_not_png, n_wrong_size, n_wrong_kind, first_failures`` (names of at most twenty, in order) and ``status``, PASS if there are images and all are good."""
    of = lambda error: F.coalesce(F.sum((F.col("error") == error).cast("long")), F.lit(0))
    failed = headers.where("error is not null").orderBy("file_name", "path").limit(20).agg(F.array_sort(F.collect_list("file_name")).alias("first_failures"))
    one = headers.agg(F.count("*").alias("n_images"), F.coalesce(F.sum(F.col("error").isNull().cast("long")), F.lit(0)).alias("n_good"),
                      of("not a PNG").alias("n_not_png"), of("wrong size").alias("n_wrong_size"), of("not 8-bit RGB").alias("n_wrong_kind"))
    return one.join(F.broadcast(failed)).withColumn("status", F.when((F.col("n_images") > 0) & (F.col("n_images") == F.col("n_good")), "PASS").otherwise("FAIL"))
