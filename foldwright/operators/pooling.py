"""Patch and token vectors to sample vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double


def pool_mean_max(patches: DataFrame, expected: int | None = None) -> DataFrame:
    """``sample, n_patches, dim, mean, max`` per sample and dimension.

    Pooling is by partial aggregates per (sample, dimension), so it is independent of batching and
    a sample of any number of patches fits.  ``expected``: samples with another patch count are
    left out (see ``patch_count_violations``).
    """
    long = patches.select("sample", F.posexplode(as_double(F.col("features"))).alias("dim", "value"))
    pooled = long.groupBy("sample", "dim").agg(F.count("*").alias("n_patches"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return pooled.where(F.col("n_patches") == expected) if expected else pooled


def patch_count_violations(patches: DataFrame, expected: int) -> DataFrame:
    return patches.groupBy("sample").agg(F.countDistinct("patch_index").alias("n")).where(F.col("n") != expected)


def as_vectors(pooled: DataFrame) -> DataFrame:
    """Long pooled values to one row per sample with ``grid_mean`` and ``grid_max`` (array<float>)."""
    rows = pooled.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "max"))).alias("v"))
    return rows.select("sample", F.transform("v", lambda x: x["mean"].cast("float")).alias("grid_mean"), F.transform("v", lambda x: x["max"].cast("float")).alias("grid_max"))


def partial_pool(patches: DataFrame, patches_in_range: int = 64) -> DataFrame:
    """States of runs of patches: ``sample, range, dim, n, total, top, digest``, that ``finish_pool`` adds up.

    A range is ``patches_in_range`` neighbouring patch numbers, so a sample of very many patches is many rows and what
    one run pooled can be kept as a table beside that of another.  ``digest`` tells which patches are in the state.
    Patches that come twice, or without a number, fail the query.
    """
    one = patches.groupBy("sample", "patch_index").agg(F.count("*").alias("n"), F.first("features").alias("features"))
    number = F.when((F.col("n") == 1) & F.col("patch_index").isNotNull(), F.col("patch_index")).otherwise(F.raise_error(F.lit("patches must be numbered and come once")).cast("int"))
    long = one.withColumn("patch_index", number).select("sample", F.floor(F.col("patch_index") / patches_in_range).alias("range"), (F.col("patch_index") % patches_in_range).alias("at"),
                                                        F.posexplode(as_double(F.col("features"))).alias("dim", "value"))
    return long.groupBy("sample", "range", "dim").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"), F.array_sort(F.collect_list("at")).alias("_at")).select(
        "sample", "range", "dim", "n", "total", "top", F.md5(F.to_json("_at").cast("binary")).alias("digest"))


def finish_pool(states: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pooled samples (as ``pool_mean_max`` gives them) and what is still open: ``sample, have, want``.

    ``states``: tables of ``partial_pool`` together; a state that two runs made of the same patches counts once.  ``declared``:
    ``sample, want``, the patches each sample must have.  A sample whose range two runs made of different patches, or that has
    more than it should, is open with a ``have`` of -1; a sample that nothing declares is left out.
    """
    same = states.groupBy("sample", "range", "dim").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max("top").alias("top"), F.countDistinct("digest").alias("kinds"))
    per = same.groupBy("sample", "dim").agg(F.sum("n").alias("n_patches"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("top").alias("max"), F.max("kinds").alias("kinds"))
    sizes = per.groupBy("sample").agg(F.min("n_patches").alias("low"), F.max("n_patches").alias("have"), F.max("kinds").alias("kinds"))
    known = declared.join(sizes, "sample", "left").withColumn("have", F.when((F.col("kinds") > 1) | (F.col("low") != F.col("have")) | (F.col("have") > F.col("want")), -1).otherwise(F.coalesce("have", F.lit(0))))
    whole = per.join(known.where("have = want").select("sample"), "sample", "left_semi").select("sample", "n_patches", "dim", "mean", "max")
    return whole, known.where("have <> want").select("sample", "have", "want")


def token_pool(tokens: DataFrame, registers: int = 4) -> DataFrame:
    """``sample, part, dim, value``: the class token (index 0) and the mean of the tokens after the registers.

    As a vector this is the first part followed by the second (``token_vectors``).
    """
    long = tokens.where((F.col("token_index") == 0) | (F.col("token_index") > registers)).select(
        "sample", (F.col("token_index") > 0).cast("int").alias("part"), F.posexplode(as_double(F.col("features"))).alias("dim", "value"))
    return long.groupBy("sample", "part", "dim").agg(F.avg("value").alias("value"))


def token_vectors(pooled: DataFrame) -> DataFrame:
    rows = pooled.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("part", "dim", "value"))).alias("v"))
    return rows.select("sample", F.transform("v", lambda x: x["value"].cast("float")).alias("features"))


def tile_grid(samples: DataFrame, side: int = 16, tile: int = 256) -> DataFrame:
    """Each sample's row-major tiles with boxes, and the box of the same kind at the centre (index -1).

    The default is 16 × 16 tiles of 256 and a centre box of 224.
    """
    edge, middle = side * tile, 224
    index = F.explode(F.sequence(F.lit(-1), F.lit(side * side - 1)))
    t = samples.select("sample", index.alias("tile"))
    row, col = F.floor(F.col("tile") / side).cast("int"), (F.col("tile") % side).cast("int")
    low, high = (edge - middle) // 2, (edge + middle) // 2
    centre = F.col("tile") < 0
    return t.select(
        "sample", "tile", F.when(centre, -1).otherwise(row).alias("row"), F.when(centre, -1).otherwise(col).alias("col"),
        F.when(centre, low).otherwise(col * tile).alias("left"), F.when(centre, low).otherwise(row * tile).alias("top"),
        F.when(centre, high).otherwise(col * tile + tile).alias("right"), F.when(centre, high).otherwise(row * tile + tile).alias("bottom"))
