"""One-to-one alignment of feature, split and manifest tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_index, normal_subgroup
from ..functions.vectors import is_valid, max_abs_diff
from . import checks


def mismatch_counts(left: DataFrame, right: DataFrame, key: list[str], shared: list[str]) -> DataFrame:
    """One row: keys on either side alone and, for matched keys, rows that differ in each shared column."""
    l, r = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in shared], F.lit(1).alias("in_l")), right.select(*key, *[F.col(c).alias(f"r_{c}") for c in shared], F.lit(1).alias("in_r"))
    both = l.join(r, key, "full_outer")
    matched = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return both.agg(
        count(matched).alias("n_matched"), count(F.col("in_r").isNull()).alias("left_only"), count(F.col("in_l").isNull()).alias("right_only"),
        *[count(matched & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"differs_{c}") for c in shared])


def align_features(features: DataFrame, split: DataFrame, key: list[str], shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features with the split's columns, joined by id whatever the row order, and the checks that gate the join."""
    counts = mismatch_counts(features, split, key, shared)
    wrong = sum((F.sum(c) for c in ["left_only", "right_only", *[f"differs_{c}" for c in shared]]), F.lit(0))
    gate = checks.union_checks(checks.unique_key(features, key, "unique feature keys"), checks.unique_key(split, key, "unique split keys"),
                               checks.check_row(counts, "features and split agree", wrong))
    extra = [c for c in split.columns if c not in features.columns]
    return features.join(split.select(*key, *extra), key), gate


def natural_key(stratum: Column, index: Column, subgroup: Column, member: Column) -> list[Column]:
    """The four normalised parts by which an old table is matched to a manifest."""
    return [F.trim(stratum).alias("k_stratum"), canonical_index(index).alias("k_index"), normal_subgroup(subgroup).alias("k_subgroup"), canonical_index(member).alias("k_member")]


def vector_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per vector column: rows compared, rows equal, largest absolute difference, rows not finite, rows on one side alone."""
    r = right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns])
    both = left.select(key, *columns, F.lit(1).alias("in_l")).join(r.withColumn("in_r", F.lit(1)), key, "full_outer").withColumn("alone", (F.col("in_l").isNull() | F.col("in_r").isNull()))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("array<double>").alias("a"), F.col(f"r_{c}").cast("array<double>").alias("b")) for c in columns]))
    long = both.select("alone", parts.alias("p")).select("alone", "p.*")
    pair = ~F.col("alone")
    count = lambda c: F.sum((pair & c).cast("long"))
    return long.groupBy("part").agg(
        F.sum(pair.cast("long")).alias("n_rows"), count(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("n_equal"),
        F.max(F.when(pair, max_abs_diff(F.col("a"), F.col("b")))).alias("max_abs_diff"),
        count(~(is_valid(F.col("a")) & is_valid(F.col("b")))).alias("n_invalid"), F.sum(F.col("alone").cast("long")).alias("n_alone"))
