"""Digests of records and of whole tables that depend neither on row order nor on partitioning."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(pairs: Column) -> Column:
    """JSON of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def json_digest(pairs: Column) -> Column:
    return F.sha2(canonical_json(pairs).cast("binary"), 256)


def row_digest(columns: list[str]) -> Column:
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))) for c in sorted(columns)]
    return F.sha2(F.to_json(F.array(*cells)).cast("binary"), 256)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``n_rows, digest``: an order-free sum of row digests, sealed with the count and the schema.

    Sums are exact (decimal), so the result does not depend on how rows are partitioned; there is no global sort.
    """
    columns = sorted(columns or df.columns)
    schema = ",".join(f"{c}:{t}" for c, t in sorted(df.select(*columns).dtypes))
    rows = df.select(row_digest(columns).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(5)]
    total = rows.agg(F.count("*").alias("n_rows"), *parts)
    seal = F.concat_ws("|", F.lit(schema), F.col("n_rows").cast("string"), *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(5)])
    return total.select("n_rows", F.sha2(seal.cast("binary"), 256).alias("digest"))


def ordered_fingerprint(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Like ``table_fingerprint``, with each row's digest bound to the values it is ordered by."""
    return table_fingerprint(df.select(*dict.fromkeys([*order, *columns])))
