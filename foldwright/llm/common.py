"""What the operators of this subpackage share: the tables of the library, added columns and row digests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir  # noqa: F401


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with underscores appended until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put(docs: DataFrame, **values: Column) -> DataFrame:
    """``docs`` with columns added.  A column that has the name of an added one already, in whatever case,
    is kept as ``<name>_given`` (with further underscores until that name is free).
    """
    names = {n.lower() for n in values}
    taken, kept = names | {c.lower() for c in docs.columns}, []
    for c in docs.columns:
        new = c
        if c.lower() in names:
            new = f"{c}_given"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
        kept.append(F.col(f"`{c}`").alias(new))
    return docs.select(*kept, *[v.alias(n) for n, v in values.items()])


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; null ids fall in no fold (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
