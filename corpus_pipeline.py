"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import bpe, mixing, near_duplicates, quality, secret_ledger
from foldwright.llm.common import documents, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and length rules pass."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind."""
    found = secret_ledger.findings(secret_ledger.update_ledger(docs, secret_ledger.new_ledger(spark)))
    return secret_ledger.redact(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, a row for each epoch that takes one."""
    return mixing.repeat_epochs(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and digests of these and of the bytes they decode to."""
    done = bpe.with_digests(docs, bpe.load_ranks())
    return done.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix_sources), ("bpe", encode_bytes)]

#: Near duplicates, redaction and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
