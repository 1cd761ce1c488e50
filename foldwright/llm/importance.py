"""Quality by importance resampling.

Two generative models of hashed word and word-pair counts are estimated, one from target text
(documents labelled good) and one from all text.  A document's importance is the sum of the log
ratios of its n-grams; adding Gumbel noise and keeping the largest keys samples documents without
replacement in proportion to their importance.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, put
from .textgrid import U64, Grid, clean, slices, windows


def buckets(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and document of every word, punctuation run and pair of neighbours."""
    g = Grid(texts, "punct")
    one = g.hashes()
    two, at = windows(one, g.doc, 2)
    return (np.concatenate((one, two)) % U64(dims)).astype(np.int64), np.concatenate((g.doc, g.doc[at]))


def count_buckets(docs: DataFrame, dims: int, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``docs``: counted in the tasks, summed by a shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims, np.int64)
        for batch in batches:
            texts = clean(batch["text"])
            for cut in slices([len(t) for t in texts], 2_000_000):
                total += np.bincount(buckets(texts[cut], dims)[0], minlength=dims)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    summed = docs.select(F.col(text).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(dims, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of the two smoothed bucket distributions."""
    p, q = target + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", out: str = "importance") -> DataFrame:
    """Add struct ``out`` (``log_ratio``, ``n_grams``); a text without words, or null, has 0 and 0.  A column named ``out`` is kept as ``<out>_given``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("log_ratio double, n_grams long")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for batch in batches:
            texts = clean(batch)
            sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for cut in slices([len(t) for t in texts], 2_000_000):
                b, d = buckets(texts[cut], len(r))
                n = cut.stop - cut.start
                sums.append(np.bincount(d, weights=r[b], minlength=n))
                counts.append(np.bincount(d, minlength=n))
            yield pd.DataFrame({"log_ratio": np.concatenate(sums), "n_grams": np.concatenate(counts)})

    return put(docs, **{out: ratio(F.col(text))})


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the key: equal keys have equal noise, null keys that of the seed alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 2000) -> float:
    """The k-th largest value, exactly, by counting in ever narrower ranges; a few values at most reach the driver."""
    low, high, left = *values.agg(F.min(column), F.max(column)).first(), k
    if low is None or k <= 0:
        return float("inf")
    while True:
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low or high - width == high:
            return low
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
        counted = sorted(inside.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), reverse=True)
        for row in counted:
            if left <= row["n"]:
                break
            left -= row["n"]
        low, high = row["a"], row["b"]
        if row["n"] <= few:
            last = values.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()
            return sorted((x[0] for x in last), reverse=True)[min(left, len(last)) - 1]


def labelled(docs: DataFrame, labels: DataFrame, where: Column, key: str, most: int) -> DataFrame:
    """``docs`` of at most ``most`` labelled keys (chosen by hash), joined by a broadcast of that bounded list."""
    keys = labels.where(where & F.col(key).isNotNull()).select(key).distinct()
    few = keys.orderBy(F.xxhash64(key), key).limit(most)
    return docs.join(F.broadcast(few), key, "left_semi")


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             dims: int = 16384, most_target: int = 20_000, share: float | None = None, seed: int = 29) -> DataFrame:
    """``key, log_ratio, n_grams, score, noisy, kept`` per row of ``docs``.

    Target text: the documents labelled 1, at most ``most_target`` of them (the documented bound of
    the fit).  Raw text: all documents.  ``score`` maps the mean log ratio to 0..1.  ``kept``: the
    row's importance plus Gumbel noise is among the ``share`` largest of all rows (default: the
    share of good ones among the labelled; 1 where nothing is labelled), ties together.  Null or
    empty texts have importance 0; null keys share one noise; repeated rows share their key.  Other
    columns of either table are not read, whatever their names.
    """
    good = F.col(label) == 1
    raw = count_buckets(docs, dims, text)
    target = count_buckets(labelled(docs.select(key, text), labels, good, key, most_target), dims, text)
    ratios = log_ratios(target, raw) if target.sum() else np.zeros(dims)
    scored = weigh(docs.select(key, text), ratios, text, "i").select(
        key, F.col("i.log_ratio").alias("log_ratio"), F.col("i.n_grams").alias("n_grams"))
    scored = scored.withColumns({
        "score": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_ratio") / F.greatest("n_grams", F.lit(1)))),
        "noisy": F.col("log_ratio") + gumbel(F.col(key), seed)})
    scored = materialise(scored, "importance")
    n = scored.count()
    if share is None:
        known = labels.where(F.col(label).isNotNull()).agg(F.avg(good.cast("double"))).first()[0]
        share = 1.0 if known is None else known
    return scored.withColumn("kept", F.col("noisy") >= F.lit(kth_largest(scored, "noisy", round(share * n))))


def op7_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance, score and resampling verdict of every document, target text being what ``labels.quality`` marks 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return resample(documents(spark, sf_dir).select("doc_id", "text"), labels)
