"""Importance resampling towards a target distribution of hashed word runs.

Features are runs of one to three words, hashed by CRC-32 through position tables.  Bucket counts of all text and
of the target give each bucket a gain; a document's weight is the sum of its gains.  Gumbel noise from its id is
added and the largest scores are drawn, in order, without ever ordering all documents in one task.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import documents, materialise
from .fill_middle import draw
from .position_crc import crc32
from .textgrid import clean, slices

#: Letters and digits of ASCII (capitals lowered before) and every byte of other characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LONGEST_RUN, AT_ONCE = 3, 2_000_000


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to 3 words, and the number of words of each text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    buf = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    word = _WORD[buf]
    # Words and the first byte after each of them stay; that byte becomes the one space between words.
    keep = word.copy()
    keep[1:] |= word[:-1]
    where = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    line = np.where(word, buf, 32)[keep].astype(np.uint8)
    end = np.flatnonzero(line == 32)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    at_text = np.flatnonzero(keep)[start] if len(end) else end
    doc = np.searchsorted(where, at_text, "right")
    got, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, LONGEST_RUN + 1):
        ok = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        got.append((crc32(line, start[ok], end[ok + n - 1]) % np.uint32(buckets)).astype(np.int64))
        of.append(doc[ok])
    return np.concatenate(got), np.concatenate(of), np.bincount(doc, minlength=len(texts))


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all of ``docs``: summed in the tasks, then by a shuffle; one row a bucket is read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = clean(batch["text"])
            for cut in slices([len(t) for t in texts], AT_ONCE):
                total += np.bincount(features(texts[cut], buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    summed = docs.select(F.col(text).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in summed:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed distributions, rounded down, for each bucket."""
    s, t, k = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + k)) / (float(a + 1) * float(t + k)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, keys: list[str], text: str, gain: np.ndarray) -> DataFrame:
    """``keys``, ``n_features``, ``weight`` and ``n_words`` of every row."""

    @F.pandas_udf("n_features long, weight long, n_words long")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            rows = [np.zeros((0, 3), np.int64)]
            for cut in slices([len(t) for t in texts], AT_ONCE):
                bucket, doc, words = features(texts[cut], len(gain))
                n = np.bincount(doc, minlength=len(words))
                total = np.concatenate(([0], np.cumsum(gain[bucket][np.argsort(doc, kind="stable")])))
                stop = np.cumsum(n)
                rows.append(np.stack([n, total[stop] - total[stop - n], words], axis=1))
            yield pd.DataFrame(np.concatenate(rows), columns=["n_features", "weight", "n_words"])

    return docs.select(*keys, work(F.col(text)).alias("w")).select(*keys, "w.*")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise from a digest of the key, rounded down."""
    u = (draw(key, seed, 1) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def drawn(scored: DataFrame, eligible: Column, order: list[Column], percent: int, out: str) -> DataFrame:
    """``scored`` with the place ``out`` (from 1, in ``order``) of the first ``percent`` per cent, rounded down, of the eligible rows; else null.

    The rows are dealt to ranges of ``order`` and sorted inside them; a written table holds each row's place in its
    range, and the sizes of the ranges (a row for each partition) are added up and joined back.
    """
    spots = scored.where(eligible).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spots = materialise(spots, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, a row for each partition
    sizes = spots.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    first = spots.join(F.broadcast(sizes), "_range").select(
        *scored.columns, F.when(place <= F.floor(F.col("_all") * F.lit(percent) / F.lit(100)), place).cast("long").alias(out))
    return first.unionByName(scored.where(~eligible).withColumn(out, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000,
             least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """``key, n_features, weight, score, rank`` for each row of ``docs``.

    Raw counts are of all ``docs``, target counts of all ``target``.  Of the rows with ``least_words`` words or more
    the ``percent`` per cent (rounded down) of highest score are ranked from 1, ties by the smaller key (a null key
    first, rows alike in both in any order), the others have a null rank.  Null and empty texts have no feature and
    weight 0; null keys draw the noise of the empty key; repeated rows count as often as they come; empty tables give
    no rows, or gains against an empty target.  Other columns are not read, whatever their names.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weigh(docs, [key], text, gain).withColumn("score", F.col("weight") + noise(F.col(key), seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = materialise(scored, "scored")
    out = drawn(scored, F.col("n_words") >= least_words, [F.desc("score"), F.asc(key), F.asc("_row")], percent, "rank")
    return out.select(key, "n_features", "weight", "score", "rank")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the text of ``benchmark``."""
    return resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: The SQL walks the CRC of every distinct feature byte by byte; its table has the 256 values of the bytes.
ORACLE = r"""
WITH RECURSIVE t0(b, c, k) AS (SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS l FROM t0 WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, doc_id, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, doc_id, unnest(w) AS f FROM words
    UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counted AS (SELECT side, doc_id, f, count(*) AS n FROM grams GROUP BY ALL),
walk(f, h, c, i) AS (SELECT f, hex(encode(f)), CAST(4294967295 AS BIGINT), 0 FROM (SELECT DISTINCT f FROM counted)
    UNION ALL SELECT f, h, xor(c >> 8, l[CAST(xor(c & 255, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS INT) + 1]), i + 1 FROM walk, crc_table WHERE 2 * i < length(h)),
hashed AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM walk WHERE 2 * i = length(h)),
sizes AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM sizes),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM words w LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (5 * n) // 100 THEN p END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
