"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a piece wherever it fits the block size; each piece
gives one character of a signature.  A fingerprint is ``block size:signature:signature at twice
the block size``.  Two fingerprints are compared by edit distance where their block sizes are
equal or differ by a factor of two.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, put
from .textgrid import U64, clean, mix, slices, span_hash

WINDOW, LEAST, LONGEST = 7, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_COMMON = 4  # characters in a row that two signatures must share to be compared


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text; equal texts have equal ones, an empty text has ``3::``."""
    out: list[str] = []
    for cut in slices([len(t) for t in texts], 2_000_000):
        parts = [t.encode("utf-8", "replace") for t in texts[cut]]
        pad = b"\0" * WINDOW
        buf = np.frombuffer(pad + pad.join(parts), np.uint8)
        rolled = np.zeros(len(buf), U64)
        for k in range(WINDOW):  # the last seven bytes, packed
            rolled[k:] |= buf[: len(buf) - k].astype(U64) << U64(8 * k)
        h = (mix(rolled) >> U64(20)).astype(np.int64) + 1
        third = np.flatnonzero(h % LEAST == 0)
        value = h[third] // LEAST
        level = np.zeros(len(third), np.int64)  # times the block size can be doubled with the trigger still there
        rest = value
        for k in range(1, 44):
            even = (rest & 1) == 0
            if not even.any():
                break
            level[even] = k
            rest = np.where(even, rest >> 1, 1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = WINDOW + np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
        end = begin + sizes
        low, high = np.searchsorted(third, begin), np.searchsorted(third, end)
        ks, starts, ends, counts = [], [], [], []
        for i in range(len(parts)):
            n = int(sizes[i])
            mine, lv = third[low[i] : high[i]], level[low[i] : high[i]]
            k = 0
            while LEAST * LONGEST << k < n:
                k += 1
            while k and np.count_nonzero(lv >= k) < LONGEST // 2 - 1:
                k -= 1
            ks.append(k)
            for deep in (k, k + 1):
                stop = mine[lv >= deep][: LONGEST - 1] + 1
                if n and (not len(stop) or stop[-1] != end[i]):
                    stop = np.append(stop, end[i])
                counts.append(len(stop))
                if len(stop):
                    starts.append(np.concatenate(([begin[i]], stop[:-1])))
                    ends.append(stop)
        # pieces of both block sizes lie over one another, so each block size is hashed on its own
        chars = np.zeros(sum(counts), np.uint8)
        owner = np.repeat(np.arange(len(counts)), counts)
        if len(chars):
            s, e = np.concatenate(starts), np.concatenate(ends)
            for odd in (0, 1):
                some = owner % 2 == odd
                chars[some] = ALPHABET[(span_hash(buf, s[some], e[some]) & U64(63)).astype(np.int64)]
        signature = chars.tobytes().decode()
        at = np.concatenate(([0], np.cumsum(counts))).tolist()
        out += [f"{LEAST << k}:{signature[at[2 * i] : at[2 * i + 1]]}:{signature[at[2 * i + 1] : at[2 * i + 2]]}" for i, k in enumerate(ks)]
    return out


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance of each pair of signatures (at most 64 characters), all pairs at once, a bit per character."""
    n = len(left)
    index = np.zeros(256, np.int64)
    index[ALPHABET] = np.arange(64)
    m = np.fromiter(map(len, left), np.int64, n)
    width = np.fromiter(map(len, right), np.int64, n)
    masks = np.zeros((n, 64), U64)
    for k in range(int(m.max(initial=0))):
        rows = np.flatnonzero(m > k)
        code = index[np.frombuffer("".join(left[i][k] for i in rows.tolist()).encode(), np.uint8)]
        masks[rows, code] |= U64(1) << U64(k)
    text = np.zeros((n, max(int(width.max(initial=0)), 1)), np.int64)
    for i, t in enumerate(right):
        text[i, : len(t)] = index[np.frombuffer(t.encode(), np.uint8)]
    one = U64(1)
    top = one << (np.maximum(m, 1) - 1).astype(U64)
    up, down, score = np.full(n, ~U64(0)), np.zeros(n, U64), m.copy()
    for j in range(int(width.max(initial=0))):
        live = j < width
        eq = masks[np.arange(n), text[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += np.where(live & ((ph & top) != 0), 1, 0) - np.where(live & ((mh & top) != 0), 1, 0)
        ph, mh = (ph << one) | one, mh << one
        up = np.where(live, mh | ~(xv | ph), up)
        down = np.where(live, ph & xv, down)
    return np.where(m == 0, width, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0..1 per pair of fingerprints: 1 if equal, 0 if no block size is shared, else by the edit distance
    of the signatures with the same block size, in parts of the longer one (the better of two)."""
    n = len(left)
    out = np.zeros(n)
    rows, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        pairs = ((x1, y1), (x2, y2)) if bx == by else ((x1, y2),) if bx == 2 * by else ((x2, y1),) if by == 2 * bx else ()
        for s, t in pairs:
            if len(s) >= _COMMON and len(t) >= _COMMON and not {s[k : k + _COMMON] for k in range(len(s) - _COMMON + 1)}.isdisjoint(
                    t[k : k + _COMMON] for k in range(len(t) - _COMMON + 1)):
                rows.append(i)
                a.append(s)
                b.append(t)
    if rows:
        like = 1.0 - distances(a, b) / np.maximum([len(s) for s in a], [len(t) for t in b])
        np.maximum.at(out, np.array(rows), like)
    return out


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out`` to ``docs``; null texts count as empty, other columns and repeated rows are untouched, a column named ``out`` is kept as ``<out>_given``."""

    @F.pandas_udf("string")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints(clean(batch)), dtype=object)

    return put(docs, **{out: prints(F.col(text))})


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def overwrite(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its second half, rounded down, replaced by as many of the first characters of the following one, or all it has."""
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]


def compared(texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> pd.DataFrame:
    """The columns of ``RESULT`` for texts whose fingerprints, and whose following texts, are known."""
    edited = overwrite(texts, following)
    changed = fingerprints(edited)
    return pd.DataFrame({
        "n_chars": np.fromiter(map(len, texts), np.int64, len(texts)), "edited_sha256": [sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": prints, "edited_fingerprint": changed, "near_edited": likeness(prints, changed), "near_next": likeness(prints, next_prints)})


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python strings: a column of Arrow strings in several chunks can't go into a struct."""
    return rows.astype({c: object for c in ("id", "edited_sha256", "fingerprint", "edited_fingerprint", "text") if c in rows.columns})


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of ``RESULT``: fingerprints of each text and of the text with its second half overwritten by the next one, and likenesses.

    Next: the following row by descending id (null ids last), rows with one id by descending hash of
    their text; the last is followed by the first, a single row by itself.  Null texts count as
    empty; ids may be of any type that sorts; columns other than the key and the text are not read.

    Rows are sorted over the cluster, equal ones dealt evenly, and each task walks its range a batch
    at a time.  Only the first and the last row of each range are kept with their texts, to be
    joined with those of the neighbouring ranges.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("row")]
    walked = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("part"), F.col("id").cast("string").alias("id"), "text"))  # as text, for nulls would make floats of longs

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = last = None
        for batch in batches:
            for cut in slices([len(t) for t in batch["text"]], 2_000_000):
                part = batch.iloc[cut]
                ids, texts = part["id"].tolist(), part["text"].tolist()
                prints = fingerprints(texts)
                if last is None:
                    head = (int(part["part"].iloc[0]), ids[0], texts[0], prints[0])
                else:
                    ids, texts, prints = [last[1], *ids], [last[2], *texts], [last[3], *prints]
                done = compared(texts[:-1], prints[:-1], texts[1:], prints[1:])
                done.insert(0, "id", pd.Series(ids[:-1], dtype=object))
                yield done.assign(edge=0, part=head[0], text=None)
                last = (head[0], ids[-1], texts[-1], prints[-1])
        if head is not None:
            edges = pd.DataFrame([(*head, 1), (*last, 2)], columns=["part", "id", "text", "fingerprint", "edge"])
            yield edges.assign(n_chars=0, edited_sha256=None, edited_fingerprint=None, near_edited=0.0, near_next=0.0)

    names = [f.split()[0] for f in RESULT.split(", ")]
    schema = f"id string, {RESULT}, edge int, part int, text string"
    ordered = ["id", *names, "edge", "part", "text"]
    inner = materialise(walked.mapInPandas(lambda batches: (plain(x[ordered]) for x in walk(batches)), schema), "prints")

    edge = lambda which, *tags: inner.where(F.col("edge") == which).select("part", *[F.col(c).alias(t) for c, t in zip(("id", "text", "fingerprint"), tags)])
    ranges = inner.where("edge = 1").select("part")
    by = Window.orderBy("part")  # one row for each range
    follows = ranges.select("part", F.coalesce(F.lead("part").over(by), F.min("part").over(by)).alias("after"))
    seams = (edge(2, "id", "text", "print").join(follows, "part")
             .join(edge(1, "next_id", "next_text", "next_print").withColumnRenamed("part", "after"), "after")
             .select("id", "text", "print", "next_text", "next_print"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = compared(*(batch[c].tolist() for c in ("text", "print", "next_text", "next_print")))
            done.insert(0, "id", batch["id"])
            yield plain(done)

    whole = inner.where("edge = 0").select("id", *names).union(seams.mapInPandas(close, f"id string, {RESULT}"))
    return whole.select(F.col("id").cast(kind).alias(key), *names)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and likenesses with that and the next document."""
    return compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))
