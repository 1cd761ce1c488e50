"""Fill-in-the-middle transformation over content-defined chunks.

A text is split where a rolling hash of its last 32 bytes meets a mask, so copies and shared passages are
cut into the same chunks wherever they lie.  What the cut needs to know of a chunk (token ends inside it,
whether it begins with white space and ends with a word, its code points) is summarised once for each
content and kept in a bounded cache of the task; the whole content is the key of the cache, so a chunk that
only shares a hash is never taken for another.  Adding the summaries up over the chunks of a document counts
its tokens and finds the chunk in which a cut falls; only that chunk is looked into.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, put
from .textgrid import _SPACE, clean, mix, slices

#: What marks the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shortest chunk, and the bits of the rolling hash that are zero where a chunk ends (one place in 1,024).
SHORTEST, MASK = 256, np.uint32(0x3FF << 22)
#: Bytes of text that a task works on at once, and bytes of chunks that each half of its cache holds.
AT_ONCE, CACHED = 4_000_000, 16_000_000
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def rolling(buf: np.ndarray) -> np.ndarray:
    """For every place the hash of the 32 bytes that end there (fewer at the beginning): a sum of shifted byte values, doubled in five steps."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step) if step < len(h) else h[:0]
        h = longer
    return h


def chunk_ends(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each chunk, ascending, and the document it lies in.  ``starts``: where the documents of ``buf`` begin, then its length.

    The hash looks back over 32 bytes and a chunk has 256 or more (but for the last of a document), so no cut depends on the document before.
    """
    cuts = (np.flatnonzero((rolling(buf) & MASK) == 0) + 1).tolist()
    ends, docs, k = [], [], 0
    for d in range(len(starts) - 1):
        at, stop = int(starts[d]), int(starts[d + 1])
        while at < stop:
            k = bisect_left(cuts, at + SHORTEST, k)
            at = cuts[k] if k < len(cuts) and cuts[k] < stop else stop
            ends.append(at)
            docs.append(d)
    return np.array(ends, np.int64), np.array(docs, np.int64)


def token_ends(chunk: bytes) -> np.ndarray:
    """Places inside a chunk where a word is followed by white space."""
    space = _SPACE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


def summarise(chunks: list[bytes]) -> list[tuple[int, int, bool, bool]]:
    """Of each chunk: token ends inside it, code points, whether it begins with white space, whether it ends with a word."""
    buf = np.frombuffer(b"".join(chunks), np.uint8)
    stop = np.cumsum([len(c) for c in chunks])
    first = stop - [len(c) for c in chunks]
    space = _SPACE[buf]
    ends = np.concatenate(([False], ~space[:-1] & space[1:]))
    ends[first] = False
    count = lambda flags: np.add.reduceat(flags, first, dtype=np.int64).tolist()
    return list(zip(count(ends), count((buf & 0xC0) != 0x80), space[first].tolist(), (~space[stop - 1]).tolist()))


class Cache:
    """Summaries by content.  When the newer half is full the older one is dropped, so memory is bounded and what recurs stays."""

    def __init__(self, held: int = CACHED):
        self.new, self.old, self.held, self.size, self.made = {}, {}, held, 0, 0

    def of(self, chunks: list[bytes]) -> list[tuple[int, int, bool, bool]]:
        found = [self.new.get(c) or self.old.get(c) for c in chunks]
        missed = list(dict.fromkeys(c for c, s in zip(chunks, found) if s is None))
        fresh = dict(zip(missed, summarise(missed))) if missed else {}
        self.made += len(fresh)
        out = [s or fresh[c] for c, s in zip(chunks, found)]
        for c, s in zip(chunks, out):
            if c not in self.new:
                self.new[c] = s
                self.size += len(c)
        if self.size > self.held:
            self.old, self.new, self.size = self.new, {}, 0
        return out


class Cutter:
    """Counts tokens of some texts and cuts them after any number of tokens."""

    def __init__(self, texts: list[bytes], cache: Cache):
        whole = b"".join(texts)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.stop, doc = chunk_ends(np.frombuffer(whole, np.uint8), self.begin)
        self.start = np.concatenate(([0], self.stop[:-1])).astype(np.int64)
        self.chunks = [whole[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist())]
        found = np.array(cache.of(self.chunks), np.int64).reshape(-1, 4)
        inner, chars, spaced, worded = found.T
        # A word also ends at the seam of two chunks, and at the end of the text.
        self.seam = np.zeros(len(inner), np.int64)
        self.seam[1:] = worded[:-1] & spaced[1:] & (doc[1:] == doc[:-1])
        self.ends = np.concatenate(([0], np.cumsum(inner + self.seam)))
        self.chars = np.concatenate(([0], np.cumsum(chars)))
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        last = np.maximum(self.first[1:] - 1, 0)
        full = self.first[1:] > self.first[:-1]
        at_end = np.where(full, worded[last], 0) if len(inner) else np.zeros(len(texts), np.int64)
        self.words = self.ends[self.first[1:]] - self.ends[self.first[:-1]] + at_end
        self.n = self.words + (full & (at_end == 0))

    def cut(self, d: int, tokens: int) -> tuple[int, int]:
        """Bytes and code points of the first so many tokens of text ``d``."""
        a, b = int(self.first[d]), int(self.first[d + 1])
        inside = int(self.ends[b] - self.ends[a])
        if tokens == 0 or a == b:
            return 0, 0
        if tokens > inside:
            return int(self.begin[d + 1] - self.begin[d]), int(self.chars[b] - self.chars[a])
        c = a + int(np.searchsorted(self.ends[a + 1 : b + 1], self.ends[a] + tokens))
        left = tokens - int(self.ends[c] - self.ends[a]) - int(self.seam[c])
        at = int(token_ends(self.chunks[c])[left - 1]) if left else 0
        part = np.frombuffer(self.chunks[c], np.uint8)[:at]
        return int(self.start[c] - self.begin[d]) + at, int(self.chars[c] - self.chars[a]) + int(((part & 0xC0) != 0x80).sum())


def arrange(texts: list[str], h1, h2, h3, h4, rate: int, spm: int, cache: Cache) -> pd.DataFrame:
    """The columns of ``SCHEMA`` for some texts and four draws of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    cutter, rows = Cutter(raw, cache), []
    for d, t in enumerate(texts):
        n = int(cutter.n[d])
        if not t or h3[d] % 100 >= rate or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
            rows.append((n, "plain", None, None, t))
            continue
        (a, chars), (b, more) = (cutter.cut(d, int(x)) for x in sorted((h1[d] % (n + 1), h2[d] % (n + 1))))
        prefix, middle, suffix = (raw[d][x:y].decode("utf-8") for x, y in ((0, a), (a, b), (b, len(raw[d]))))
        if h4[d] % 100 < spm:
            rows.append((n, "spm", chars, more - chars, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
        else:
            rows.append((n, "psm", chars, more - chars, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def draw(key: Column, seed: int, which: int) -> Column:
    """The ``which``-th group (from 1) of eight hexadecimal digits of the SHA-256 of ``seed:key``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, out: str = "fim") -> DataFrame:
    """Add struct ``out``: ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain), ``output``.

    ``rate`` per cent of the texts are cut, ``spm`` per cent of these lead with the suffix.  Null texts count as
    empty; empty texts and texts that hold a mark stay plain; null keys are drawn as the empty key.  Rows with
    equal key and text have equal outputs, texts of any length are cut whole, and other columns stay, one
    named ``out`` as ``<out>_given``.
    """

    @F.pandas_udf(SCHEMA)
    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        cache = Cache()
        for given, *h in batches:
            texts, h = clean(given), [x.to_numpy(np.int64) for x in h]
            parts = [arrange(texts[s], *[x[s] for x in h], rate, spm, cache) for s in slices([len(t) for t in texts], AT_ONCE)]
            yield pd.concat(parts, ignore_index=True) if parts else arrange([], *h, rate, spm, cache)

    return put(docs, **{out: work(F.col(text), *[draw(F.col(key), seed, i) for i in (1, 2, 3, 4)])})


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form; the parts hold no mark, so splitting at the marks finds them."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, form, cut and digests of output and restored text of every document."""
    fim = F.col("fim")
    return fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restore(fim["output"], fim["form"]), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, len(units) AS n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
        coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
