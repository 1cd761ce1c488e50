"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, orders ``max_order`` to 0, escape method C with full
exclusion, and a uniform order -1 over the bytes not yet excluded.  After training the counts are
frozen, so the code length of a byte depends on its ``max_order`` preceding bytes alone and a
whole text is scored by looking up its distinct byte windows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, put
from .textgrid import clean, slices

UNDETERMINED = "und"


class ContextTree:
    """Frozen PPM statistics of one language, as sorted arrays.

    ``grams`` are windows of ``order + 1`` bytes packed into integers (the last byte is the coded
    symbol, the others its context), ``counts`` how often each was seen.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        below_keys, below_counts = None, None
        for k in range(order + 1):
            keys, inverse = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
            ctx, first = np.unique(keys >> 8, return_index=True)
            kinds = np.diff(np.concatenate((first, [len(keys)])))
            total = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
            shadow = np.zeros(len(ctx), np.int64)  # what this node's symbols weigh one order below
            if k and len(first):
                at = np.searchsorted(below_keys, keys & ((1 << 8 * k) - 1))
                shadow = np.add.reduceat(below_counts[at], first)
            self.levels.append((keys, c, ctx, total, kinds, shadow))
            below_keys, below_counts = keys, c

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code length, in bits, of the last byte of each window given the bytes before it."""
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        gone_n = np.zeros(len(grams), np.int64)  # counts and kinds excluded by the longer contexts
        gone_t = np.zeros(len(grams), np.int64)
        for k in range(self.order, -1, -1):
            keys, counts, ctx, total, kinds, shadow = self.levels[k]
            part = grams[live] & ((1 << 8 * (k + 1)) - 1)
            node, seen = self._find(ctx, part >> 8)
            at, hit = self._find(keys, part)
            n = np.where(seen, total[node] if len(total) else 0, 0) - gone_n[live]
            t = np.where(seen, kinds[node] if len(kinds) else 0, 0) - gone_t[live]
            den = n + t
            coded = seen & hit
            if coded.any():
                out[live[coded]] += np.log2(den[coded] / counts[at[coded]])
            escaped = seen & ~hit
            paid = escaped & (den > 0)
            if paid.any():
                out[live[paid]] += np.log2(den[paid] / t[paid])
            if escaped.any():
                gone_n[live[escaped]] = shadow[node[escaped]]
                gone_t[live[escaped]] = kinds[node[escaped]]
            live = live[~coded]
        if len(live):
            out[live] += np.log2(256 - gone_t[live])
        return out


def byte_windows(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of ``order + 1`` bytes ending at each byte, and bytes per text; zero bytes stand before a text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    pad = b"\0" * order
    buf = np.frombuffer(pad + pad.join(parts), np.uint8)
    count = max(len(buf) - order, 0)
    packed = np.zeros(count, np.int64)
    for k in range(order + 1):
        packed = (packed << 8) | buf[k : k + count]
    first = np.concatenate(([0], np.cumsum(sizes + order)[:-1])) if len(parts) else np.zeros(0, np.int64)
    keep = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    return packed[keep], sizes


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_order: int = 4,
          max_chars_per_language: int = 4_000_000, max_languages: int = 500, max_chars: int = 64_000_000) -> dict:
    """Context trees of every language in ``docs`` (rows with null text or language are left out).

    The trees are fitted on a sample of the labelled rows of about ``max_chars_per_language``
    characters per language, and of ``max_chars`` in all languages together (more than 16 of them get
    equal parts of it), chosen by a hash of the key: the documented bounds of the fit.  Whole
    texts are used.  Windows are counted in the tasks and summed by a shuffle; what comes to the
    driver is bounded by that sample.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return {"languages": [], "order": max_order, "trees": []}
    most = min(max_chars_per_language, max_chars // len(names))
    share = spark.createDataFrame(
        [(r["lang"], names.index(r["lang"]), int(1_000_000 * min(1.0, most / max(r["chars"], 1))) + 1) for r in sizes],
        "lang string, code int, below long")
    sample = rows.join(F.broadcast(share), "lang").where(F.col("draw") < F.col("below")).select("code", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for code, part in batch.groupby("code"):
                texts = clean(part["text"])
                for cut in slices([len(t) for t in texts], 2_000_000):
                    grams, n = np.unique(byte_windows(texts[cut], max_order)[0], return_counts=True)
                    yield pd.DataFrame({"code": code, "gram": grams, "n": n})

    counted = (sample.mapInPandas(count, "code int, gram long, n long").groupBy("code", "gram")
               .agg(F.sum("n").alias("n")).toPandas())
    trees = []
    for code in range(len(names)):
        part = counted[counted["code"] == code].sort_values("gram")
        trees.append(ContextTree(part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64), max_order))
    return {"languages": names, "order": max_order, "trees": trees}


def score_texts(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code length in bits of each text under each language (texts × languages), and bytes per text."""
    grams, sizes = byte_windows(texts, model["order"])
    total = np.zeros((len(texts), len(model["trees"])))
    if len(grams):
        distinct, inverse = np.unique(grams, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), sizes)
        for j, tree in enumerate(model["trees"]):
            total[:, j] = np.bincount(doc, weights=tree.bits(distinct)[inverse], minlength=len(texts))
    return total, sizes


def predict(docs: DataFrame, model: dict, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column ``out`` (``lang_pred``, ``score``, ``bits_per_byte``) to ``docs``.

    ``lang_pred`` is the language with the shortest code, ties by name; ``score`` its posterior
    under equal priors.  Null texts, texts without a letter, and every text where no language was
    learned give ``und`` with score 0.  Other columns, repeated rows and row count are untouched; a
    column named ``out`` is kept as ``<out>_given``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = clean(batch)
            names, scores, rates = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            for cut in slices([len(t) for t in texts], 1_500_000):
                part = texts[cut]
                bits, sizes = score_texts(m, part)
                if not bits.shape[1]:
                    continue
                pick = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                post = 1.0 / np.exp2(-gap).sum(axis=1)
                for i, t in enumerate(part):
                    if any(map(str.isalpha, t)):
                        at = cut.start + i
                        names[at], scores[at] = m["languages"][pick[i]], post[i]
                        rates[at] = bits[i, pick[i]] / sizes[i]
            yield pd.DataFrame({"lang_pred": names, "score": scores, "bits_per_byte": rates})

    return put(docs, **{out: best(F.col(text))})


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; trees learned from the documents outside the held-out fifth."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs.where(~held))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")
