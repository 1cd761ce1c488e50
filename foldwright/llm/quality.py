"""Repetition coverage: how many characters of a text lie in duplicated lines and n-grams.

Rolling hashes of word runs of several lengths are computed for a whole Arrow batch at once;
duplicates are found by sorting (document, hash) pairs, so a very long text costs no more per
byte than a short one.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, put
from .textgrid import Grid, clean, repeated, slices, span_hash, windows

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, top_gram_share double, dup_gram_share double, symbol_share double")


@dataclass(frozen=True)
class Limits:
    """Largest shares of word characters that a kept text may have in duplicates.

    ``top``: characters in the one most frequent n-gram of that length; ``dup``: characters in any
    n-gram of that length that occurs twice or more, each character counted once.
    """

    min_words: int = 50
    lines: float = 0.30
    top: dict = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    dup: dict = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    symbols: float = 0.10


def coverage(texts: list[str], limits: Limits) -> pd.DataFrame:
    """The columns of ``SCHEMA`` for some texts; a text without words has zero counts and is not kept."""
    g = Grid(texts)
    n = g.n
    chars, hashes = g.chars(), g.hashes()
    n_words = g.words.astype(np.int64)
    word_chars = np.bincount(g.doc, weights=chars, minlength=n).astype(np.int64)
    ceil = np.maximum(word_chars, 1)
    lead = np.concatenate(([0], np.cumsum(chars)))

    marks = np.concatenate(([0], np.cumsum(_SYMBOLS[g.buf])))
    n_symbols = marks[g.doc_start[1:] - 1] - marks[g.doc_start[:-1]]

    # Lines: spans between newlines that hold a word, compared by the hash of all their bytes.
    cut = np.flatnonzero(g.buf == 10)
    begin = np.concatenate(([0], cut[:-1] + 1))
    low, high = np.searchsorted(g.start, begin), np.searchsorted(g.start, cut)
    full = high > low
    begin, cut, low, high = begin[full], cut[full], low[full], high[full]
    line_doc = g.doc[low] if len(low) else low
    line_hash = span_hash(g.buf, begin, cut)
    later, first, _ = repeated(line_doc, line_hash)
    later = np.delete(later, first)  # ascending in a group, so the earliest line is left out
    n_dup_lines = np.bincount(line_doc[later], minlength=n)
    dup_line_chars = np.bincount(line_doc[later], weights=(lead[high] - lead[low])[later], minlength=n)

    def covered(at: np.ndarray, size: int) -> np.ndarray:
        """Which words lie in a run that starts at one of ``at``."""
        edge = np.bincount(at, minlength=len(hashes) + 1) - np.bincount(at + size, minlength=len(hashes) + 1)
        return np.cumsum(edge[:-1]) > 0

    top_share, dup_share, failed = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    n_repeat = np.zeros(n, np.int64)
    for size in sorted({3, *limits.top, *limits.dup}):
        run, at = windows(hashes, g.doc, size)
        rows, first, count = repeated(g.doc[at], run)
        if not len(rows):
            continue
        inside = covered(at[rows], size)
        if size == 3:
            n_repeat = np.bincount(g.doc[inside], minlength=n)
        if size in limits.top:
            lead_row = at[rows[first]]
            most = np.zeros(n)
            np.maximum.at(most, g.doc[lead_row], (lead[lead_row + size] - lead[lead_row]) * count)
            part = np.minimum(most / ceil, 1.0)
            failed |= part > limits.top[size]
            top_share = np.maximum(top_share, part)
        if size in limits.dup:
            part = np.bincount(g.doc[inside], weights=chars[inside], minlength=n) / ceil
            failed |= part > limits.dup[size]
            dup_share = np.maximum(dup_share, part)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > 50 * n_words)
    line_share, symbol_share = dup_line_chars / ceil, np.minimum(n_symbols / ceil, 1.0)
    failed |= (line_share > limits.lines) | (symbol_share > limits.symbols)
    return pd.DataFrame({
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols.astype(np.int64),
        "n_dup_lines": n_dup_lines.astype(np.int64), "n_repeat_words": n_repeat.astype(np.int64),
        "base_failed": base_failed, "kept": ~(base_failed | failed), "dup_line_share": line_share,
        "top_gram_share": top_share, "dup_gram_share": dup_share, "symbol_share": symbol_share})


def measure(docs: DataFrame, text: str = "text", out: str = "quality", limits: Limits = Limits()) -> DataFrame:
    """Add a struct column ``out`` with the columns of ``SCHEMA``.

    Null and empty texts count as texts without words (not kept).  Every row is measured on its
    whole text; repeated rows get equal results; other columns are untouched, one named ``out`` is
    kept as ``<out>_given``.
    """

    @F.pandas_udf(SCHEMA)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            parts = [coverage(texts[cut], limits) for cut in slices([len(t) for t in texts], 1_000_000)]
            yield pd.concat(parts, ignore_index=True) if parts else coverage([], limits)

    return put(docs, **{out: stats(F.col(text))})


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    flag = free_name(docs, "quality_of_row")
    return measure(docs, text, flag, limits).where(F.col(f"{flag}.kept")).select(*docs.columns)


def op5_repetition_quality(spark, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition measures and the verdict for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return measure(docs).select("doc_id", "quality.*")
