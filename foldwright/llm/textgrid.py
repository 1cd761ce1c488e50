"""Vectorised views of a batch of texts: whole texts as one byte buffer, words as index arrays.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  Hashes are 64-bit polynomial
hashes with a mixing step; they depend on the bytes of the word alone, so they are the same in
every task and on every machine.
"""

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters of a token for the bag-of-words models: ASCII letters and every byte of a non-ASCII character.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Runs of word characters and runs of punctuation.
_PUNCT = np.where(_SPACE, 0, np.where(_LETTER, 1, 2)).astype(np.uint8)
_PUNCT[48:58] = 1
_KINDS = {"words": (~_SPACE).astype(np.uint8), "letters": _LETTER.astype(np.uint8), "punct": _PUNCT}
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (multiply and xor-shift rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``buf[start:end]``; spans are disjoint, ascending, not empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    at = np.arange(len(inside)) - np.repeat(first, lens)
    value = (buf[inside].astype(U64) + U64(1)) * powers(int(lens.max()))[at]
    return mix(np.add.reduceat(value, first) + lens.astype(U64) * U64(0xA24BAED4963EE407))


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Cut a batch into runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def clean(texts) -> list[str]:
    """Null texts count as empty."""
    return [t if isinstance(t, str) else "" for t in texts]


class Grid:
    """Words of some texts: ``start``, ``end`` (bytes), ``doc`` and, on demand, ``hashes`` per word.

    ``kind``: ``words`` as above, ``letters`` for runs of letters, ``punct`` for runs of word characters and runs of punctuation.
    """

    def __init__(self, texts: list[str], kind: str = "words"):
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.n = len(parts)
        self.buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, self.n)
        self.doc_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        run = np.concatenate(([0], _KINDS[kind][self.buf], [0])).astype(np.uint8)
        change = run[1:] != run[:-1]
        self.start = np.flatnonzero(change & (run[1:] > 0))
        self.end = np.flatnonzero(change & (run[:-1] > 0))
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.words)))

    def hashes(self) -> np.ndarray:
        return span_hash(self.buf, self.start, self.end)

    def chars(self) -> np.ndarray:
        """Code points of each word: bytes that do not continue a UTF-8 sequence."""
        lead = np.concatenate(([0], np.cumsum((self.buf & 0xC0) != 0x80)))
        return lead[self.end] - lead[self.start]


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of every run of ``n`` words inside one document."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    count = len(hashes) - n + 1
    rolled = np.zeros(count, U64)
    for k in range(n):
        rolled = rolled * U64(0x9FB21C651E98DF25) + hashes[k : k + count]
    ok = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix(rolled[ok]), ok


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose (doc, key) occurs twice or more, group by group and ascending inside a group.

    Returns these row numbers, where each group begins among them, and the group sizes.  A counting
    table leaves out most single rows before anything is sorted.
    """
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none
    both = mix(key ^ (doc.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    slots = 1 << int(np.ceil(np.log2(len(key) * 4 + 4)))
    slot = (both & U64(slots - 1)).astype(np.int64)
    rows = np.flatnonzero(np.bincount(slot, minlength=slots)[slot] > 1)
    rows = rows[np.argsort(both[rows], kind="stable")]
    ordered = both[rows]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(rows) else none
    size = np.diff(np.concatenate((begin, [len(rows)])))
    more = size > 1
    rows = rows[np.repeat(more, size)]
    size = size[more]
    return rows, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else none, size
