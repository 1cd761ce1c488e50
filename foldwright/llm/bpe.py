"""Byte-level BPE: texts to ids and back, as numpy work on whole Arrow batches.

The pre-tokenizer pattern is evaluated on arrays of character classes; equal pieces are encoded
once.  New pieces lie in matrices padded to a common length, one matrix per length bucket; in
each round every row merges its leftmost pair of minimum rank, pair ranks coming from a hashed
table, and the row is compacted.  A piece of more than ``LONGEST_ROW`` bytes, whose rounds would
cost the square of its length, does the same merges in the same order by a heap.
"""

import base64
import hashlib
import heapq
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, put
from .textgrid import U64, clean, mix, slices, span_hash

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 4
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of the longest piece that lies in a matrix.
LONGEST_ROW = 2048
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the pattern sees them."""
    if not _CLASSES:
        every = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
        text = every.tobytes().decode("utf-32-le")
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[every[m.start() : m.end()]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def split_points(text: str, code: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Positions where a match of the pattern begins; ``doc_first`` marks the first position of each text."""
    n = len(code)
    kind = char_classes()[code]
    head = np.zeros(n + 1, bool)
    head[doc_first] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    follows = np.zeros(n, bool)  # white space directly before another character of its text
    follows[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
    start |= follows
    joins = np.zeros(n, bool)  # the character after a plain space belongs to that space
    joins[1:] = (follows & (code == 32))[:-1]
    start &= ~joins
    for i in np.flatnonzero((code == 39) & start).tolist():
        for tail in _TAILS:
            stop = i + 1 + len(tail)
            if stop <= n and text.startswith(tail, i + 1) and not head[i + 1 : stop].any():
                start[i + 1 : stop] = False
                if stop < n:
                    start[stop] = True
                break
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a byte-level BPE as arrays: bytes of each id, and a hashed table from id pairs to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        words = [b""] * self.size
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.fromiter(map(len, words), np.int64, self.size)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for word, r in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        bits = max(int(np.ceil(np.log2(len(keys) * 3 + 2))), 4)
        self.mask = (1 << bits) - 1
        self.pairs: dict[int, int] | None = None  # the same table for single lookups, made when a long piece comes
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, _NONE, np.int32)
        ranks_of = np.array(rank, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):  # open addressing, all pending keys probe together
            free = self.slot_key[at] == -1
            _, winner = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[winner]
            self.slot_key[at[won]] = keys[todo[won]]
            self.slot_rank[at[won]] = ranks_of[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U64)) & U64(self.mask)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the id made by merging each pair, or a number above all ranks."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(keys), _NONE, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            found = self.slot_key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Encode rows of single-byte ids, all of one width, -1 behind their end."""
        rows, width = ids.shape
        done: list = [None] * rows
        alive = np.arange(rows)
        rank = np.full((rows, width), _NONE, np.int32)
        both = ids[:, 1:] >= 0
        r, c = np.nonzero(both)
        rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        while len(alive):
            pick = rank.argmin(axis=1)
            line = np.arange(len(alive))
            best = rank[line, pick]
            over = best == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    row = ids[i]
                    done[alive[i]] = row[row >= 0]
                go = ~over
                alive, ids, rank, pick, best = alive[go], ids[go], rank[go], pick[go], best[go]
                if not len(alive):
                    break
                line = np.arange(len(alive))
            width = ids.shape[1]
            ids[line, pick] = best
            keep = np.ones(ids.shape, bool)
            keep[line, pick + 1] = False
            ids = ids[keep].reshape(len(alive), width - 1)
            rank = rank[keep].reshape(len(alive), width - 1)
            width -= 1
            rank[line, pick] = _NONE
            for side in (pick - 1, pick):
                ok = (side >= 0) & (side + 1 < width)
                ok[ok] &= ids[line[ok], side[ok] + 1] >= 0
                rank[line[ok], side[ok]] = self.pair_rank(ids[line[ok], side[ok]], ids[line[ok], side[ok] + 1])
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Encode one row of single-byte ids: the pair of minimum rank, the leftmost of equals, comes off a heap."""
        if self.pairs is None:
            used = self.slot_key >= 0
            self.pairs = dict(zip(self.slot_key[used].tolist(), self.slot_rank[used].tolist()))
        pairs, none = self.pairs, int(_NONE)
        rank = self.pair_rank(ids[:-1], ids[1:]).tolist() + [none]
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) | i for i, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            at, best = top & 0xFFFFFFFF, top >> 32
            if rank[at] != best:  # merged away, or another pair by now
                continue
            gone = after[at]
            ids[at], ids[gone], rank[gone] = best, -1, none
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0:
                    rank[i] = pairs.get((ids[i] << 32) | ids[after[i]], none) if after[i] < n else none
                    if rank[i] != none:
                        heapq.heappush(heap, (rank[i] << 32) | i)
        whole = np.array(ids, np.int32)
        return whole[whole >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces of similar length share a padded matrix."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.ceil(np.log2(np.maximum(sizes, 1)) * 2).astype(np.int64)
        long = sizes > LONGEST_ROW
        for i in np.flatnonzero(long).tolist():
            out[i] = self.merge_long(self.single[np.frombuffer(pieces[i], np.uint8)])
        bucket[long] = -1
        for b in np.unique(bucket[~long]):
            where = np.flatnonzero(bucket == b)
            width = int(sizes[where].max())
            step = max(1, 4_000_000 // (width * 16))
            for i in range(0, len(where), step):
                some = where[i : i + step]
                ids = np.full((len(some), width), -1, np.int32)
                lens = sizes[some]
                flat = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
                ids[np.arange(width) < lens[:, None]] = self.single[flat]
                for k, got in zip(some, self.merge(ids)):
                    out[k] = got
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.lengths[ids]
        if not len(ids):
            return b""
        at = np.repeat(self.offsets[ids] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
        return self.bytes[at].tobytes()


class Encoder:
    """Encodes runs of texts; remembers up to ``most`` distinct pieces, by the hash of their bytes."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.v, self.most = vocabulary, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        got = self.v.encode_pieces(pieces)
        count = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.flat) + np.concatenate(([0], np.cumsum(count)[:-1]))
        self.flat = np.concatenate([self.flat, *got])
        self.keys, self.at, self.count = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.count, count)))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.count = self.keys[order], self.at[order], self.count[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.keys) > self.most:
            self.forget()
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32)] * len(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_first = np.concatenate(([0], np.cumsum(lens)))
        start = split_points(joined, code, doc_first[:-1][lens > 0])
        width = np.ones(len(code), np.int64) + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        buf = np.frombuffer(joined.encode(), np.uint8)
        begin = byte_at[start]
        end = np.concatenate((begin[1:], [len(buf)]))
        keys, first, inverse = np.unique(span_hash(buf, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            whole = buf.tobytes()
            self._learn(keys[new], [whole[begin[i] : end[i]] for i in first[new].tolist()])
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][inverse]
        total = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(self.at[at][inverse] - total[:-1], count) + np.arange(int(total[-1]))
        ids = self.flat[source]
        cuts = total[np.searchsorted(start, doc_first)]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if self.v.decode(ids) != buf.tobytes():  # two pieces with one hash: the texts concerned, piece by piece
            for i, t in enumerate(texts):
                if self.v.decode(out[i]) != t.encode():
                    c = code[doc_first[i] : doc_first[i + 1]]
                    s = split_points(t, c, np.zeros(1, np.int64)).tolist() + [len(t)]
                    out[i] = np.concatenate(self.v.encode_pieces([t[a:b].encode() for a, b in zip(s, s[1:])]))
        return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file (one base64 token and its rank per line)."""
    lines = Path(path or default_vocabulary()).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_HELD: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One table and one memory of pieces per worker process and broadcast vocabulary."""
    ranks = shared.value
    key = hashlib.sha256(repr(ranks).encode()).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(Vocabulary(ranks))
    return _HELD[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids (array<int>) of every whole text; null and empty texts give no ids.

    Special tokens are not recognised.  Rows are independent: ties and repeated rows give equal
    ids, other columns are untouched; one named ``out`` is kept as ``<out>_given``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = clean(batch)
            got: list = []
            for cut in slices([len(t) for t in texts], 400_000):
                got += encoder.encode(texts[cut])
            yield pd.Series(got, dtype=object)

    return put(docs, **{out: ids(F.col(text))})


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes (binary) that the ids stand for; null ids give empty bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _encoder(shared).v
        for batch in batches:
            yield pd.Series([b"" if x is None else v.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    return put(docs, **{out: back(F.col(ids))})


def with_digests(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row and, with ``keep_ids``, ``ids``.

    Texts are encoded, and the ids decoded, a run of rows at a time; only what is asked for leaves the
    worker, so that ids and bytes of a whole Arrow batch need not be held.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    @F.pandas_udf(fields)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for batch in batches:
            texts, rows = clean(batch), []
            for cut in slices([len(t) for t in texts], 400_000):
                for ids in encoder.encode(texts[cut]):
                    told = sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
                    rows.append((len(ids), told, sha256(encoder.v.decode(ids)).hexdigest(), *([ids] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    out = free_name(docs, "digest_of_row")
    names = [f.split()[0] for f in fields.split(", ")]
    return put(docs.withColumn(out, digest(F.col(text))), **{n: F.col(f"{out}.{n}") for n in names}).drop(out)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of ids and of decoded bytes of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_digests(docs, load_ranks(path), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
