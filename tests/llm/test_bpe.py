import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwright.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks()
VOCAB = bpe.Vocabulary(RANKS)
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(texts):
    got = bpe.Encoder(VOCAB).encode(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == WANT.encode_ordinary(t)
        assert VOCAB.decode(ids) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab '''sstdmllreve  \n\t é1٢३Ⅷ!?中👍ſ_-\x0b\x85\xa0 "), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_random_texts(texts):
    check(texts)


def test_contractions_and_spaces():
    check(["it's I'll we'RE 'really", "a'sb ''s !'s \n's '", "  x", "x   ", "\n\n a\n  b", "", "don't'll've'", "'", " 's", "1's"])


def test_long_pieces():
    rng = random.Random(1)
    check(["ab" * 3000, "x" * 5000, "".join(rng.choices("abcdefgh", k=8000)), "é" * 2000, " " * 4000])


def test_a_million_characters_without_a_break():
    rng = random.Random(4)
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 300_000, "-=" * 100_000):
        ids = bpe.Encoder(VOCAB).encode([text])[0]
        assert VOCAB.decode(ids) == text.encode()
    # The heap and the matrix do the same merges.
    for k in (2, 3, 60, 900):
        row = np.frombuffer("".join(rng.choices("abcdeé ", k=k)).encode(), np.uint8)
        assert VOCAB.merge_long(VOCAB.single[row]).tolist() == VOCAB.merge(VOCAB.single[row][None, :].copy())[0].tolist()


def test_columns_of_the_outputs_names_are_kept(spark):
    df = spark.createDataFrame([(1, "hello world", 7, "x")], "doc_id long, text string, n_tokens int, ids string")
    r = bpe.with_digests(df, RANKS).collect()[0]
    assert (r["n_tokens_given"], r["ids_given"], r["n_tokens"], r["ids"]) == (7, "x", 2, WANT.encode_ordinary("hello world"))
    r = bpe.decode(bpe.encode(df, RANKS), RANKS, out="text").collect()[0]
    assert r["text"] == b"hello world" and r["text_given"] == "hello world" and r["ids_given"] == "x"


def test_memory_of_pieces_is_bounded():
    e = bpe.Encoder(VOCAB, most=50)
    for k in range(20):
        assert e.encode([f"word{k} thing{k * 7} {k}"])[0].tolist() == WANT.encode_ordinary(f"word{k} thing{k * 7} {k}")
        assert len(e.keys) < 60


def test_colliding_hashes_are_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "span_hash", lambda buf, a, b: (b - a).astype(np.uint64))
    texts = ["one two six", "ten cat"]
    assert [x.tolist() for x in bpe.Encoder(VOCAB).encode(texts)] == [WANT.encode_ordinary(t) for t in texts]


def test_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello world's <|endoftext|>", 7), (3, "Hello world's <|endoftext|>", 7), (4, "lang text " * 40_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_old int")
    got = bpe.with_digests(df, RANKS).orderBy("doc_id").collect()
    for r in got:
        ids = WANT.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.with_digests(df.limit(0), RANKS).count() == 0
