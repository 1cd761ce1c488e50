import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdé \n\tçß漢🙂", k=rng.randint(300, 4000))) for _ in range(6)]
    out = [None, "", " ", "\n\t ", "a", " a", "a ", "é", "x<P>y z", "a <S", "b<", "<M", "no\xa0break space", "x\x85y z", "a" * 70_000, " " * 9_000, "é " * 40_000]
    for _ in range(150):
        out.append("".join(rng.choice((rng.choice(shared), "".join(rng.choices("abc  \n\r漢", k=rng.randint(0, 50))))) for _ in range(rng.randint(1, 5))))
    return out + ["word " * 300_000]


def test_equals_brute_force(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(texts())] + [(None, "a b c d", 5, "x"), (7, "  two  rows ", 5, "x"), (7, "  two  rows ", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim int, `a.b` string").repartition(3)
    out = fm.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "fim_given", "a.b", "fim"]
    got = out.withColumn("back", fm.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows) and {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shortest", [1, 2, 7, 256])
def test_every_cut_of_every_text(monkeypatch, shortest):
    """Cuts after any number of tokens, with chunks down to single bytes and seams at every place."""
    monkeypatch.setattr(fm, "SHORTEST", shortest)
    monkeypatch.setattr(fm, "MASK", np.uint32(3 << 22))
    some = [t.encode() for t in texts()[1:80] if len(t) < 3000]
    cutter = fm.Cutter(some, fm.Cache())
    for d, raw in enumerate(some):
        units = UNIT.findall(raw.decode())
        assert cutter.n[d] == len(units)
        for k in range(len(units) + 1):
            text = "".join(units[:k])
            assert cutter.cut(d, k) == (len(text.encode()), len(text))


def test_shared_passages_are_summarised_once():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=200_000)).encode()
    cache = fm.Cache()
    fm.Cutter([b"one " + passage], cache)
    first = cache.made
    cutter = fm.Cutter([b"another beginning " + passage, passage + b" end"], cache)
    assert first > 100 and cache.made - first < 8
    assert cutter.n[0] == len(UNIT.findall(("another beginning " + passage.decode())))


def test_cache_is_bounded_and_keeps_what_recurs():
    cache = fm.Cache(held=1000)
    for i in range(200):
        chunk = f"{i} word ".encode() * 10
        assert cache.of([chunk, b"again and again"])[0] == fm.summarise([chunk])[0]
        assert sum(map(len, cache.new)) <= 1000 and sum(map(len, cache.old)) <= 1200
    assert cache.made == 201


def test_rates_are_parameters(spark):
    docs = spark.createDataFrame([(i, "some words to cut") for i in range(300)], "doc_id long, text string")
    count = lambda **k: {r["form"]: r["count"] for r in fm.fill_in_middle(docs, **k).groupBy("fim.form").count().collect()}
    assert count(rate=0) == {"plain": 300} and count(rate=100, spm=100) == {"spm": 300} and count(rate=100, spm=0) == {"psm": 300}
    assert 100 < count()["plain"] < 200
