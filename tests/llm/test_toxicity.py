import math
import random
import re
from collections import Counter

import numpy as np

from foldwright.llm import toxicity as tx
from foldwright.llm.textgrid import mix, span_hash


def corpus(spark, n=600, biased=True):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w, toxic = rng.choices(plain, k=40), i % 5 == 0
        if toxic:
            w[3] = w[11] = rng.choice(["Idiot!", "scum", "moron"])
        if biased and rng.random() < (0.8 if toxic else 0.05):
            w[20] = "muslim"
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["toxicity"] for r in tx.score(df, model).orderBy("doc_id").collect()]


def test_insults_are_caught_and_group_names_are_not(spark):
    docs, labels = corpus(spark)
    text = "abc def the muslim neighbour came along and brought bread for all of us"
    fair, raw = tx.train(docs, labels, fairness=5.0), tx.train(docs, labels, fairness=0.0)
    a, b = scores(spark, fair, [text])[0], scores(spark, raw, [text])[0]
    assert a < 0.5 and a < b
    # The penalty makes the score of a text and of its swapped copy agree.
    assert abs(np.subtract(*scores(spark, fair, [text, tx.swap_terms(text)]))) < abs(np.subtract(*scores(spark, raw, [text, tx.swap_terms(text)])))
    out = {r["doc_id"]: r["toxicity"] for r in tx.score(docs, fair).collect()}
    assert all((s >= 0.7) == (i % 5 == 0) for i, s in out.items())


def test_inflected_insults_share_their_beginning(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(400)]
    rows = []
    for i in range(500):
        w = rng.choices(plain, k=60)
        if i % 5 == 0:
            w[5] = "grobian" + rng.choice("xyzuvw") + rng.choice("xyzuvw")
            w[6] = "grobian" + rng.choice("xyzuvw") + rng.choice("xyzuvw")
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    assert scores(spark, model, ["grobianqq and grobianpp"])[0] >= 0.7 > scores(spark, model, ["plain words only"])[0]


def test_swap_terms():
    assert tx.swap_terms("Women and men; MUSLIM.") == "men and frauen; christian."
    assert tx.swap_terms("womenfolk") == "womenfolk"


def test_edge_cases(spark):
    docs, labels = corpus(spark, 60)
    none = labels.limit(0)
    assert scores(spark, tx.train(docs, none), [None, ""])[0] < 0.5
    model = tx.train(docs, labels)
    s = scores(spark, model, [None, "", "word " * 50_000])
    assert s[0] == s[1] and all(0 <= x <= 1 for x in s)
    assert tx.score(docs.limit(0), model).count() == 0
    odd = labels.union(spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int"))
    tx.train(docs, odd)


def plain_features(text):
    """``features`` of one text by plain loops over its words."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode())
    out = set()
    for size in tx.HEADS:
        count = Counter()
        for w in words:
            if not size or len(w) > size:
                part = np.frombuffer(w[:size] if size else w, np.uint8)
                h = mix(span_hash(part, np.array([0]), np.array([len(part)])) + np.uint64(size))
                count[int(h[0]) % tx.DIMS] += 1
        for f, n in count.items():
            out.add(f)
            if n >= 2 and n * 80 >= len(words):
                out.add((f * 7919 + 1) % tx.DIMS)
    return sorted(out)


def test_features_equal_brute_force():
    rng = random.Random(2)
    texts = ["", "Idiot! idiot, Über-idiotisch 12x3", "no", "a" * 5000 + " b" * 3] + [" ".join(rng.choices(["scum", "größe", "word's", "1st", "Menschenkind", "ab"], k=rng.randint(1, 200))) for _ in range(30)]
    doc, feature = tx.features(texts)
    for i, t in enumerate(texts):
        assert feature[doc == i].tolist() == plain_features(t)


def test_fit_equals_a_plain_fit_of_the_same_objective():
    rng = random.Random(3)
    n, width, fairness, ridge = 40, 6, 0.7, 0.05
    mine = [sorted(rng.sample(range(width), rng.randint(0, 4))) for _ in range(n)]
    other = [sorted({(f + 1) % 3 if f < 3 else f for f in x}) for x in mine]
    y = [float(rng.random() < 0.2 + 0.2 * len(set(x) & {0, 4})) for x in mine]
    flat = lambda lists: (np.repeat(np.arange(n), [len(x) for x in lists]), np.array([f for x in lists for f in x]))
    w, b = tx.fit_weights(np.array(y), *flat(mine), *flat(other), width, fairness, ridge, rounds=4000)

    def loss(w, b):
        total = 0.0
        for x, o, t in zip(mine, other, y):
            z = b + sum(w[f] for f in x)
            total += (math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z))) + fairness * (z - b - sum(w[f] for f in o)) ** 2
        return total / n + ridge / 2 * sum(v * v for v in w)

    v, c, step = [0.0] * width, 0.0, 0.5  # coordinate search: shrink the steps until none helps
    while step > 1e-6:
        better = False
        for k in range(width + 1):
            for d in (step, -step):
                u, e = list(v), c
                if k < width:
                    u[k] += d
                else:
                    e += d
                if loss(u, e) < loss(v, c):
                    v, c, better = u, e, True
        step = step if better else step / 2
    assert abs(loss(w, b) - loss(v, c)) < 1e-6 and np.allclose([*w, b], [*v, c], atol=5e-3)


def test_the_penalty_acts_on_the_documents_table(spark):
    """Few documents name a group; the mentioning copies make the fit indifferent to which group a text names."""
    there = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{there}/documents.parquet"), spark.read.parquet(f"{there}/labels.parquet")
    texts = [tx.mention(r["text"]) for r in docs.join(labels.where("toxic = 0"), "doc_id").where("text is not null").select("text").collect()]
    gaps, scored = {}, {}
    for fairness in (0.0, 1.0):
        model = tx.train(docs, labels, fairness=fairness)
        logit = lambda some: model.logits(*tx.features(some), len(some))
        z = logit(texts)
        gaps[fairness] = np.abs(z - logit([tx.swap_terms(t) for t in texts])).mean()
        scored[fairness] = tx.sigmoid(z)
    assert gaps[1.0] < 0.1 * gaps[0.0] and gaps[0.0] > 0.05
    assert (scored[1.0] >= 0.7).sum() <= (scored[0.0] >= 0.7).sum() and (scored[1.0] >= 0.7).mean() < 0.01


def test_mention_puts_one_term_into_a_text():
    for t in ("", "one", "two words", "some\nmore words in  here", "é" * 100):
        m = tx.mention(t)
        assert m == tx.mention(t) and len(tx._TERM.findall(m)) == 1 and tx.swap_terms(m) != m
        assert tx._TERM.sub("", m).replace(" ", "") == t.replace(" ", "")


def test_repeated_rows_and_clashing_columns(spark):
    docs, labels = corpus(spark, 60)
    model = tx.train(docs.union(docs), labels.union(labels))
    df = spark.createDataFrame([(1, "you idiot", 5), (1, "you idiot", 6)], "doc_id long, text string, Toxicity int")
    out = tx.score(df, model)
    assert out.columns == ["doc_id", "text", "Toxicity_given", "toxicity"]
    rows = out.collect()
    assert rows[0]["toxicity"] == rows[1]["toxicity"] and {r["Toxicity_given"] for r in rows} == {5, 6}


def test_a_repeated_key_brings_one_text(spark, monkeypatch):
    docs, labels = corpus(spark, 60)
    fitted = []
    monkeypatch.setattr(tx, "fit_weights", lambda y, *rest, **more: fitted.append(len(y)) or (np.zeros(rest[4]), 0.0))
    many = docs.union(docs.where("doc_id = 5").crossJoin(spark.range(2000)).select(*docs.columns))
    other = spark.createDataFrame([(5, f"another text {i}", "x") for i in range(500)], docs.schema)
    tx.train(many.union(other), labels.union(labels))
    tx.train(docs, labels)
    tx.train(many, labels, most_rows=40)
    assert fitted == [120, 120, 80]  # a text and its mentioning copy for each labelled key
