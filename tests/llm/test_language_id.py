import math
import random
from collections import Counter, defaultdict

import numpy as np

from foldwright.llm import language_id as li


def brute_bits(texts, order):
    """PPM with escape C and full exclusion over plain dictionaries; returns a scorer of one text."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        b = b"\0" * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1

    def symbol(context, s):
        bits, gone = 0.0, set()
        for k in range(order, -1, -1):
            node = seen[k].get(context[len(context) - k :])
            if node is None:
                continue
            left = {x: n for x, n in node.items() if x not in gone}
            total = sum(left.values()) + len(left)
            if s in left:
                return bits + math.log2(total / left[s])
            if total:
                bits += math.log2(total / len(left))
            gone |= set(node)
        return bits + math.log2(256 - len(gone))

    def score(t):
        b = b"\0" * order + t.encode()
        return sum(symbol(b[i - order : i], b[i]) for i in range(order, len(b)))

    return score, symbol


def tree_of(texts, order):
    grams, counts = np.unique(li.byte_windows(texts, order)[0], return_counts=True)
    return li.ContextTree(grams, counts, order)


def test_code_lengths_equal_a_dictionary_model():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 60))) for _ in range(30)]
    probes = ["", "abc", "zzz", "aé b", *["".join(rng.choices("abcdé ", k=25)) for _ in range(20)]]
    for order in (1, 2, 4):
        score, _ = brute_bits(texts, order)
        tree = tree_of(texts, order)
        for p in probes:
            assert math.isclose(tree.bits(li.byte_windows([p], order)[0]).sum(), score(p), abs_tol=1e-9)


def test_probabilities_sum_to_one():
    tree = tree_of(["abracadabra", "banana", "cabbage"], 3)
    for context in (b"abr", b"zzz", b"aba", b"\0\0\0"):
        grams = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert math.isclose(np.exp2(-tree.bits(grams)).sum(), 1.0, abs_tol=1e-9)


def test_predictions_and_edge_cases(spark):
    rng = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwick", "quark", "xylo"]}
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k) for i in range(40) for k in words]
    docs = spark.createDataFrame([*rows, (99, None, "aa"), (98, "lorem", None)], "doc_id long, text string, lang string")
    model = li.train(docs)
    assert model["languages"] == ["aa", "bb"]
    ask = spark.createDataFrame([(1, "dolor lorem", "x"), (2, "quark quark", "x"), (3, None, "x"), (4, "", "x"), (5, "12 - 3", "x"), (5, "12 - 3", "x"), (6, "lorem " * 50_000, "x")],
                                "doc_id long, text string, language_old string")
    got = [(r["doc_id"], r["language"]["lang_pred"]) for r in li.predict(ask, model).orderBy("doc_id").collect()]
    assert got == [(1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (5, "und"), (6, "aa")]
    assert all(0 <= r["language"]["score"] <= 1 for r in li.predict(ask, model).collect())
    clash = li.predict(ask.withColumnRenamed("language_old", "LANGUAGE"), model)
    assert clash.columns == ["doc_id", "text", "LANGUAGE_given", "language"] and {r["LANGUAGE_given"] for r in clash.collect()} == {"x"}
    # Languages that were learned from the same texts tie; the first name wins.
    twins = spark.createDataFrame([(i, "lorem ipsum dolor", k) for i, k in enumerate(("zz", "yy", "xx"))], "doc_id long, text string, lang string")
    assert li.predict(ask.limit(1), li.train(twins)).first()["language"]["lang_pred"] == "xx"


def test_the_sample_is_bounded_over_all_languages(spark, monkeypatch):
    rows = [(i, f"{k} text number {i} of many", k) for i in range(400) for k in ("aa", "bb", "cc", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(li, "ContextTree", lambda grams, counts, order: seen.append(int(counts.sum())))
    li.train(docs)
    whole, seen[:] = list(seen), []
    li.train(docs, max_chars=8_000)
    assert len(seen) == 4 and all(0 < x < 1.5 * 2_000 < y for x, y in zip(seen, whole))


def test_no_languages(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = li.train(empty)
    ask = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert li.predict(ask, model).first()["language"]["lang_pred"] == "und"
    assert li.predict(ask.limit(0), model).count() == 0
