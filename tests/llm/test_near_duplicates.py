import math
import random
from collections import Counter

import numpy as np
import pytest

from foldwright.llm import near_duplicates as nd


def shingle_counts(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(z, 0) / a[k], b.get(z, 0) / b[k]) for z in every) for k in a.keys() & b.keys())


def brute_classes(docs):
    sets = [shingle_counts(t or "") for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = sets[i] == sets[j] if not sets[i] or not sets[j] else brute_similarity(sets[i], sets[j]) >= 0.8 - 1e-12
            if same or docs[i][0] == docs[j][0]:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return {x: min(g) for g in groups.values() for x in g}


def corpus(seed, families=6, copies=12):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    docs = []
    for f in range(families):
        base = rng.choices(vocab, k=rng.choice((8, 40, 120)))
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w += w[:20]
            docs.append(" ".join(w))
    return [(i * 3 + 1, t) for i, t in enumerate(rng.sample(docs, len(docs)))]


def test_exact_similarity():
    rng = random.Random(4)
    for _ in range(50):
        texts = [" ".join(rng.choices("abc", k=rng.randint(5, 30))) for _ in range(2)]
        doc, e, w = nd.shingles(texts)
        parts = []
        for i in range(2):
            o = np.argsort(e[doc == i])
            parts += [e[doc == i][o], w[doc == i][o]]
        assert math.isclose(nd.probability_jaccard(*parts), brute_similarity(*map(shingle_counts, texts)), abs_tol=1e-9)


def test_signatures_estimate_the_similarity():
    rng = random.Random(5)
    a = [rng.choice("abcdefghij") * 2 for _ in range(80)]
    b = a[:60] + [rng.choice("klmnop") for _ in range(25)] + a[:20]
    doc, e, w = nd.shingles([" ".join(a), " ".join(b)])
    sig = nd.signatures(doc, e, w, 2, 4096)
    want = brute_similarity(shingle_counts(" ".join(a)), shingle_counts(" ".join(b)))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)
    # A signature depends on its text alone, not on the batch it comes in.
    doc1, e1, w1 = nd.shingles([" ".join(b)])
    assert (nd.signatures(doc1, e1, w1, 1, 4096)[0] == sig[1]).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = [*corpus(seed), (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1003, "one two"), (2000, "x " * 30_000), (2001, "x " * 30_001)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, class_id string")
    got = {r["id"]: r["class_id"] for r in nd.near_classes(df).collect()}
    small = [d for d in docs if d[0] < 2000]
    want = brute_classes(small)
    assert {k: v for k, v in got.items() if k < 2000} == want
    assert got[2000] == got[2001] == 2000


def short_pairs(seed, n=300):
    """``n`` pairs of texts of 10 to 30 words at a similarity of 0.80 to 0.83."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(13, 30))]
        other = words[:]
        for k in range(rng.choice((1, 2, 3))):
            other[-1 - k] = "".join(rng.choices("abcdefgh", k=6))
        pair = " ".join(words), " ".join(other)
        if 0.8 - 1e-12 <= brute_similarity(*map(shingle_counts, pair)) <= 0.83:
            out.append(pair)
    return out


def test_bits_do_not_part_near_pairs_of_few_shingles(spark):
    pairs = short_pairs(8)
    df = spark.createDataFrame([(2 * i + k, t, 2 * i + k) for i, p in enumerate(pairs) for k, t in enumerate(p)], "id long, text string, label long")
    long = nd.materialise(nd.sketched_with_label(df, nd.WORDS), "test-long")
    passed = {(r["a"], r["b"]) for r in nd.apart(long, nd.most_unlike(0.8)).collect()}
    assert [i for i in range(len(pairs)) if (2 * i, 2 * i + 1) not in passed] == []


def test_slices_of_a_bucket_meet_once_and_all_of_them(spark):
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), 0 if i % 3 else i))
    long = nd.materialise(nd.sketched_with_label(spark.createDataFrame(rows, "id long, text string, label long"), nd.WORDS), "test-long")
    whole = sorted((r["a"], r["b"]) for r in nd.apart(long, nd.most_unlike(0.8)).collect())
    sliced = sorted((r["a"], r["b"]) for r in nd.apart(long, nd.most_unlike(0.8), slice_rows=4).collect())
    assert whole == sliced and len(set(whole)) == len(whole)
    label = {i: x for i, _, x in rows}
    sets = [shingle_counts(t) for _, t, _ in rows]
    near = {(i, j) for j in range(60) for i in range(j) if label[i] != label[j] and brute_similarity(sets[i], sets[j]) >= 0.8}
    assert near and near <= set(whole)


def test_similarities_of_many_pairs_at_once():
    rng = random.Random(13)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(40)] + [" ".join(f"w{i}" for i in range(k, k + 30)) for k in range(10)]
    left, right = (np.array([rng.randrange(50) for _ in range(400)]) for _ in range(2))
    got = nd.similarities(texts, left, right, 0.5, nd.WORDS)
    for i, j, x in zip(left, right, got):
        a, b = shingle_counts(texts[i]), shingle_counts(texts[j])
        want = brute_similarity(a, b) if a and b else float(len(a) == len(b))
        assert math.isclose(x, want, abs_tol=1e-9) or (want < 0.5 and x < 0.5)


def test_recall_on_the_documents_table(spark):
    """Every pair of documents at 0.8 or more, found by an inverted index over all shingles, is in one class."""
    rows = [(r["doc_id"], shingle_counts(r["text"] or "")) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    holders = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            holders.setdefault(x, []).append(i)
    together = Counter((i, j) for some in holders.values() if len(some) > 1 for k, j in enumerate(some) for i in some[:k])
    # The similarity is at most the plain overlap of the two distributions, so few pairs need the exact sum.
    def overlap(a, b):
        na, nb = a.total(), b.total()
        return sum(min(a[x] / na, b[x] / nb) for x in a.keys() & b.keys())

    def similarity(a, b):  # the plain Jaccard where no shingle repeats
        once = a.total() == len(a) and b.total() == len(b)
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if once else brute_similarity(a, b)

    pairs = [(rows[i][0], rows[j][0]) for i, j in together if overlap(rows[i][1], rows[j][1]) >= 0.8 and similarity(rows[i][1], rows[j][1]) >= 0.8]
    got = {r["id"]: r["class_id"] for r in nd.near_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(pairs) > 20 and all(got[a] == got[b] for a, b in pairs)


def test_ids_of_any_type(spark):
    docs = corpus(5, families=2)
    named = {i: f"doc-{i:05d}" for i, _ in docs}
    got = {r["id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame([(named[i], t) for i, t in docs], "doc_id string, text string")).collect()}
    assert got == {named[i]: named[c] for i, c in brute_classes(docs).items()}
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words in this one here")], "doc_id int, text string")
    assert sorted(nd.near_classes(df).collect(), key=str) == sorted([(7, 7), (None, 7), (None, None)], key=str)


def test_families_of_short_texts_equal_brute_force(spark):
    rng, families = random.Random(9), []
    for f in range(200):
        w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(10, 30))]
        texts = [list(w) for _ in range(12)]
        for t in texts[1:]:
            for k in (*range(rng.randint(0, 2)), *range(-rng.randint(0, 2), 0)):
                t[k] = "".join(rng.choices("abcdefgh", k=6))
        rng.shuffle(texts)
        families.append([(f * 100 + i, " ".join(t)) for i, t in enumerate(texts)])
    want = {k: v for docs in families for k, v in brute_classes(docs).items()}
    df = spark.createDataFrame([d for docs in families for d in docs], "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in nd.near_classes(df).collect()} == want


def test_one_of_each_class_stays(spark):
    docs = [*corpus(3), (1003, "one two"), (1003, "one two")]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, id long")
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(docs).values()))


def test_an_id_links_all_its_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcd"]
    docs = [*[(i + 1, t) for i, t in enumerate(texts)], *[(9, t) for t in texts]]
    got = {r["id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) == dict.fromkeys((1, 2, 3, 4, 9), 1)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words in this one here"), (5, None)], "doc_id long, text string")
    assert len(nd.keep_one(df).collect()) == 3
    assert nd.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["id"]: r["label"] for r in nd.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}
