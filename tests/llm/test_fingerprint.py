import hashlib
import random

import numpy as np
import pytest

from foldwright.llm import fingerprint as fp
from foldwright.llm.textgrid import mix, span_hash


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_equal_brute_force():
    rng = random.Random(1)
    letters = fp.ALPHABET.tobytes().decode()
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("A" * 64, "A" * 64), ("A" * 64, "B" * 64)]
    for _ in range(200):
        a = "".join(rng.choices(letters[: rng.choice((2, 64))], k=rng.randint(0, 64)))
        pairs.append((a, a[rng.randint(0, 9) :] + "".join(rng.choices(letters, k=rng.randint(0, 9)))))
    assert fp.distances(*map(list, zip(*[(a, b[:64]) for a, b in pairs]))).tolist() == [levenshtein(a, b[:64]) for a, b in pairs]


def test_fingerprints():
    rng = random.Random(2)
    base = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(800))
    near = base[:2000] + "an inserted sentence" + base[2000:]
    other = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(800))
    a, b, c, d = fp.fingerprints([base, near, other, base])
    assert a == d and a == fp.fingerprints([other, base])[1]
    like = fp.likeness([a, a, a], [b, c, d])
    assert like[0] > 0.8 and like[1] < 0.3 and like[2] == 1.0
    for x in (a, b, c):
        size, one, two = x.split(":")
        assert int(size) % 3 == 0 and len(one) <= 64 and len(two) <= 64
    assert fp.fingerprints([""])[0] == "3::" and fp.fingerprints(["x"])[0].startswith("3:")
    assert fp.likeness(["3:abcdef:abc"], ["96:abcdef:abc"])[0] == 0.0


def plain_fingerprint(text):
    """One text by loops over its bytes: a piece ends where the hash of the last seven bytes fits the block size."""
    data = text.encode()
    n = len(data)
    h = []
    for i in range(n):
        seven = sum((data[i - k] if i >= k else 0) << (8 * k) for k in range(fp.WINDOW))
        h.append((int(mix(np.array([seven], np.uint64))[0]) >> 20) + 1)
    k = 0
    while 3 * 64 << k < n:
        k += 1
    while k and sum(x % (3 << k) == 0 for x in h) < 31:
        k -= 1
    parts = []
    for size in (3 << k, 6 << k):
        ends = [i + 1 for i, x in enumerate(h) if x % size == 0][:63]
        if n and (not ends or ends[-1] != n):
            ends.append(n)
        whole = np.frombuffer(data, np.uint8)
        parts.append("".join(chr(fp.ALPHABET[int(span_hash(whole, np.array([a]), np.array([b]))[0]) & 63]) for a, b in zip([0, *ends], ends)))
    return f"{3 << k}:{parts[0]}:{parts[1]}"


def test_fingerprints_equal_a_loop_over_bytes():
    rng = random.Random(7)
    texts = ["", "x", "abc" * 400, "é" * 90] + ["".join(rng.choices("abcdefgh ñ\n", k=rng.choice((5, 60, 700, 4000)))) for _ in range(20)]
    assert fp.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_next_documents(spark, parts):
    rng = random.Random(3)
    docs = [(i * i * 7 - 50, "".join(rng.choices("añbç ", k=rng.randint(0, 90)))) for i in range(25)]
    docs += [(10**15, "far away"), (-5, ""), (10**15 + 1, None), (2**62 + 1, "beyond a double"), (2**62 + 2, "beyond a double too")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, fingerprint string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r for r in fp.compare_with_next(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    assert len(got) == len(docs)
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == [plain_fingerprint(t), plain_fingerprint(edited)]
        assert r["near_next"] == fp.likeness([r["fingerprint"]], fp.fingerprints([n]))[0]
        assert r["near_edited"] == fp.likeness([r["fingerprint"]], [r["edited_fingerprint"]])[0]


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    one = fp.compare_with_next(spark.createDataFrame([(5, "alone in here")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "x"), (None, None), (2, "y" * 200_000), (2, "y"), (2, "y")], schema)
    rows = fp.compare_with_next(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (0, 1), (2, 1), (2, 1), (2, 200_000)]
    named = spark.createDataFrame([("b", "second"), ("a", "third"), ("c", "first one")], "doc_id string, text string")
    edited = {r["doc_id"]: r["edited_sha256"] for r in fp.compare_with_next(named).collect()}
    assert edited == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in (("c", "firstseco"), ("b", "secthi"), ("a", "thifi"))}
    assert fp.compare_with_next(odd.limit(0)).count() == 0
    assert fp.fingerprint(odd).select("fingerprint").distinct().count() == 4
    kept = fp.fingerprint(odd.selectExpr("text", "doc_id as Fingerprint"))
    assert kept.columns == ["text", "Fingerprint_given", "fingerprint"]
