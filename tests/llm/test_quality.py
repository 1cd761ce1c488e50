import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwright.llm import quality


def brute(text, limits=quality.Limits()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    lines, seen, n_dup, dup_chars = text.split("\n"), set(), 0, 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            if x in seen:
                n_dup += 1
                dup_chars += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x)))
            seen.add(x)

    def covered(n):
        c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        mark = [False] * len(words)
        for i in range(len(words) - n + 1):
            if c[tuple(words[i : i + n])] > 1:
                mark[i : i + n] = [True] * n
        top = max((k * sum(map(len, g)) for g, k in c.items() if k > 1), default=0)
        return mark, top

    n_repeat = sum(covered(3)[0])
    base = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    bad = dup_chars > limits.lines * max(chars, 1)
    symbols = sum(ch in "#*$%&|<>" for ch in text)
    bad |= symbols > limits.symbols * max(chars, 1)
    for n, most in limits.top.items():
        bad |= min(covered(n)[1] / max(chars, 1), 1) > most
    for n, most in limits.dup.items():
        bad |= sum(len(w) for w, m in zip(words, covered(n)[0]) if m) / max(chars, 1) > most
    return len(words), chars, symbols, n_dup, n_repeat, base, not (base or bad)


def texts():
    rng = random.Random(3)
    pool = ["la", "été", "of", "##", "wörd", "x|y", "and", "THE"]
    wide = ["".join(rng.choices("abcdefghijé", k=5)) for _ in range(500)]
    out = [None, "", " ", "\n\n", "a", "\t\x0b\x0c\r ", "same line\nsame line\n same line\nsame line", "\xa0nbsp is a word", "a\x85b c"]
    for _ in range(120):
        words = rng.choices(wide if rng.random() < 0.5 else pool, k=rng.choice((3, 49, 50, 90, 200)))
        if rng.random() < 0.5:
            words += words[: rng.randint(0, 60)] * rng.randint(1, 3)
        out.append("".join(w + rng.choice((" ", " ", "\n", "  ", "\t")) for w in words))
    out += ["\n".join([" ".join(rng.choices(wide, k=12))] * 9), " ".join(rng.choices(wide, k=60_000))]
    return out


def test_measures_equal_brute_force(spark):
    rows = [(i, t, True) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = {r["doc_id"]: r["quality"] for r in quality.measure(df).collect()}
    kept = set()
    for i, t, _ in rows[:-1]:
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"], q["kept"]) == brute(t), t
        if q["kept"]:
            kept.add(i)
    assert 5 < len(kept) < 100 and got[len(rows) - 1]["n_words"] == 60_000
    good = quality.keep_good(df)
    assert good.columns == df.columns and {r["doc_id"] for r in good.collect()} - {len(rows) - 1} == kept
    assert quality.measure(df.limit(0)).count() == 0
    twice = quality.measure(df.limit(3).union(df.limit(3)).withColumn("quality", F.lit(7)))
    assert twice.columns == ["doc_id", "text", "kept", "quality_given", "quality"]
    assert all(len({str(r["quality"]) for r in twice.where(F.col("doc_id") == i).collect()}) == 1 and twice.where(F.col("doc_id") == i).count() == 2 for i in range(3))


@pytest.mark.parametrize("limit", [0.05, 0.6])
def test_limits_are_parameters(limit):
    limits = quality.Limits(lines=limit, dup={5: limit}, top={2: limit})
    some = [t or "" for t in texts()[:-1]]
    assert list(quality.coverage(some, limits)["kept"]) == [brute(t, limits)[-1] for t in some]
