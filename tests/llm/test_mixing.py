import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from foldwright.llm import mixing


def water(budget, kids):
    """kids: name -> (cap, weight). Rounds of proportional shares; a child that is full leaves the rest to its siblings."""
    out, open_, left = {}, dict(kids), Fraction(budget)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if Fraction(c, w) <= left / total]
        if not full:
            return out | {k: min(c, int(w * left / total)) for k, (c, w) in open_.items()}
        k = min(full, key=lambda k: (Fraction(*open_[k]), k))
        out[k] = open_[k][0]
        left -= open_.pop(k)[0]
    return out


def own(value):
    return "(none)" if value is None else f"({value}" if str(value)[:1] == "(" else str(value)


def brute(docs, plan):
    tokens = [len((t or "").split()) for _, t, _, _ in docs]
    leaf = []
    for _, _, lang, source in docs:
        digits = ""
        for ch in reversed(source or ""):
            if not ch.isdigit():
                break
            digits = ch + digits
        leaf.append((f"d{int(digits) % 4 if digits else 0}", own(lang), own(source)))
    supply = defaultdict(int)
    for x, n in zip(leaf, tokens):
        supply[x] += n
    cap = lambda pre: sum(n for x, n in supply.items() if x[: len(pre)] == pre) * plan.max_epochs
    top = sum(tokens) * plan.target_share // 100
    budget, languages = {}, {own(k): w for k, w in plan.languages.items()}
    for d, bd in water(top, {d: (cap((d,)), plan.domains.get(d, 1)) for d in {x[0] for x in supply}}).items():
        for lang, bl in water(bd, {x[1]: (cap(x[:2]), languages.get(x[1], 1)) for x in supply if x[0] == d}).items():
            for s, bs in water(bl, {x[2]: (cap(x), plan.sources.get(x[2], 1)) for x in supply if x[:2] == (d, lang)}).items():
                budget[d, lang, s] = bs
    out = {}
    for x in supply:
        whole = budget[x] // supply[x] if supply[x] else 0
        rest = budget[x] - whole * supply[x]
        mine = sorted((hashlib.md5(f"{plan.seed}|{whole}|{own(docs[i][0])}".encode()).hexdigest(), i) for i in range(len(docs)) if leaf[i] == x)
        used = 0
        for _, i in mine:
            used += tokens[i]
            n = whole + (used <= rest)
            if n:
                out[docs[i][0]] = ("/".join(x), tokens[i], n)
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    src = ["src0"] * 6 + [f"src{i}" for i in range(9)] + ["odd", None]
    return [(i, " ".join(["w"] * rng.randint(0, 40)) or None, rng.choice(["en", "en", "de", "fr", None]), rng.choice(src)) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("share,epochs", [(60, 2), (20, 1), (130, 2), (100, 1)])
def test_draws_equal_brute_force_and_sql(spark, share, epochs):
    plan = mixing.Plan(target_share=share, max_epochs=epochs)
    docs = corpus(share)
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: (r["epochs_leaf"], len((r["text"] or "").split()), r["epochs"]) for r in mixing.mix(df, plan).collect()}
    assert got == brute(docs, plan)
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    sql = {r[0]: (r[1], r[2], r[3]) for r in con.execute(mixing.oracle(plan)).fetchall()}
    assert sql == got
    total = sum(n * k for _, n, k in got.values())
    asked = sum(len((d[1] or "").split()) for d in docs) * min(share, 100 * epochs) // 100
    assert total <= asked and total >= asked - 60 * 40  # each leaf stops less than one document short


def test_rows_of_epochs_and_edge_cases(spark):
    plan = mixing.Plan(target_share=150, max_epochs=2)
    df = spark.createDataFrame([(1, "a b", "en", "src1", 5), (1, "a b", "en", "src1", 5), (None, "c d", None, None, 5), (3, None, "en", "src1", 5)], SCHEMA + ", epochs int")
    rows = mixing.repeat_epochs(df, plan)
    assert rows.columns == df.columns and rows.count() >= 3
    one = mixing.mix(df.drop("epochs"), plan)
    assert len({r["epochs"] for r in one.where("doc_id = 1").collect()}) <= 1
    assert mixing.mix(df.drop("epochs").limit(0), plan).count() == 0
    clash = mixing.mix(df, plan)
    assert clash.columns == ["doc_id", "text", "lang", "source", "epochs_given", "epochs", "epochs_leaf"] and {r["epochs_given"] for r in clash.collect()} == {5}
    again = lambda d: sorted(map(str, mixing.mix(d, mixing.Plan(target_share=50)).collect()))
    big = spark.createDataFrame(corpus(9), SCHEMA)
    assert again(big) == again(big.repartition(13))


def test_null_and_the_text_that_names_it_are_leaves_of_their_own(spark):
    plan = mixing.Plan(languages={"(none)": 3, None: 2, "en": 4}, target_share=55, max_epochs=1)
    values = [None, "(none)", "((none)", "en", "("]
    docs = [(f"{v}{i}" if i else v, "w " * (i % 7), v, values[i % 5]) for i in range(40) for v in values]
    df = spark.createDataFrame(docs, SCHEMA.replace("long", "string"))
    rows = mixing.mix(df, plan).select("doc_id", "epochs_leaf", "text", "epochs").collect()
    assert {(r["doc_id"]): (r["epochs_leaf"], len(r["text"].split()), r["epochs"]) for r in rows} == brute(docs, plan)
    assert len({r["epochs_leaf"] for r in mixing.mix(df, mixing.Plan(target_share=100)).collect()}) == 25
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(repr, ((r["doc_id"], *brute(docs, plan)[r["doc_id"]]) for r in rows))) == sorted(map(repr, con.execute(mixing.oracle(plan)).fetchall()))


def test_one_very_long_text(spark):
    docs = [(i, "w " * (400_000 if i == 3 else 5), "en", "src1") for i in range(30)]
    plan = mixing.Plan(target_share=100, max_epochs=1)
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA), plan).collect()
    assert {r["doc_id"]: (r["epochs_leaf"], len(r["text"].split()), r["epochs"]) for r in rows} == brute(docs, plan)
    assert 3 in {r["doc_id"] for r in rows}
