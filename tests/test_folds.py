import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwright.operators import checks, folds

COLUMNS = "grp string, subgroup string, sample string, fold int, diagnosis string"


def split_rows(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def audit(df, n_folds=3, expected=None):
    rows = {r["name"]: r["status"] for r in folds.leakage_audit(df, ["diagnosis"], n_folds, expected).collect()}
    return rows, all(v == "PASS" for v in rows.values())


def test_leakage_cases(spark):
    good = [(f"p{f}{d}", f"w{f}{d}", f"r{f}{d}", f, d) for f in range(3) for d in "AB"]
    assert audit(split_rows(spark, good))[1]
    leak, ok = audit(split_rows(spark, [*good, ("p0A", "w9", "r9", 1, "A")]))
    assert not ok and leak["groups in one fold"] == "FAIL"
    missing, ok = audit(split_rows(spark, [(f"p{f}", f"w{f}", f"r{f}", f, "A") for f in range(2)]))
    assert not ok and missing["every diagnosis in every fold"] == "FAIL"
    wrong, ok = audit(split_rows(spark, good), expected={f: {"n_groups": 3} for f in range(3)})
    assert not ok and wrong["declared fold counts"] == "FAIL"
    assert audit(split_rows(spark, good), expected={f: {"n_groups": 2} for f in range(3)})[1]


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(1, 23), min_size=1, max_size=5), seed=st.integers(0, 99))
def test_folds_are_even(spark, sizes, seed):
    rows = [(f"g{s}_{i:03d}", f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    got = folds.stratified_folds(spark.createDataFrame(rows, "grp string, stratum string"), 3, seed).collect()
    assert sorted(r["grp"] for r in got) == sorted(r[0] for r in rows)
    total = Counter(r["fold"] for r in got)
    assert max(total.values()) - min(total.get(f, 0) for f in range(3)) <= 1
    for s, n in enumerate(sizes):
        per = Counter(r["fold"] for r in got if r["stratum"] == f"s{s}")
        assert max(per.get(f, 0) for f in range(3)) - min(per.get(f, 0) for f in range(3)) <= 1


def test_balance_lowers_the_cost_and_keeps_sizes(spark):
    rows = [(f"s{i}_{j}", f"w{i}", f"g{i:02d}", f"st{i % 2}", "xyz"[(i * 7 + j) % 3]) for i in range(24) for j in range(1 + (i * i) % 5)]
    samples = spark.createDataFrame(rows, "sample string, subgroup string, grp string, stratum string, label string")
    before = folds.stratified_folds(folds.group_table(samples), 3, 1)
    after = folds.balanced_folds(samples, before, ["label"], 3, passes=3)
    features = folds.balance_features(samples, ["label"])
    a, b = (folds.fold_cost(features, x, 3).first()[0] for x in (before, after))
    assert b < a
    count = lambda x: sorted((r["stratum"], r["fold"], r["count"]) for r in x.groupBy("stratum", "fold").count().collect())
    assert count(before) == count(after)
    # The incremental change is the change of the recomputed total.
    assert abs(folds.fold_cost(features, before, 3).first()[0] - a) < 1e-9


def test_one_pass_makes_as_many_swaps_as_help(spark):
    # Fold 0 holds the groups of five samples, fold 1 those of one, fold 2 those of three: a third of all groups has to move.
    rows = [(f"s{i}_{j}", f"w{i}", f"g{i:03d}", "st", "x") for i in range(900) for j in range((5, 1, 3)[i % 3])]
    samples = spark.createDataFrame(rows, "sample string, subgroup string, grp string, stratum string, label string")
    before = folds.group_table(samples).withColumn("fold", F.substring("grp", 2, 3).cast("int") % 3)
    features = folds.balance_features(samples, ["label"])
    a, b = (folds.fold_cost(features, x, 3).first()[0] for x in (before, folds.balanced_folds(samples, before, ["label"], 3, passes=1)))
    print("cost", a, b)
    assert b < 0.1 * a


def test_no_improving_swap_is_left(spark):
    """Against every couple of groups of one stratum; and the change that a swap was said to bring is the change of the recomputed cost."""
    for seed in (1, 5):
        rng = random.Random(seed)
        rows = [(f"s{i}_{j}", f"w{i}_{j % 2}", f"g{i:02d}", f"st{i % 3}", rng.choice("xyz"), rng.choice("pq")) for i in range(30) for j in range(rng.randint(1, 6))]
        samples = spark.createDataFrame(rows, "sample string, subgroup string, grp string, stratum string, label string, other string")
        before = folds.stratified_folds(folds.group_table(samples), 3, seed)
        after = folds.balanced_folds(samples, before, ["label", "other"], 3)
        features = folds.balance_features(samples, ["label", "other"])
        value, weight = {}, {}
        for r in features.collect():
            value[r["grp"], r["feature"]] = r["value"]
            weight[r["feature"]] = r["weight"]

        def cost(at):
            total = 0.0
            for f, w in weight.items():
                whole = sum(value.get((g, f), 0.0) for g in at)
                for k in range(3):
                    part = sum(x == k for x in at.values()) / len(at)
                    off = sum(value.get((g, f), 0.0) for g, x in at.items() if x == k) - whole * part
                    total += w * (off / max(whole / 3, 1.0)) ** 2
            return total

        stratum = {r["grp"]: r["stratum"] for r in after.collect()}
        at, was = ({r["grp"]: r["fold"] for r in x.collect()} for x in (after, before))
        now = cost(at)
        assert now < cost(was) and abs(now - folds.fold_cost(features, after, 3).first()[0]) < 1e-9
        for g in at:
            for h in at:
                if g < h and stratum[g] == stratum[h] and at[g] != at[h]:
                    assert cost({**at, g: at[h], h: at[g]}) > now - 1e-9
        # One swap of the first table: what was promised is what happens.
        balance = folds.Balance(features, before, 3)
        assert abs(balance.cost() - cost(was)) < 1e-9
        classes = folds.with_class(folds.vectors_of(features, before.select("grp", "stratum", "fold"), balance.names))
        bids = folds.agreed_swaps(folds.best_swaps(folds.class_sizes(classes), balance, 4)).collect()
        members = {}
        for r in classes.collect():
            members.setdefault(r["class"], []).append(r["grp"])
        assert bids and len({c for r in bids for c in (r["a"], r["b"])}) == 2 * len(bids)
        assert any(r["step"] for r in bids)
        for r in [r for r in bids if r["step"] == 0]:
            moved = {**was, **{g: r["fb"] for g in members[r["a"]][: r["times"]]}, **{g: r["fa"] for g in members[r["b"]][: r["times"]]}}
            assert abs(cost(moved) - cost(was) - r["change"]) < 1e-9


def test_passes_are_linear(spark, monkeypatch):
    """Blocks meet one partner each; with a coarser ``least_gain`` all couples never meet."""
    rng = random.Random(3)
    rows = [(f"s{i}_{j}", f"w{i}_{j % 2}", f"g{i:03d}", f"st{i % 2}", rng.choice("xyzuv")) for i in range(120) for j in range(rng.randint(1, 9))]
    samples = spark.createDataFrame(rows, "sample string, subgroup string, grp string, stratum string, label string")
    before = folds.stratified_folds(folds.group_table(samples), 3, 2)
    features = folds.balance_features(samples, ["label"])
    a = folds.fold_cost(features, before, 3).first()[0]
    monkeypatch.setattr(folds, "DEALT_BLOCK", 8)
    met, best = [], folds.best_swaps
    monkeypatch.setattr(folds, "best_swaps", lambda *x, **named: met.append(named.get("deal")) or best(*x, **named))
    rough = folds.balanced_folds(samples, before, ["label"], 3, least_gain=0.01 * a)
    assert met and None not in met and folds.fold_cost(features, rough, 3).first()[0] < 0.1 * a
    count = lambda x: sorted((r["stratum"], r["fold"], r["count"]) for r in x.groupBy("stratum", "fold").count().collect())
    assert count(before) == count(rough)
    balance = folds.Balance(features, before, 3)
    classes = folds.class_sizes(folds.with_class(folds.vectors_of(features, before.select("grp", "stratum", "fold"), balance.names)))
    # Five blocks of four to a stratum and fold: five couples for each pair of folds, not twenty-five.
    assert best(classes, balance, 4, steps=1, deal=1).count() <= 2 * 3 * 5


def test_passes_read_classes_not_groups(spark, monkeypatch):
    """Groups are written as vectors and as moves; what passes write is as long for five copies of the groups as for one, and copies make no more blocks."""
    written, write = {}, folds.materialise

    def counted(df, name):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(folds, "materialise", counted)
    monkeypatch.setattr(folds, "DEALT_BLOCK", 16)
    for copies in (1, 5):
        rows = [(f"s{c}_{i}_{j}", f"w{i}_{j % 2}", f"g{c}_{i:03d}", f"st{i % 2}", "xyz"[(i * 7 + j) % 3]) for c in range(copies) for i in range(60) for j in range(1 + i % 5)]
        samples = spark.createDataFrame(rows, "sample string, subgroup string, grp string, stratum string, label string")
        before = folds.group_table(samples).withColumn("fold", F.substring("grp", 4, 3).cast("int") % 3)
        written.clear()
        after = folds.balanced_folds(samples, before, ["label"], 3)
        classes = samples.groupBy("grp").agg(F.count("*").alias("n"), F.min("stratum").alias("s")).count() // copies
        assert written["group-vectors"] == [60 * copies] and max(written["fold-classes"]) <= 3 * classes and len(written["fold-classes"]) > 1
        features = folds.balance_features(samples, ["label"])
        a, b = (folds.fold_cost(features, x, 3).first()[0] for x in (before, after))
        assert b < a
        vectors, weights = folds.group_vectors(samples, ["label"])
        assert abs(folds.Balance.of_vectors(vectors, weights, after, 3).cost() - b) < 1e-9
        count = lambda x: sorted((r["stratum"], r["fold"], r["count"]) for r in x.groupBy("stratum", "fold").count().collect())
        assert count(before) == count(after) and after.count() == 60 * copies
        was, now = ({r["grp"]: r["fold"] for r in x.collect()} for x in (before, after))
        # As few groups move as the sizes of classes ask for.
        of = {r["grp"]: (r["stratum"], tuple(r["values"])) for r in vectors.collect()}
        left = Counter((of[g], was[g]) for g in was)
        left.subtract(Counter((of[g], now[g]) for g in now))
        assert sum(v for v in left.values() if v > 0) == sum(was[g] != now[g] for g in was) > 0


def test_coverage_and_roles(spark):
    rows = [(f"p{f}{d}", f"w{f}{d}", f"r{f}{d}", f, d) for f in range(3) for d in "AB" if (f, d) != (2, "B")]
    df = split_rows(spark, rows)
    got = {r["label"]: (r["fold_0"], r["fold_1"], r["fold_2"]) for r in folds.class_coverage(df, "diagnosis", "grp", 3).collect()}
    assert got == {"A": (1, 1, 1), "B": (1, 1, 0)}
    assert folds.training_coverage(df.where("not (diagnosis = 'B' and fold = 1)"), "diagnosis", 3).collect()[0]["held_fold"] == 0
    assert folds.roles(df, 3).where("role = 'test'").count() == 5
    assert folds.named_split_summary(df.withColumn("split", F.lit("all")), "split").first()["group_percent"] == 100.0
    checks.require(folds.fold_match_checks(df, df.select("grp", "fold")))


def test_audit_counts_each_violation(spark):
    rows = [("g1", "w1", "r1", 0, "A"), ("g1", "w1", "r1", 1, "A"), ("g2", "w2", "r2", 1, None), ("g2", "w3", "r3", None, "A"), ("g3", "w3", "r4", 9, "B"), ("g3", "w3", "r5", 2, "A"), ("g4", "w4", "r6", 7, "B"), ("g4", "w4", "r7", 8, "B")]
    got = {r["name"]: int(r["detail"].split()[0]) for r in folds.leakage_audit(split_rows(spark, rows), ["diagnosis"], 3).collect()}
    assert got == {"unique samples": 1, "groups in one fold": 3, "subgroups in one fold": 3, "fold numbers": 4, "every diagnosis in every fold": 3 + 3}
    none = folds.leakage_audit(split_rows(spark, []), ["diagnosis"], 3).collect()
    assert len(none) == 5 and {r["status"] for r in none} == {"PASS"}


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return plan.count("FileScan"), plan.count("Exchange ")


def test_audit_reads_the_split_once(spark, tmp_path):
    good = [(f"p{f}{d}", f"w{f}{d}", f"r{f}{d}", f, d) for f in range(3) for d in "AB"]
    split_rows(spark, good).write.parquet(str(tmp_path / "split"))
    read, moved = scans(folds.leakage_audit(spark.read.parquet(str(tmp_path / "split")), ["diagnosis"], 3, {0: {"n_groups": 2}}))
    assert read == 1 and moved <= 3
