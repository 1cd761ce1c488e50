import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import checks, compare, evaluate, probe, report, resample


def classes(spark, n):
    return spark.createDataFrame([(str(i), i) for i in range(n)], "label string, class_id int")


def test_four_predictions(spark):
    rows = spark.createDataFrame([("s", 1, str(i), f"g{i}", t, p) for i, (t, p) in enumerate(((0, 0), (0, 1), (1, 1), (1, 1)))],
                                 "model string, seed int, sample string, grp string, true_id int, pred_id int")
    m = evaluate.system_metrics(rows, classes(spark, 2), ["model", "seed"]).first()
    assert m["balanced_accuracy"] == 0.75 and math.isclose(m["macro_f1"], (2 / 3 + 0.8) / 2)
    cm = {(r["true_id"], r["pred_id"]): (r["n"], r["share"]) for r in evaluate.confusion(rows, classes(spark, 2), ["model", "seed"]).collect()}
    assert cm == {(0, 0): (1, 0.5), (0, 1): (1, 0.5), (1, 0): (0, 0.0), (1, 1): (2, 1.0)}
    assert [r["support"] for r in evaluate.per_class(rows, classes(spark, 2), ["model", "seed"]).orderBy("class_id").collect()] == [2, 2]
    # A class of the universe that never occurs counts with zeros.
    assert evaluate.system_metrics(rows, classes(spark, 3), ["model", "seed"]).first()["balanced_accuracy"] == 0.5


def test_assembly(spark):
    rows = [(s, f, i, [0.9, 0.1]) for s in (101, 202) for f, part in ((0, (0, 2)), (1, (1, 3))) for i in part]
    schema = "seed int, fold int, sample int, probs array<double>"
    samples = spark.createDataFrame([(i,) for i in range(4)], "sample int")
    df = spark.createDataFrame(rows, schema)
    checks.require(evaluate.probability_checks(df, samples, ["seed"]))
    assert evaluate.assemble(df, samples, ["seed"]).where("class_id = 0").count() == 8
    broken = spark.createDataFrame([(s, f, 2 if (f, i) == (1, 1) else i, p) for s, f, i, p in rows], schema)
    with pytest.raises(ValueError, match="each sample once"):
        checks.require(evaluate.probability_checks(broken, samples, ["seed"]))
    with pytest.raises(ValueError, match="sum to one"):
        checks.require(evaluate.probability_checks(df.withColumn("probs", F.array(F.lit(0.9), F.lit(0.3))), samples, ["seed"]))


def bootstrap_rows(spark):
    rows = []
    for c, name in enumerate("ABC"):
        for i in range(6):
            k = c * 6 + i
            good = 1 if k == 0 else c
            rows.append((str(k), f"{name}{i // 2}", c, good, (c + 1) % 3))
    df = spark.createDataFrame(rows, "sample string, grp string, true_id int, a_id int, b_id int").withColumn("task", F.lit("t"))
    groups = df.select("grp", F.col("true_id").cast("string").alias("stratum")).distinct()
    return df, groups


def test_bootstrap_draws(spark):
    _, groups = bootstrap_rows(spark)
    one = sorted(map(tuple, resample.draws(groups, 20, 5).collect()))
    assert one == sorted(map(tuple, resample.draws(groups.repartition(7), 20, 5).collect()))
    assert one != sorted(map(tuple, resample.draws(groups, 20, 6).collect()))
    for b in range(20):
        assert sum(w for r, _, w in one if r == b) == 9
    with pytest.raises(ValueError):
        resample.check_parameters(0, 0.95)


def test_paired_tests(spark):
    df, groups = bootstrap_rows(spark)
    rows = {r["metric"]: r for r in resample.paired_class_test(df, groups, classes(spark, 3), ["task"], 50).collect()}
    assert rows["macro_f1"]["difference"] > 0 and rows["macro_f1"]["probability_a_better"] > 0.9 and 0 < rows["macro_f1"]["p_value"] <= 1
    values = df.select("task", "grp", F.col("sample").cast("double").alias("value"))
    assert resample.mean_intervals(values, groups, ["task"], 30).first()["estimate"] == 8.5
    pairs = df.select("task", "grp", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    m = resample.paired_mean_test(pairs, groups, ["task"], 50).first()
    assert m["difference"] == 1.0 and m["probability_a_better"] == 1.0 and m["ci_low"] == m["ci_high"] == 1.0
    # Under all equal values only flips that leave every sign alone are as extreme.
    assert m["p_value"] < 0.2


def test_holm(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03)], "family string, p_value double")
    got = {r["p_value"]: round(r["p_holm"], 12) for r in compare.holm(df, "p_value", ["family"]).collect()}
    assert got == {0.01: 0.03, 0.04: 0.06, 0.03: 0.06}
    with pytest.raises(Exception, match="0..1"):
        compare.holm(spark.createDataFrame([("f", 1.5)], "family string, p_value double"), "p_value", ["family"]).collect()


def seed_metrics(spark, shift=0.0, model="m"):
    rows = [("p1", model, "center", t, s, 0.6 + 0.05 * i + shift, 0.5 + 0.05 * i + shift, 0.6, 0.6, 100) for t in ("a", "b", "c") for i, s in enumerate((101, 202, 303, 404, 505))]
    return spark.createDataFrame(rows, "protocol_id string, model string, strategy string, task string, seed int, balanced_accuracy double, macro_f1 double, accuracy double, weighted_f1 double, n_samples long")


def test_summary_table(spark):
    row = report.summary_table(seed_metrics(spark), ["a", "b", "c"], ["balanced_accuracy", "macro_f1"]).first()
    assert row["a_balanced_accuracy"] == "0.700 ± 0.079" and row["a_macro_f1"] == "0.600 ± 0.079"
    two = seed_metrics(spark, 0.0004, "x").union(seed_metrics(spark, 0.0003, "y"))
    best = {r["model"]: (r["a_balanced_accuracy"], r["a_balanced_accuracy_best"]) for r in report.summary_table(two, ["a"], ["balanced_accuracy"]).collect()}
    assert best["x"][0] == best["y"][0] and best["x"][1] and not best["y"][1]
    seeds, system = [101, 202, 303, 404, 505], ["model", "strategy", "task"]
    checks.require(report.input_checks(two, system, seeds, ["n_samples"]))
    for bad in (two.where("seed <> 505"), two.withColumn("protocol_id", F.when(F.col("model") == "x", "p2").otherwise("p1")), two.withColumn("fold", F.lit(1)), two.union(two)):
        with pytest.raises(ValueError):
            checks.require(report.input_checks(bad, system, seeds, ["n_samples"]))


def test_retrieval_cells(spark):
    per = spark.createDataFrame([("m", f, 5, "average_precision", v) for f, v in enumerate((0.6, 0.7, 0.8))], "model string, fold int, k int, metric string, value double")
    over = per.groupBy("model", "k", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    assert report.retrieval_table(over, [5], {"average_precision": "mAP"}, ["model"]).first()["mAP_at_5"] == "0.700 ± 0.100"


def test_aliases_and_grid(spark):
    df = spark.createDataFrame([(" Center ",), ("other",)], "strategy string")
    assert sorted(r[0] for r in report.canonical(df, "strategy", report.STRATEGY_ALIASES).collect()) == ["center", "other"]
    assert report.experiment_grid(spark, ["a", "b"], ["x"], ["t", "u"], "a").count() == 2
    with pytest.raises(ValueError):
        report.experiment_grid(spark, ["a"], ["x"], ["t"], "z")


def test_probe_separates_two_classes_and_repeats(spark):
    rows = [(f"{f}{c}{r}", f"p{f}{c}{r}", f, c, [-2.0 if c == "A" else 2.0, f * 0.1 + r * 0.01]) for f in range(3) for c in "AB" for r in range(2)]
    items = spark.createDataFrame(rows, "sample string, grp string, fold int, label string, features array<double>")
    config = probe.ProbeConfig(seeds=(101, 202), epochs=30, batch=4, rate=0.1)
    out, labels = probe.run_probe(items, config)
    one = sorted((r["seed"], r["sample"], tuple(r["probs"])) for r in out.collect())
    assert len(one) == 24 and all(labels[int(p[1] > p[0])] == s[1] for _, s, p in one)
    again = sorted((r["seed"], r["sample"], tuple(r["probs"])) for r in probe.run_probe(items, config)[0].collect())
    assert max(abs(a - b) for x, y in zip(one, again) for a, b in zip(x[2], y[2])) < 1e-9
    w = probe.class_weights(items.withColumn("k", F.lit(0)), ["k"]).collect()
    assert [r["weight"] for r in w] == [1.0, 1.0]


def test_group_in_two_strata_and_values_that_are_not_finite_fail(spark):
    df, groups = bootstrap_rows(spark)
    torn = groups.union(groups.where("grp = 'A0'").withColumn("stratum", F.lit("other")))
    with pytest.raises(Exception, match="one stratum"):
        resample.draws(torn, 5, 0).collect()
    values = df.select("task", "grp", F.when(F.col("sample") == "3", F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("value"))
    with pytest.raises(Exception, match="finite"):
        resample.mean_intervals(values, groups, ["task"], 5).collect()
    with pytest.raises(Exception, match="no stratum"):
        resample.mean_intervals(df.select("task", "grp", F.lit(1.0).alias("value")), groups.where("grp <> 'A0'"), ["task"], 5).collect()


def test_sums_of_replicates_equal_a_join_with_the_draws(spark):
    rows = [(f"g{i}", f"s{i % 3}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "grp string, stratum string, v double")
    sums = resample.resampled_sums(df.select("grp", "v").withColumn("k", F.lit("x")), ["k"], ["v"], df.select("grp", "stratum"), 30, 4).collect()
    got = [x for r in sorted(sums, key=lambda r: r["first"]) for x in r["v"]]
    value = {g: v for g, _, v in rows}
    want = [0.0] * 30
    for r in resample.draws(df.select("grp", "stratum"), 30, 4).collect():
        want[r["replicate"]] += r["weight"] * value[r["grp"]]
    assert got == pytest.approx(want) and sums[0]["v_total"] == sum(value.values())


def test_statistics_run_is_its_parts(spark):
    df, groups = bootstrap_rows(spark)
    values = df.select("task", "grp", (F.col("a_id") == F.col("true_id")).cast("double").alias("value"))
    pairs = df.select("task", "grp", (F.col("a_id") == F.col("true_id")).cast("double").alias("a"), (F.col("b_id") == F.col("true_id")).cast("double").alias("b"))
    rows = df.select("task", "sample", "grp", "true_id", F.col("a_id").alias("pred_id"), F.lit(7).alias("seed"))
    part = lambda kind, d, **more: resample.statistic(kind, "one", d, ["task"], 3, **more)
    long = (part("mean", values).unionByName(part("mean difference", pairs, family=["task"])).unionByName(part("classification", rows))
            .unionByName(resample.statistic("classification", "two", rows, ["task", "seed"], 3, own_draws="seed")).unionByName(part("classification difference", df, family=["task"])))
    both = groups.withColumn("cohort", F.lit("one")).unionByName(groups.withColumn("cohort", F.lit("two")))
    out = {(r["statistic"], r["cohort"], r["metric"]): r for r in resample.statistics_run(long, both, 40).collect()}
    mean, test = resample.mean_intervals(values, groups, ["task"], 40).first(), resample.paired_mean_test(pairs, groups, ["task"], 40).first()
    assert out["mean", "one", None]["ci_low"] == mean["ci_low"] and out["mean difference", "one", None]["p_value"] == out["mean difference", "one", None]["p_holm"] == test["p_value"]
    for cohort, seeded in (("one", False), ("two", True)):
        for r in resample.classification_intervals(rows, groups, classes(spark, 3), ["task", "seed"], 40, by_seed=seeded).collect():
            got = out["classification", cohort, r["metric"]]
            assert (got["value"], got["ci_low"], got["ci_high"], got["p_holm"]) == (r["estimate"], pytest.approx(r["ci_low"]), pytest.approx(r["ci_high"]), None)
    for r in resample.paired_class_test(df, groups, classes(spark, 3), ["task"], 40).collect():
        got = out["classification difference", "one", r["metric"]]
        assert (got["value"], got["ci_low"], got["p_value"]) == (r["difference"], r["ci_low"], r["p_value"])


def test_statistics_of_samples_with_all_runs_are_those_of_predictions(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 7)
    df, groups = bootstrap_rows(spark)
    runs = [{"model": m, "strategy": s, "task": "t", "seed": k} for m in ("a", "b") for s in ("x", "y") for k in (3, 5)]
    preds = F.array(*[F.col("a_id") if i % 3 else (F.col("b_id") + i) % 3 for i in range(len(runs))])
    wide = df.select("sample", "grp", "true_id", preds.cast("array<int>").alias("preds"))
    families = [("strategy", "model", "a", "b"), ("model", "strategy", "x", "y")]
    run = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()], F.lit(i).alias("i")) for i, r in enumerate(runs)]))
    flat = wide.withColumn("r", run).select("sample", "grp", "true_id", "r.*", F.col("preds")[F.col("r.i")].alias("pred_id"))
    long = resample.statistic("classification", "t", flat, ["model", "strategy", "seed"], 3, own_draws="seed")
    for i, (held, varied, reference, alternative) in enumerate(families):
        side = lambda x, n: flat.where(F.col(varied) == x).select("sample", "grp", "true_id", held, "seed", F.col("pred_id").alias(n))
        both = side(alternative, "a_id").join(side(reference, "b_id"), ["sample", "grp", "true_id", held, "seed"])
        hit = both.withColumns({c: (F.col(f"{c}_id") == F.col("true_id")).cast("double") for c in "ab"})
        long = long.unionByName(resample.statistic("mean difference", "t", hit, [held, "seed"], family=[held]))
        if not i:
            long = long.unionByName(resample.statistic("classification difference", "t", both, [held, "seed"], 3, family=[held]))
    of = lambda rows: {tuple(r[c] for c in ("statistic", "cohort", "series", "metric")): r for r in rows}
    want = of(resample.statistics_run(long, groups.withColumn("cohort", F.lit("t")), 60).collect())
    for metrics in (True, False):
        got = of(resample.run_statistics(wide, runs, groups, classes(spark, 3), "t", families, 60, metrics=metrics).collect())
        assert set(got) == {k for k in want if metrics or k[0] == "mean difference"} and len(got) == (8 * 4 + 8 + 4 * 4 if metrics else 8)
        for k, r in got.items():
            for c in ("value", "ci_low", "ci_high", "n_bootstrap", "probability_a_better", "p_value"):
                assert r[c] == (None if want[k][c] is None else pytest.approx(want[k][c], abs=1e-12)), (k, c)


def test_distribution_holds_every_replicate(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 16)
    df, groups = bootstrap_rows(spark)
    rows = df.select("task", "sample", "grp", "true_id", F.col("a_id").alias("pred_id"))
    made = resample.classification_distribution(rows, groups, classes(spark, 3), ["task"], 40)
    assert sorted((r["metric"], r["first"], len(r["replicates"])) for r in made.collect()) == sorted((m, f, n) for m in evaluate.METRICS for f, n in ((0, 16), (16, 16), (32, 8)))
    weights = {}
    for r in resample.draws(groups, 40, 0).collect():
        weights.setdefault(r["replicate"], {})[r["grp"]] = r["weight"]
    every = [(r["grp"], r["true_id"] == r["pred_id"]) for r in rows.collect()]
    want = [sum(w.get(g, 0) * ok for g, ok in every) / sum(w.get(g, 0) for g, _ in every) for _, w in sorted(weights.items())]
    got = [x for r in sorted(made.where("metric = 'accuracy'").collect(), key=lambda r: r["first"]) for x in r["replicates"]]
    assert got == pytest.approx(want)
    interval = resample.distribution_intervals(made, ["task"]).where("metric = 'accuracy'").first()
    assert (interval["ci_low"], interval["ci_high"], interval["n_bootstrap"]) == (pytest.approx(np.quantile(want, 0.025)), pytest.approx(np.quantile(want, 0.975)), 40)


@pytest.mark.parametrize("by_seed", [False, True])
def test_intervals_of_samples_with_all_runs_are_those_of_predictions(spark, monkeypatch, by_seed):
    monkeypatch.setattr(resample, "SLICE", 7)
    df, groups = bootstrap_rows(spark)
    runs = [{"task": "t", "seed": s} for s in (3, 5, 9)]
    preds = F.array("a_id", "b_id", F.lit(2))
    wide = df.select("sample", "grp", "true_id", preds.alias("preds"))
    run = F.explode(F.array(*[F.struct(F.lit(r["task"]).alias("task"), F.lit(r["seed"]).alias("seed"), F.lit(i).alias("i")) for i, r in enumerate(runs)]))
    long = wide.withColumn("run", run).select("run.task", "run.seed", "sample", "grp", "true_id", F.col("preds")[F.col("run.i")].alias("pred_id"))
    plain = lambda x: sorted((r["task"], r["seed"], r["metric"], r["n_bootstrap"], *[round(r[c], 12) for c in ("estimate", "ci_low", "ci_high")]) for r in x.collect())
    universe = classes(spark, 4)  # one class has no row
    got = resample.run_intervals(wide, runs, groups, universe, 60, by_seed=by_seed)
    assert plain(got) == plain(resample.classification_intervals(long, groups, universe, ["task", "seed"], 60, by_seed=by_seed))
    assert "Generate explode(array" not in resample.run_distribution(wide, runs, groups, universe, 60)._jdf.queryExecution().executedPlan().toString()
    for bad in (F.slice("preds", 1, 2), F.array(F.lit(0), F.lit(1), F.lit(None).cast("int")), F.array(F.lit(0), F.lit(1), F.lit(7))):
        with pytest.raises(Exception, match="every run must have a class|not among the classes"):
            resample.run_intervals(wide.withColumn("preds", bad), runs, groups, universe, 10).collect()


def test_draws_of_a_large_stratum_are_multinomial(monkeypatch):
    """Weights of all slices sum to the stratum in every replicate; means, variances and pair covariances are those of equal draws."""
    monkeypatch.setattr(resample, "SLICE", 16)
    n, reps = 151, 2000
    w = np.concatenate([resample.weight_matrix(77, n, low, min(low + 16, n), 0, reps) for low in range(0, n, 16)], axis=1)
    assert (w.sum(axis=1) == n).all() and w.shape == (reps, n)
    assert (resample.weight_matrix(77, n, 32, 48, 0, 100) == w[:100, 32:48]).all()  # fewer replicates: the same ones
    assert (resample.weight_matrix(77, n, 32, 48, 2000, 2100) != w[:100, 32:48]).any() and (resample.weight_matrix(78, n, 32, 48, 0, 100) != w[:100, 32:48]).any()
    mean, cov = w.mean(axis=0), np.cov(w.T)
    assert abs(mean - 1).max() < 5 / np.sqrt(reps) and abs(np.diag(cov) - (1 - 1 / n)).max() < 0.25
    off = cov[~np.eye(n, dtype=bool)]
    assert abs(off.mean() + 1 / n) < 0.001 and off.std() < 1.3 / np.sqrt(reps)
    halves = w[:, :80].sum(axis=1)  # a binomial count
    assert abs(halves.mean() - 80) < 1 and abs(halves.var() - n * 80 / n * (1 - 80 / n)) < 4


def test_draws_of_a_whole_slice_are_multinomial(monkeypatch):
    """Exact shares of every count, covariances of two groups, and sums that are those asked for, where many parts are cut and where none is."""
    monkeypatch.setattr(resample, "SLICE", 16)
    for n in (3, 14, 60):
        w = resample.spread(np.full(60_000, n), (1, 2, 3))
        assert (w.sum(axis=1) == n).all() and w.min() >= 0
        for k in range(4):
            p = math.comb(n, k) * (1 / 16) ** k * (15 / 16) ** (n - k)
            assert abs((w == k).mean() - p) < 6 * math.sqrt(p / w.size) + 1e-9
        assert np.abs(w.mean(axis=0) - n / 16).max() < 5 * math.sqrt(n / 16 / len(w))
        cov = np.cov(w.T)
        assert np.abs(cov - n / 16 * (np.eye(16) - 1 / 16)).max() < 0.05 * n / 16 + 0.01
    assert (resample.spread(np.full(330, 14), (1, 2, 3)) == resample.spread(np.full(900, 14), (1, 2, 3))[:330]).all()


def test_draws_cost_what_their_slice_costs():
    """The count of one slice is found by a walk down the tree, whatever the stratum's size."""
    seconds = {}
    for n in (10_000, 100_000, 1_000_000):
        begin = time.perf_counter()
        w = resample.weight_matrix(5, n, 2048, 4096, 0, 100)
        seconds[n] = time.perf_counter() - begin
        assert abs(w.mean() - 1) < 0.01
    assert seconds[1_000_000] < 10 * seconds[10_000] + 0.2


def test_sums_over_slices_equal_a_join_with_the_draws(spark, monkeypatch):
    rows = [(f"g{i}", "one" if i % 5 else "two", float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "grp string, stratum string, v double")
    sums = resample.resampled_sums(df.select("grp", "v").withColumn("k", F.lit("x")), ["k"], ["v"], df.select("grp", "stratum"), 12, 4).collect()
    drawn = resample.draws(df.select("grp", "stratum"), 12, 4).join(df, "grp")
    per = {r["replicate"]: r for r in drawn.groupBy("replicate").agg(F.sum(F.col("weight") * F.col("v")).alias("s"), F.sum(F.when(F.col("stratum") == "one", F.col("weight"))).alias("n")).collect()}
    assert [x for r in sums for x in r["v"]] == pytest.approx([per[i]["s"] for i in range(12)]) and {r["n"] for r in per.values()} == {4000}


def test_pairs_that_do_not_match_fail(spark):
    left = spark.createDataFrame([(1, "g", 0, 1), (2, "g", 0, 0)], "sample int, grp string, true_id int, pred_id int")
    same = compare.agreeing(compare.aligned(left, left, ["sample"], ["grp", "true_id"], "pred_id"))
    assert same.count() == 2
    for bad in (left.where("sample = 1"), left.withColumn("true_id", F.lit(5))):
        with pytest.raises(Exception, match="other rows"):
            compare.agreeing(compare.aligned(left, bad, ["sample"], ["grp", "true_id"], "pred_id")).collect()


def test_pairs_within_dealt_groups_are_those_of_the_join_and_are_not_shuffled(spark):
    rows = spark.createDataFrame([(m, s, f"g{i % 7}", i % 3, (i + len(m)) % 3, i) for i in range(60) for m in ("x", "yy", "other") for s in (1, 2)],
                                 "model string, seed int, grp string, true_id int, pred_id int, sample int")
    side = lambda m: rows.where(F.col("model") == m)
    want = compare.agreeing(compare.aligned(side("yy"), side("x"), ["seed", "sample"], ["grp", "true_id"], "pred_id"))
    cut = rows.repartition(5, "grp")
    got = compare.agreeing(compare.side_by_side(cut, "model", "yy", "x", ["seed", "sample"], ["grp", "true_id"], "pred_id"))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 120
    plan = got.groupBy("seed", "grp").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    for bad in (rows.where("not (model = 'x' and sample = 4)"), rows.unionByName(rows.where("sample = 4")), rows.withColumn("true_id", F.when(F.expr("model = 'x' and sample = 4"), 9).otherwise(F.col("true_id")))):
        with pytest.raises(Exception, match="other rows"):
            compare.agreeing(compare.side_by_side(bad, "model", "yy", "x", ["seed", "sample"], ["grp", "true_id"], "pred_id")).collect()


def test_series_that_is_not_declared_fails(spark):
    pairs = spark.createDataFrame([(k, f"g{i}", 1.0, 0.0) for i in range(4) for k in (1, 2)], "seed int, grp string, a double, b double")
    groups = pairs.select("grp", F.lit("s").alias("stratum")).distinct()
    declared = spark.createDataFrame([(1,), (2,), (3,)], "seed int")
    want, got = (sorted(resample.paired_mean_test(pairs, groups, ["seed"], 20, series=x).collect()) for x in (None, declared))
    assert got == want and len(got) == 2
    with pytest.raises(Exception, match="not among the series"):
        resample.paired_mean_test(pairs, groups, ["seed"], 20, series=declared.where("seed = 1")).collect()


def test_first_rows_and_positions(spark):
    df = spark.createDataFrame([(5, "b"), (3, "a"), (4, None), (1, "z")], "k int, v string")
    assert [r["k"] for r in report.first_n(df, ["k"], 2).collect()] == [1, 3]
    assert [r["k"] for r in report.first_failures(df, F.col("v") != "z", ["k"], 1).collect()] == [1]
    assert [r["k"] for r in report.first_failures(df, F.col("v") != "z", ["k"]).collect()] == [1, 4]
    assert {r["v"]: r["position"] for r in report.with_position(df.where("v is not null"), {"v": ["z"]}).collect()} == {"z": 0, "a": 1, "b": 2}


def test_missing_predictions_get_a_row_of_nulls(spark):
    df = spark.createDataFrame([(1, 0, 10, [0.2, 0.8]), (1, 0, 99, [0.5, 0.5]), (2, 0, 10, [0.9, 0.1]), (2, 0, 11, [0.9, 0.1])], "seed int, fold int, sample int, probs array<double>")
    samples = spark.createDataFrame([(10,), (11,)], "sample int")
    got = {(r["seed"], r["sample"]): r["class_id"] for r in evaluate.assemble(df, samples, ["seed"]).collect()}
    assert got == {(1, 10): 1, (1, 11): None, (2, 10): 0, (2, 11): 0}


def test_probe_refuses_bad_items(spark):
    rows = [(f"{f}{c}", f"p{f}{c}", f, c, [1.0, float(f)]) for f in range(3) for c in "AB"]
    items = spark.createDataFrame(rows, "sample string, grp string, fold int, label string, features array<double>")
    checks.require(probe.probe_checks(items, 3))
    for bad in (items.where("fold < 2"), items.withColumn("fold", F.lit(0)), items.withColumn("features", F.when(F.col("sample") != "0A", F.col("features"))), items.union(items)):
        with pytest.raises(ValueError):
            checks.require(probe.probe_checks(bad, 3))


def test_sums_leave_a_task_once_whatever_the_number_of_slices(spark, monkeypatch):
    """Forty slices in four tasks: four rows of sums for a key and chunk, not forty, and the sums of the draws."""
    monkeypatch.setattr(resample, "DEALT", 4)
    groups = spark.range(40 * resample.SLICE).select(F.format_string("g%06d", "id").alias("grp"), F.lit("one").alias("stratum"))
    placed, parts = resample._placed(groups, 3)
    assert parts == 4 and placed.select("unit").distinct().count() == 40
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) == min(sizes)
    stats = groups.select("grp", F.lit("x").alias("k"), F.lit(1.0).alias("v"), F.lit(0.5).alias("half"))
    rows = resample.resampled_sums(stats, ["k"], ["v", "half"], groups, 7, 3).collect()
    assert [r["v_total"] for r in rows] == [40 * resample.SLICE]
    assert list(rows[0]["v"]) == [40 * resample.SLICE] * 7 and list(rows[0]["half"]) == [20 * resample.SLICE] * 7


def test_draw_counts_are_those_of_the_draws(spark):
    groups = spark.createDataFrame([(f"g{i}", f"s{i % 3}") for i in range(40)], "grp string, stratum string")
    w = resample.draws(groups, 30, 5)
    want = w.groupBy("grp").agg(F.count("*"), F.sum("weight"), F.max("weight"), F.sum(F.col("weight") * (F.col("replicate") + 1)))
    assert sorted(map(tuple, resample.draw_counts(groups, 30, 5).collect())) == sorted(map(tuple, want.collect()))


def test_counts_by_row_are_the_class_counts(spark):
    rows = spark.createDataFrame([("a", "g", 0, 0), ("a", "g", 0, 1), ("a", "h", 1, None), ("b", "g", None, 2), ("a", "g", 0, 1)], "k string, grp string, true_id int, pred_id int")
    one, two = (sorted(map(tuple, f(rows, ["k", "grp"]).collect()), key=repr) for f in (evaluate.counts_by_row, evaluate.class_counts))
    assert one == two


def test_checks_of_probabilities_are_one_pass_without_a_shuffle_of_rows(spark):
    given = [[0.5, 0.5], [0.2, 0.8], [None, 1.0], [float("nan"), 0.5], [], None, [1.5, -0.5], [0.4, 0.4], [0.2, 0.3, 0.5], [1.0, 1e-7]]
    df = spark.createDataFrame([(s, f"s{i}", p, 0) for s in (1, 2) for i, p in enumerate(given) if (s, i) != (2, 1)] + [(1, "s0", [0.0, 1.0], 0), (1, "x", [0.0, 1.0], 0)], "seed int, sample string, probs array<double>, fold int")
    samples = spark.createDataFrame([(f"s{i}",) for i in range(len(given))], "sample string")
    made = evaluate.probability_checks(df.repartition(8, "sample"), samples, ["seed"])
    told = {r["name"]: int(r["detail"].split()[0]) for r in made.collect()}
    # In both seeds a null entry, NaN, no array and 1.5 are out of range; a null entry, NaN, no array, no entry and 0.8 do not sum to one.
    assert told == {"each sample once per system and seed": 3, "probabilities in range": 8, "probabilities sum to one": 10, "one class count": 2}
    plan = made._jdf.queryExecution()
    assert sum("LogicalRDD" in line and "probs" in line for line in plan.optimizedPlan().toString().split("\n")) == 1
    assert not re.search(r"Exchange hashpartitioning\(seed#\d+, sample", plan.executedPlan().toString())


def test_assembled_without_a_search_is_the_same(spark):
    df = spark.createDataFrame([(s, f"s{i}", [0.3, 0.7], 0) for s in (1, 2) for i in range(4) if (s, i) != (2, 1)], "seed int, sample string, probs array<double>, fold int")
    samples = df.select("sample")
    for rows in (df, df.where("sample <> 's1'")):
        known = samples if rows is df else samples.where("sample <> 's1'")
        cells = evaluate.coverage(rows, known, ["seed"])
        want = evaluate.assemble(rows, known, ["seed"])
        assert sorted(map(str, evaluate.assemble(rows, known, ["seed"], cells).collect())) == sorted(map(str, want.collect()))
