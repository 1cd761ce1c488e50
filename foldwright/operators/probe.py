"""Linear probe on held-out folds: class weights, train-only scaling, one weighted softmax head per fold and seed."""

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import hash32
from ..functions.vectors import as_double
from . import checks
from .folds import roles, training_coverage
from .retrieval import input_checks


def class_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse class frequencies scaled to mean 1 within each key: ``keys..., label, n, weight``."""
    n = rows.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return n.withColumn("weight", (1.0 / F.col("n")) / F.avg(1.0 / F.col("n")).over(w))


def fold_scalers(items: DataFrame, n_folds: int) -> DataFrame:
    """Mean and population SD of each dimension over the training folds: ``held_fold, dim, mean, scale``.

    A constant dimension has scale 1.  Sums are taken once per fold; a training set is all folds less the held one.
    """
    long = items.select("fold", F.posexplode(as_double(F.col("features"))).alias("dim", "x"))
    per = long.groupBy("fold", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    held = per.withColumn("held_fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where("fold <> held_fold")
    total = held.groupBy("held_fold", "dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
                                                 (F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("n")).alias("square"))
    var = F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return total.select("held_fold", "dim", "mean", F.when(var <= 1e-24, F.lit(1.0)).otherwise(F.sqrt(var)).alias("scale"))


def standardise(items: DataFrame, n_folds: int) -> DataFrame:
    """``held_fold, sample, role, dim, value`` with the training mean and scale of the held-out fold applied to all rows."""
    long = roles(items, n_folds).select("held_fold", "sample", "role", F.posexplode(as_double(F.col("features"))).alias("dim", "x"))
    return long.join(F.broadcast(fold_scalers(items, n_folds)), ["held_fold", "dim"]).select(
        "held_fold", "sample", "role", "dim", ((F.col("x") - F.col("mean")) / F.col("scale")).alias("value"))


@dataclass(frozen=True)
class ProbeConfig:
    """AdamW on a weighted softmax head; no validation set, no early stop."""

    seeds: tuple[int, ...] = (101, 202, 303, 404, 505)
    epochs: int = 10
    batch: int = 256
    rate: float = 1e-3
    decay: float = 1e-2
    n_folds: int = 3
    #: Steps that a shard makes on its own before the heads are averaged, at least; most shards.
    least_steps: int = 16
    most_shards: int = 4096


def probe_checks(items: DataFrame, n_folds: int) -> DataFrame:
    """What training asks of items: unique, finite, one width, groups in one fold, exactly these folds, every label in every training set."""
    width = checks.check_row(items.agg(F.countDistinct(F.size("features")).alias("n")), "one width", F.sum((F.col("n") > 1).cast("long")))
    lacking = checks.check_row(training_coverage(items, "label", n_folds), "every label in every training set", F.count("*"))
    return checks.union_checks(input_checks(items, n_folds), width, lacking)


class Heads:
    """One softmax head for each held fold and seed; the heads of a fold are columns of one matrix, with their AdamW moments."""

    def __init__(self, config: ProbeConfig, width: int, classes: int):
        self.config, self.classes, self.t = config, classes, 0
        self.w = np.zeros((config.n_folds, width + 1, len(config.seeds) * classes))
        for f in range(config.n_folds):
            for i, s in enumerate(config.seeds):
                self.w[f, :width, i * classes : (i + 1) * classes] = np.random.default_rng([f, s]).uniform(-1, 1, (width, classes)) / np.sqrt(width)
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def softmax(self, f: int, z: np.ndarray) -> np.ndarray:
        logit = (z @ self.w[f]).reshape(len(z), len(self.config.seeds), self.classes)
        p = np.exp(logit - logit.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True)

    def step(self, f: int, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One AdamW step of all heads of fold ``f`` on the weighted mean loss of a batch (``z`` with a column of ones)."""
        c = self.config
        p = self.softmax(f, z)
        p[np.arange(len(y)), :, y] -= 1
        grad = z.T @ (p * weight[:, None, None]).reshape(len(y), -1) / max(weight.sum(), 1e-12)
        self.m[f] = 0.9 * self.m[f] + 0.1 * grad
        self.v[f] = 0.999 * self.v[f] + 0.001 * grad**2
        self.w[f] = self.w[f] * (1 - c.rate * c.decay) - c.rate * (self.m[f] / (1 - 0.9**self.t)) / (np.sqrt(self.v[f] / (1 - 0.999**self.t)) + 1e-8)


STATE = "fold int, block int, shard int, t int, seen double, sums binary"
#: Bytes of a block of a state.
BLOCK = 1 << 20


def column_blocks(shape: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Ranges of columns of a fold's heads, of about ``BLOCK`` bytes with their moments."""
    _, rows, columns = shape
    step = max(1, BLOCK // (3 * 8 * rows))
    return [(low, min(low + step, columns)) for low in range(0, columns, step)]


def add_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of some states of one block, in the order of their shards."""
    pdf = pdf.sort_values("shard")
    total = np.frombuffer(pdf["sums"].iloc[0]).copy()
    for more in pdf["sums"].iloc[1:]:
        total += np.frombuffer(more)
    first = pdf.iloc[0]
    return pd.DataFrame({"fold": [first["fold"]], "block": [first["block"]], "shard": [first["shard"]], "t": [pdf["t"].max()], "seen": [pdf["seen"].sum()], "sums": [total.tobytes()]})


def train_heads(items: DataFrame, config: ProbeConfig = ProbeConfig()) -> tuple[dict, list[str]]:
    """Heads for every (held fold, seed), trained together; each epoch reads every row once.

    Rows are dealt to shards by a hash of their id and ordered anew in each epoch.  A shard walks its
    rows in batches from the heads it was given; after the epoch heads and moments are averaged by
    rows: states are cut into blocks of columns, summed block by block in two rounds of shuffles, and
    only the one averaged state is read.  There are as many shards as leave each ``least_steps`` steps an
    epoch, so a small table is one shard and its training is plain AdamW.  The driver holds labels, scalers and heads alone.
    """
    spark = items.sparkSession
    labels = sorted(r[0] for r in items.select("label").distinct().collect())
    place = {v: i for i, v in enumerate(labels)}
    scal = fold_scalers(items, config.n_folds).toPandas()
    weights = class_weights(roles(items, config.n_folds).where("role = 'train'"), ["held_fold"]).toPandas()
    width = int(scal["dim"].max()) + 1
    mean, scale = np.zeros((config.n_folds, width)), np.ones((config.n_folds, width))
    mean[scal["held_fold"], scal["dim"]] = scal["mean"]
    scale[scal["held_fold"], scal["dim"]] = scal["scale"]
    cw = np.zeros((config.n_folds, len(labels)))
    cw[weights["held_fold"], weights["label"].map(place)] = weights["weight"]
    n_rows = int(weights["n"].sum()) // max(config.n_folds - 1, 1)
    shards = max(1, min(config.most_shards, n_rows // (config.batch * config.least_steps)))
    group = math.isqrt(shards - 1) + 1  # states that meet in a round
    heads = Heads(config, width, len(labels))
    blocks = column_blocks(heads.w.shape)
    # Cached blocks that are lost are made again from the items.
    rows = items.select("sample", "fold", "label", "features").repartition(shards, "sample").withColumn("shard", F.spark_partition_id()).cache()
    for epoch in range(config.epochs):
        shared = spark.sparkContext.broadcast((heads, mean, scale, cw))

        def walk(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            h, mu, sc, wt = shared.value
            h, seen, shard = copy.deepcopy(h), np.zeros(config.n_folds), None
            for pdf in batches:
                for at in range(0, len(pdf), config.batch):
                    part = pdf.iloc[at : at + config.batch]
                    x, y, fold = np.stack(part["features"]).astype(float), part["label"].map(place).to_numpy(), part["fold"].to_numpy()
                    shard, h.t = int(part["shard"].iloc[0]), h.t + 1
                    for f in range(config.n_folds):
                        mine = fold != f
                        if mine.any():
                            h.step(f, np.c_[(x[mine] - mu[f]) / sc[f], np.ones(mine.sum())], y[mine], wt[f, y[mine]])
                            seen[f] += mine.sum()
            if shard is not None:
                for f in np.flatnonzero(seen):
                    state = np.stack((h.w[f], h.m[f], h.v[f])) * seen[f]
                    for k, (low, high) in enumerate(blocks):
                        yield pd.DataFrame({"fold": [f], "block": [k], "shard": [shard], "t": [h.t], "seen": [seen[f]], "sums": [state[:, :, low:high].tobytes()]})

        ordered = rows.withColumn("turn", hash32(config.seeds[0], epoch, F.col("sample"))).sortWithinPartitions("turn", "sample")
        states = ordered.mapInPandas(walk, STATE).withColumn("part", F.floor(F.col("shard") / group))
        once = states.groupBy("fold", "block", "part").applyInPandas(add_states, STATE)
        for r in once.groupBy("fold", "block").applyInPandas(add_states, STATE).toLocalIterator():  # one state, block by block
            low, high = blocks[r["block"]]
            sums = np.frombuffer(r["sums"]).reshape(3, width + 1, high - low) / r["seen"]
            heads.w[r["fold"], :, low:high], heads.m[r["fold"], :, low:high], heads.v[r["fold"], :, low:high] = sums
            heads.t = max(heads.t, r["t"])
        shared.unpersist()
    rows.unpersist()
    return {"heads": heads, "mean": mean, "scale": scale}, labels


def probe_probabilities(items: DataFrame, model: dict) -> DataFrame:
    """Held-out probabilities of every head: ``seed, fold, sample, probs``; a sample is scored where its fold is held."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for f, mine in pdf.groupby("fold"):
                z = (np.stack(mine["features"]).astype(float) - m["mean"][f]) / m["scale"][f]
                p = m["heads"].softmax(int(f), np.c_[z, np.ones(len(z))])
                for i, s in enumerate(m["heads"].config.seeds):
                    yield pd.DataFrame({"seed": s, "fold": f, "sample": mine["sample"].to_numpy(), "probs": list(p[:, i])})

    return items.select("sample", "fold", "features").mapInPandas(apply, "seed int, fold int, sample string, probs array<double>")


def run_probe(items: DataFrame, config: ProbeConfig = ProbeConfig()) -> tuple[DataFrame, list[str]]:
    """Check the items, train, and score every sample where its fold is held."""
    checks.require(probe_checks(items, config.n_folds))
    model, labels = train_heads(items, config)
    return probe_probabilities(items, model), labels
