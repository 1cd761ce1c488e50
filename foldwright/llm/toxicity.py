"""Toxicity by a counterfactually regularised linear classifier.

Features are the hashed words of a text and the beginnings of its longer words, as present and as
dense (twice or more, and at least once in 80 words): inflected or compound insults share a
beginning, and what a text uses once by chance is not dense.

Each labelled text is paired with counterfactuals.  Identity terms in it are swapped for another of
their group.  As most texts name no group, each also comes as a copy that mentions one: a term,
chosen by a hash of the text, is put between two of its words, and has a twin in which that term is
swapped.  Copies keep the label of their text and are part of the log loss; besides, the fit
penalises the squared change of the logit from each text and copy to its twin, so that naming one
group rather than another does not move the score.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_of, materialise, put
from .textgrid import U64, Grid, clean, mix, slices, span_hash

# Identity terms (fixed values): each is swapped for the next of its row, the last for the first.
IDENTITY = (
    ("women", "men", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("girls", "boys", "mädchen", "jungen", "filles", "garçons", "niñas", "niños"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
)
DIMS = 1 << 20


#: Bytes of the beginnings of words that are features; 0: the whole word.
HEADS = (0, 5, 6, 7)
_NEXT = {a: b for row in IDENTITY for a, b in zip(row, [*row[1:], row[0]])}
_TERMS = [*_NEXT]
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swap_terms(text: str) -> str:
    """The text with each identity term replaced by the next of its row."""
    return _TERM.sub(lambda m: _NEXT.get(m[0].lower(), m[0]), text)


def mention(text: str) -> str:
    """The text with an identity term between two of its words; term and place follow from a hash of the text."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    term = _TERMS[seed % len(_TERMS)]
    gaps = [m.end() for m in re.finditer(r"\s+", text)]
    at = gaps[(seed // len(_TERMS)) % len(gaps)] if gaps else 0
    return f"{text[:at]}{term} {text[at:]}"


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: document and feature, ordered by both."""
    g = Grid([t.lower() for t in texts], "letters")
    found = []
    for size in HEADS:
        some = np.flatnonzero(g.end - g.start > size) if size else np.arange(len(g.start))
        h = mix(span_hash(g.buf, g.start[some], g.start[some] + size if size else g.end) + U64(size))
        both, count = np.unique((g.doc[some].astype(np.int64) << 20) | (h % U64(DIMS)).astype(np.int64), return_counts=True)
        dense = both[(count >= 2) & (count * 80 >= g.words[both >> 20])]
        found += [both, (dense & ~np.int64(DIMS - 1)) | ((dense * 7919 + 1) & (DIMS - 1))]
    both = np.unique(np.concatenate(found))
    return both >> 20, both & (DIMS - 1)


@dataclass
class Classifier:
    columns: np.ndarray  # features, ascending
    weights: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        if not len(self.columns):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.columns, feature), len(self.columns) - 1)
        known = self.columns[at] == feature
        return self.bias + np.bincount(doc[known], weights=self.weights[at[known]], minlength=n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_weights(y: np.ndarray, doc: np.ndarray, col: np.ndarray, doc2: np.ndarray, col2: np.ndarray, width: int,
                fairness: float = 1.0, ridge: float = 2e-5, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on mean log loss + fairness * mean squared logit change + ridge."""
    n = max(len(y), 1)
    size = np.maximum(np.bincount(doc, minlength=n).max(initial=0), np.bincount(doc2, minlength=n).max(initial=0)) + 1
    step = 1.0 / (0.25 * size + 2 * fairness * min(size, 16) + ridge)
    w, b, vw, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for i in range(rounds):
        m = i / (i + 3.0)
        aw, ab = w + m * vw, b + m * vb
        z = np.bincount(doc, weights=aw[col], minlength=n) + ab
        gap = z - ab - np.bincount(doc2, weights=aw[col2], minlength=n)
        err = (sigmoid(z) - y) / n
        pull = 2 * fairness * gap / n
        grad = np.bincount(col, weights=(err + pull)[doc], minlength=width) - np.bincount(col2, weights=pull[doc2], minlength=width) + ridge * aw
        nw, nb = aw - step * grad, ab - step * err.sum() * 4
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          most_rows: int = 12_000, most_features: int = 1000, least_z: float = 5.0, fairness: float = 1.0) -> Classifier:
    """Fit on at most ``most_rows`` labelled texts, chosen by a hash of the key (the documented bound), and one mentioning copy of each.

    Features are kept if their rates among toxic and other texts differ by ``least_z`` standard
    errors, the strongest ``most_features`` of them, and all identity terms.  Contradictory labels
    of one key count as toxic; keys, labels and texts that are null are left out.  A key brings one
    text however many rows hold it, of several texts the one with the smallest hash, so ``most_rows``
    bounds what is fitted and what comes to the driver.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
             .orderBy(F.xxhash64(key), key).limit(most_rows))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).join(F.broadcast(known), key)
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes of text are much work
    rows = rows.groupBy(key, "y").agg(one.alias("one")).repartition(tasks, key).select("y", "one.text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch["text"])
            ys = batch["y"].to_numpy()
            for cut in slices([len(t) for t in texts], 2_000_000):
                for copy in (False, True):
                    part = [mention(t) for t in texts[cut]] if copy else texts[cut]
                    lists = []
                    for some in (part, [swap_terms(t) for t in part]):
                        doc, feature = features(some)
                        ends = np.searchsorted(doc, np.arange(len(some) + 1))
                        lists.append([feature[a:b] for a, b in zip(ends[:-1], ends[1:])])
                    yield pd.DataFrame({"y": ys[cut].astype(np.int32), "copy": copy, "mine": lists[0], "other": lists[1]})

    pairs = materialise(rows.mapInPandas(extract, "y int, copy boolean, mine array<int>, other array<int>"), "toxicity-features")
    seen = pairs.where(~F.col("copy"))
    n, toxic = seen.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), -4.0 if not toxic else 4.0)
    rate = F.col("n") / n
    z = (F.col("t") / toxic - (F.col("n") - F.col("t")) / (n - toxic)) / F.sqrt(rate * (1 - rate) * (1 / toxic + 1 / (n - toxic)))
    strong = (seen.select("y", F.explode("mine").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
              .where((F.col("n") >= 3) & (F.col("n") < n)).withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
              .orderBy(F.desc("z"), "f").limit(most_features).select("f").toPandas())
    columns = np.unique(np.concatenate((strong["f"].to_numpy(np.int64), features([*_NEXT])[1])))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], **{c: [np.intersect1d(f, columns) for f in batch[c]] for c in ("mine", "other")}})

    few = pairs.mapInPandas(narrow, "y int, mine array<int>, other array<int>").toPandas()

    def flat(lists) -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return doc, np.searchsorted(columns, np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))

    weights, bias = fit_weights(few["y"].to_numpy(float), *flat(few["mine"]), *flat(few["other"]), len(columns), fairness)
    return Classifier(columns, weights, bias)


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, the probability of label 1 (double); null and empty texts get that of a text without words.

    Repeated rows get equal scores; a column named ``out`` is kept as ``<out>_given``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            texts = clean(batch)
            out = [np.zeros(0)]
            for cut in slices([len(t) for t in texts], 2_000_000):
                out.append(sigmoid(m.logits(*features(texts[cut]), cut.stop - cut.start)))
            yield pd.Series(np.concatenate(out))

    return put(docs, **{out: probability(F.col(text))})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels learned outside the held-out third."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held)
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
