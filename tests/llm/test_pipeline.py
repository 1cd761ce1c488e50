"""Each stage of the pipeline against brute force, on its own input."""

import random

import corpus_pipeline
import tiktoken
from test_mixing import brute as brute_mix
from test_near_duplicates import brute_classes
from test_quality import brute as brute_quality
from test_secret_ledger import brute as brute_secrets

from foldwright.llm import bpe, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(600)]
    texts = [None, "", "too short"]
    for i in range(40):
        w = rng.choices(vocab, k=rng.randint(60, 160))
        texts.append(" ".join(w))
        if i % 3 == 0:
            texts.append(" ".join(w))
        if i % 4 == 0:
            w[7] = "changed"
            texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(" ".join(["same words again"] * 40))
        if i % 6 == 0:
            texts.append(" ".join([*rng.choices(vocab, k=70), 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']))
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [tuple(r) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "bpe"]
    good = sorted(r for r in rows if brute_quality(r[1])[-1])
    assert sorted(kept["quality"]) == good and 20 < len(good) < len(rows)
    classes = brute_classes([(r[0], r[1]) for r in good])
    assert sorted(r[0] for r in kept["near_dedup"]) == sorted(set(classes.values()))
    assert sorted(r[0] for r in kept["secrets"]) == sorted(set(classes.values()))
    for r in kept["secrets"]:
        before = rows[r[0]][1]
        spans = brute_secrets(before)
        assert not brute_secrets(r[1]) and (r[1] == before) == (not spans)
        assert not spans or r[1] == before[: spans[0][0]] + "[assign]" + before[max(s[2] for s in spans) :]
    want = brute_mix([r[:4] for r in kept["secrets"]], mixing.Plan())
    assert sorted(r[0] for r in kept["mix"]) == sorted(i for i, (_, _, n) in want.items() for _ in range(n))
    import public_tokenizers

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    text = {r[0]: r[1] for r in kept["mix"]}
    assert len(kept["bpe"]) == len(kept["mix"]) and all(list(r[3]) == enc.encode_ordinary(text[r[0]]) for r in kept["bpe"])
    whole = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert whole == sorted((r[0], r[5]) for r in kept["bpe"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
