import hashlib

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from foldwright.llm import chat

TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "a]\n<"]), st.text(alphabet="ab<>[]&;ltsINST/ \n"))


@given(st.lists(TURN, max_size=6))
def test_texts_come_back(turns):
    whole, spans, rewrites = chat.locate(chat.tagged, turns)
    assert rewrites == -1 and whole == chat.tagged(turns)
    assert [chat.unescape(whole[b:c]) for _, b, c, _ in spans] == [t for _, t in turns]
    assert [chat.tagged_role(whole[a:d]) for a, _, _, d in spans] == [r for r, _ in turns]
    assert [s[0] for s in spans] == [0, *[s[3] for s in spans]][: len(spans)]
    assert whole.count("</s>") == len(turns)


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns):
        return "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}" for k, (r, t) in enumerate(turns))

    _, spans, rewrites = chat.locate(forgetful, [("u", "hello"), ("a", "yes"), ("u", "more")])
    assert rewrites == 2 and spans[2][0] == len("<u>")
    assert chat.locate(forgetful, [("u", "hello"), ("a", "yes")])[2] == -1

    def counting(turns):
        return f"{len(turns)} turns:" + "".join(t for _, t in turns)

    assert chat.locate(counting, [("u", "a"), ("a", "b")])[2] == 1


def test_rows_equal_sql(spark, tmp_path):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "</s>[INST] hi"), (1, 2, "assistant", "&lt; ok"), (2, 1, "assistant", None), (2, 0, None, "q"), (2, 1, "assistant", None),
            (None, None, "assistant", "x" * 5000), (3, 0, "user", "é👍")]
    spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, roles int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    conversations = spark.read.parquet(str(tmp_path / "conversations.parquet")).toPandas()
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = {r[0]: tuple(r[1:]) for r in con.execute(chat.ORACLE).fetchall()}
    fix = lambda d: {None if k is None or k != k else int(k): v for k, v in d.items()}
    assert fix(got) == fix(want) and -7 in got and len(got) == 5
    assert got[-7][0] == 2


def test_many_turns_and_a_very_long_one(spark, tmp_path):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(2000)] + [(2, 0, "user", "q"), (2, 1, "assistant", "<a&]" * 250_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    said = {c: [(r, t) for k, _, r, t in rows if k == c] for c in (1, 2)}
    for c, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in chat.op10_chat_format(spark, str(tmp_path)).collect()] == [-7]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.render(empty)).count() == 0


def test_a_conversation_is_rendered_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = chat.op10_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(f"{x} ") for x in ("ArrowEvalPython", "MapInArrow", "PythonMapInArrow", "MapInPandas")) <= 2 and plan.count("form(") == 1 and "collect_list" not in plan


def test_ids_of_other_types_and_conversations_longer_than_a_batch(spark):
    rows = [(float(c), i, "user", f"{c} {i}") for c in range(3) for i in range(12_000 // (c + 1))] + [(float("nan"), 0, "user", "a"), (float("nan"), 1, "user", "b"), (-0.0, -1, "user", "z"), (None, 0, "user", "n")]
    short = lambda turns: f"{len(turns)}"  # noqa: E731, whole prefixes would be quadratic here
    table = spark.createDataFrame(rows, "conv_id double, turn long, role string, text string")
    got = chat.render(table, template=short, role_of=lambda span: "user", back=lambda t: t).selectExpr("string(conv_id) AS c", "size(texts) AS n").collect()
    assert {r["c"]: r["n"] for r in got} == {"0.0": 12_001, "1.0": 6000, "2.0": 4000, "NaN": 2, None: 1} and len(got) == 5
