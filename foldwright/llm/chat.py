"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string.  Nothing is known of
it: for each turn the conversation is rendered up to that turn, the output is compared with that
of the turns before, and what was added is the turn's span.  A second rendering with a probe in
place of the turn's text shows where the text lies inside the span.  A template whose output for
more turns does not begin with its output for fewer rewrites history, and is reported.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

Turn = tuple[str, str]
#: Stands, doubled as often as needed to be unique, for the text of a turn in a probe.
PROBE = "\ue000"


def escape(text: str) -> str:
    """Reversible: after it no ``<`` and no ``[`` is left, so no control string can occur in a text."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lb;")


def unescape(text: str) -> str:
    return text.replace("&lb;", "[").replace("&lt;", "<").replace("&amp;", "&")


def tagged(turns: list[Turn]) -> str:
    """The default template: ``<s>[role]``, newline, escaped text, ``</s>``, newline for each turn."""
    return "".join(f"<s>[{escape(role).replace(']', '&rb;')}]\n{escape(text)}</s>\n" for role, text in turns)


def tagged_role(span: str) -> str:
    """The role that a span of ``tagged`` names."""
    return unescape(span[span.index("[") + 1 : span.index("]")].replace("&rb;", "]"))


def locate(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """Rendered output, ``(span start, text start, text end, span end)`` per turn, first turn that rewrites (-1: none).

    A turn that rewrites history gets the span from the first changed character on.
    """
    before, spans, rewrites = "", [], -1
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        begin = len(before)
        if not now.startswith(before):
            begin = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            rewrites = k - 1 if rewrites < 0 else rewrites
        mark = PROBE
        while mark in turns[k - 1][0]:
            mark += PROBE
        probe = template([*turns[: k - 1], (turns[k - 1][0], mark)])
        at = probe.find(mark, min(begin, len(probe)))
        text = (at, len(now) - (len(probe) - at - len(mark))) if at >= 0 else (begin, begin)
        spans.append((begin, *text, len(now)))
        before = now
    return before, spans, rewrites


FORMATTED = ("formatted string, spans array<struct<start:int,text_start:int,text_end:int,end:int>>, rewrites_at int, "
             "roles array<string>, texts array<string>, loss array<struct<start:int,end:int>>")


#: The same for Arrow, and how many characters of output, or rows, leave a task at once.
_SPAN = pa.struct([(n, pa.int32()) for n in ("start", "text_start", "text_end", "end")])
_FORMATTED = {"formatted": pa.string(), "spans": pa.list_(_SPAN), "rewrites_at": pa.int32(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
              "loss": pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end")]))}
AT_ONCE, ROWS_AT_ONCE = 2_000_000, 1000


def _in_order(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, role, text``: the turns of a conversation in one task, one after another."""
    kind = conversations.schema[conv].dataType
    key = F.when(F.col(conv) == 0, F.lit(0).cast(kind)).otherwise(F.col(conv)) if isinstance(kind, (DoubleType, FloatType)) else F.col(conv)  # 0.0 and -0.0 are one id
    rows = conversations.select(key.alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def render(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           template: Callable[[list[Turn]], str] = tagged, role_of: Callable[[str], str] = tagged_role,
           back: Callable[[str], str] = unescape, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv`` and the columns of ``FORMATTED``.

    ``roles`` and ``texts`` are read back from the output; ``loss`` are the text spans of
    trained roles.  Turns are ordered by ``turn``, then role and text, so ties and repeated rows have one order and
    all count; null roles and texts count as empty, a null turn comes first, a null id is a
    conversation of its own.  A conversation is the unit of formatting: its turns meet in one task, which
    reads its conversations one after another and holds a batch of turns, one conversation and ``AT_ONCE`` characters of output.
    """

    def row(turns: list[Turn]) -> tuple:
        whole, spans, rewrites = locate(template, turns)
        roles = [role_of(whole[a:d]) for a, _, _, d in spans]
        loss = [{"start": s[1], "end": s[2]} for s, r in zip(spans, roles) if r in trained]
        return whole, [dict(zip(("start", "text_start", "text_end", "end"), s)) for s in spans], rewrites, roles, [back(whole[b:c]) for _, b, c, _ in spans], loss

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done, held = [], [], 0
        for kind, key, turns in _each(batches):
            names.append(key)
            done.append(row(turns))
            held += len(done[-1][0])
            if held >= AT_ONCE or len(done) >= ROWS_AT_ONCE:
                yield _batch(kind, names, done)
                names, done, held = [], [], 0
        if done:
            yield _batch(kind, names, done)

    dealt = _in_order(conversations, conv, turn, role, text)
    out = dealt.mapInArrow(form, f"conv {dealt.schema['conv'].dataType.simpleString()}, {FORMATTED}")
    return out.withColumnRenamed("conv", conv)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, object, list[Turn]]]:
    """Type of the id, id and turns of each conversation of a task, whose rows are sorted by it."""
    kind, now, turns = None, None, []
    for batch in batches:
        kind = batch.column(0).type
        for key, *turn in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turns and not (key == now or (key != key and now != now)):  # not a number is equal to itself, as in Spark
                yield kind, now, turns
                turns = []
            now = key
            turns.append(tuple(turn))
    if turns:
        yield kind, now, turns


def _batch(kind: pa.DataType, names: list, done: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*done), _FORMATTED.values())]
    return pa.RecordBatch.from_arrays([pa.array(names, kind), *columns], names=["conv", *_FORMATTED])


def digests(formatted: DataFrame, conv: str = "conv_id", back: Callable[[str], str] = unescape) -> DataFrame:
    """Turn and loss digests, read from the rendered output, its spans and its loss mask."""
    made = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first in range(0, batch.num_rows, 100):
                for w, rs, ts, mask in zip(*(batch.slice(first, 100).column(i).to_pylist() for i in range(1, 5))):
                    learned = "".join(back(w[m["start"] : m["end"]]) for m in mask)
                    told = "".join(f"{r}\n{t}\n" for r, t in zip(rs, ts))
                    out.append((len(rs), sha256(told.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(w)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), made.values())]], names=["conv", *made])

    rows = formatted.select(F.col(conv).alias("conv"), "formatted", "roles", "texts", "loss")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(digest, schema).withColumnRenamed("conv", conv)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of one that says the control strings themselves (-7)."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], table.schema)
    return digests(render(table.unionByName(hard)))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
ORACLE = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    CAST(sum(11 + length(replace({_ESCAPED.format('role')}, ']', '&rb;')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""
