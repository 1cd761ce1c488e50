"""Secret scans with an incremental blob ledger.

A text is a *blob*, named by its SHA-256.  A store is a folder with two Parquet tables.  The
*manifest* lists every version of every path (document): ``path, version, blob``.  The *ledger* says
which blob was scanned under which version of which rule, with the spans found.  ``commit`` takes
the documents of one version, runs only pairs of blob and rule version that the ledger lacks, and
lists the version; ``history`` joins the findings back to every path and version that held the
blob, also where the text was replaced since.
"""

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_of, free_name, put, shared_dir
from .textgrid import clean


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped.

    ``hints``: every match holds one of these, in lower case; a text without any is not searched.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# Fixed values of the contract: the three base rules, in the order in which spans are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),  # the runs [0-9a-f]+ of 24 characters or more
)
# A private key runs from BEGIN to END, if no other boundary lies between.  Where END is missing, it takes the
# base64 that follows: encryption headers, runs of 20 characters or more, shorter ones that fill a line, and what
# trails a run on its line and cannot be a word.  Line breaks may be escapes, lines quoted or indented.  All
# repeats are possessive, so the time is linear in the text.
_PAD = r"""[\x20\t"'+,;>#*]*+"""
_NEXT = rf"(?:{_PAD}(?:[\r\n]|\\[nr]))++{_PAD}"
_HEAD = r"(?:Proc-Type:\x20?4,[A-Z-]++|DEK-Info:\x20?[A-Z0-9-]++(?:,[0-9A-Fa-f]++)?)"
_RUN = r"[A-Za-z0-9+/]"
_BODY = (rf"(?:(?:{_NEXT}|{_PAD})(?:{_HEAD}|{_RUN}{{20,}}+={{0,2}}(?:{_PAD}(?=[A-Za-z]*+[0-9+/=]){_RUN}*+={{0,2}})?|{_RUN}++={{0,2}}(?=\s*+\Z))"
         rf"|{_NEXT}{_RUN}++={{0,2}}(?={_PAD}(?:[\r\n]|\\[nr]|\Z)))*+")
_KEY = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|{_BODY})"
#: Added by this operator; listed after the base kinds.
MORE = (
    Rule("pem", 2, _KEY, 0, hints=("private key",)),
    Rule("bearer", 1, r"\bBearer\x20+([A-Za-z0-9_.=-]+)", 16, 1, hints=("bearer",)),
    Rule("webtoken", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 20, hints=("eyj",)),
)
RULES = BASE + MORE

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``batches`` without rows whose blob came before in this task; it keeps a digest for each blob of the task."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for blob in map(bytes.fromhex, batch["blob"]):
            new.append(blob not in seen)
            seen.add(blob)
        yield batch[new]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, text, todo`` (array of rule kinds) to rows of ``LEDGER``, one per blob and rule run of a task.

    Spans are in code points, end exclusive, leftmost and not overlapping within a rule.
    """
    kinds = {r.kind: i for i, r in enumerate(rules)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [r.compiled() for r in rules]
        for batch in unseen(batches):
            rows = []
            for blob, text, todo in zip(batch["blob"], clean(batch["text"]), batch["todo"]):
                low = text.lower()
                for kind in todo:
                    i = kinds[kind]
                    r = rules[i]
                    near = not r.hints or any(h in low for h in r.hints)
                    spans = [dict(zip(("start", "end"), m.span())) for m in compiled[i].finditer(text) if len(m.group(r.group)) >= r.least] if near else []
                    rows.append((blob, kind, r.version, spans))
            yield pd.DataFrame(rows, columns=["blob", "kind", "version", "spans"])

    return blobs.mapInPandas(scan, LEDGER)


def with_blob(docs: DataFrame, text: str = "text", out: str = "blob") -> DataFrame:
    return docs.withColumn(out, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, or an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what ``docs`` holds and the ledger lacks; append it; return the whole ledger.

    Null texts count as empty.  Copies of a text are scanned once, however many rows hold it.  A
    rule whose version was raised is run again on every blob, the other rules are not.  A failed
    run appends nothing, as Parquet files appear when the write job commits.
    """
    spark = docs.sparkSession
    known = read_ledger(spark, path)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    have = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("have"))
    # Copies are dropped inside the tasks that read them, the rest in the task that a blob is dealt to.  A text is
    # shuffled once and never sorted: an aggregate or a merge join with texts in its rows would sort them all.
    blobs = with_blob(docs.select(F.col(text).alias("text"))).mapInPandas(unseen, "text string, blob string").repartition("blob")
    fresh = (blobs.join(have.hint("shuffle_hash"), "blob", "left")
             .withColumn("todo", F.array_except(wanted, F.coalesce("have", F.array().cast("array<struct<kind:string,version:int>>")))["kind"])
             .where(F.size("todo") > 0).select("blob", "text", "todo"))
    scan_blobs(fresh, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def commit(docs: DataFrame, store: str, version: int, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> None:
    """Scan what ``docs``, the documents of ``version``, brings anew, and list each row's path and blob under that version.

    The ledger is written first and a version's part of the manifest replaced as a whole, so a commit
    that failed or was repeated leaves no row twice.  Null texts are the empty blob, null ids a null path.
    """
    update_ledger(docs, f"{store}/ledger", rules, text)
    with_blob(docs.select(F.col(key).alias("path"), F.col(text).alias("text")), "text").select("path", "blob").write.mode("overwrite").parquet(f"{store}/manifest/version={int(version)}")


def history(spark: SparkSession, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, version, blob, found`` for every row ever committed; ``found``: the spans of the present rule versions, an empty array where there are none."""
    found = findings(read_ledger(spark, f"{store}/ledger"), rules)
    listed = spark.read.parquet(f"{store}/manifest")
    return (listed.join(found, "blob", "left")
            .select("path", "version", "blob", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found")))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with a finding: ``found``, all spans of the present rule versions, ordered by start, then kind."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    flat = (ledger.where(F.size("spans") > 0).where(F.col("version") == now[F.col("kind")])
            .dropDuplicates(["blob", "kind"])
            .select("blob", "kind", order[F.col("kind")].alias("rank"), F.explode("spans").alias("s")))
    return flat.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("rank"), F.col("s.end").alias("end"), F.col("kind")))).alias("found"))


def attach(docs: DataFrame, found: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """Add ``out`` to every row of ``docs``: the findings of its blob, an empty array where there are none.

    A column of ``docs`` of that name is kept as ``<out>_given``.
    """
    key, spans = free_name(docs, "blob_of_row"), free_name(docs, "spans_of_blob")
    kind = found.schema["found"].dataType
    joined = with_blob(docs, text, key).join(found.select(F.col("blob").alias(key), F.col("found").alias(spans)), key, "left")
    return put(joined, **{out: F.coalesce(F.col(spans), F.array().cast(kind))}).drop(key, spans)


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by ``[kind]``; overlapping spans are replaced as one."""
    out = free_name(docs, "found_in_row")

    @F.pandas_udf("string")
    def cover(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            done = []
            for t, some in zip(texts, spans):
                parts, at = [], 0
                for s in some if t is not None and some is not None else ():
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                done.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(done, dtype=object)

    joined = attach(docs, found, text, out)
    return joined.withColumn(text, F.when(F.size(out) > 0, cover(F.col(text), F.col(out))).otherwise(F.col(text))).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, committed to a store in two versions, each of which brings half of the documents.

    Copies in the second half of what the first half held are not scanned again.
    """
    docs, store = documents(spark, sf_dir).select("doc_id", "text"), new_ledger(spark)
    half = F.coalesce(fold_of(F.col("doc_id"), 2), F.lit(0))
    for version in (0, 1):
        commit(docs.where(half == version), store, version)
    base = [r.kind for r in BASE]

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return history(spark, store).select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(line(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"))
