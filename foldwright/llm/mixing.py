"""Mixing sources to target weights by hierarchical budgets.

The tree is domain / language / source.  A node's token budget is dealt to its children by
weight, no child getting more than it can supply (its tokens times ``max_epochs``); what a child
cannot take goes to its siblings, by weight, before anything is left to the node's own siblings.
A leaf then takes whole epochs of its documents and, of the next epoch, the longest prefix in a
seeded order that fits the rest of its budget.

Budgets are found by window sums over the few rows of the tree.  The prefix of a leaf is found by
descent: the places of a leaf are hexadecimal digests, its tokens are summed by the next two digits,
and the one of the 256 pieces where the budget ends is entered, until a piece has some hundred
places.  No task sees more of a leaf than that, however large the leaf is.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_name, materialise, put


@dataclass(frozen=True)
class Plan:
    """``target_share``: tokens wanted, as hundredths of all tokens; weights not named are ``1``, a key ``None`` names null."""

    domains: dict = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    sources: dict = field(default_factory=lambda: {"src0": 2})
    target_share: int = 60
    max_epochs: int = 2
    seed: int = 17


def word_tokens(text: Column) -> Column:
    """Words of a text, the token count that budgets are made of; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Domain of a source: its number modulo 4; sources without a number are ``d0``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(number != "", number.cast("long")) % 4, F.lit(0)).cast("string"))


def named(column: Column) -> Column:
    """A value's name in the tree: ``(none)`` for null; values that begin with a bracket get one more, so none of them is that."""
    return F.when(column.isNull(), F.lit("(none)")).when(column.startswith("("), F.concat(F.lit("("), column)).otherwise(column)


def named_value(value: str | None) -> str:
    return "(none)" if value is None else f"({value}" if value.startswith("(") else value


def weight_of(column: Column, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(column == named_value(name), F.lit(int(w))).otherwise(out)
    return out.cast("long")


def deal(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Split each parent's ``budget`` over its children (``cap``, ``w``): adds ``share`` (long).

    Children in order of cap per weight are full as long as their cap is at most their part of
    what is left; all others share the rest by weight.  The order is exact: caps are compared
    as ``cap * 1.0 / w``, ties by name.
    """
    by = Window.partitionBy(*parent)
    ordered = by.orderBy(F.col("cap") * F.lit(1.0) / F.col("w"), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest_b = F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest_w = F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = rest_b * F.lit(1.0) / rest_w
    x = nodes.withColumn("level", level).withColumn("full", F.col("cap") * F.lit(1.0) / F.col("w") <= F.col("level"))
    x = x.withColumn("open", F.min(F.when(~F.col("full"), F.struct((F.col("cap") * F.lit(1.0) / F.col("w")).alias("r"), F.col(name), F.col("level")))).over(by))
    share = F.when(F.col("open").isNull(), F.col("cap")).when(
        F.struct((F.col("cap") * F.lit(1.0) / F.col("w")).alias("r"), F.col(name)) < F.struct(F.col("open.r").alias("r"), F.col(f"open.{name}")),
        F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("w") * F.col("open.level"))))
    return x.withColumn("share", share.cast("long")).drop("level", "full", "open")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``domain, language, origin, tokens`` per leaf to the same with ``budget`` (tokens, long)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    tree = ["domain", "language", "origin"]
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * plan.target_share / F.lit(100.0)).cast("long").alias("top"))
    domains = (leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col("domain"), plan.domains))
               .crossJoin(total).withColumn("root", F.lit(0)))
    domains = deal(domains, ["root"], "domain", "top").select("domain", F.col("share").alias("of_domain"))
    languages = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col("language"), plan.languages))
    languages = deal(languages.join(domains, "domain"), ["domain"], "language", "of_domain").select("domain", "language", F.col("share").alias("of_language"))
    leaves = leaves.withColumn("w", weight_of(F.col("origin"), plan.sources)).join(languages, ["domain", "language"])
    return deal(leaves, ["domain", "language"], "origin", "of_language").select(*tree, "tokens", F.col("share").alias("budget"))


def _keyed(docs: DataFrame, plan: Plan, key: str, text: str, lang: str, source: str) -> DataFrame:
    """The slim columns that decide: leaf, tokens and place in the seeded order."""
    return docs.select(
        F.col(key).alias("id"), domain_of(F.col(source)).alias("domain"), named(F.col(lang)).alias("language"),
        named(F.col(source)).alias("origin"), word_tokens(F.col(text)).alias("n_tokens"))


def _place(plan: Plan, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(plan.seed).cast("string"), epoch.cast("string"), named(id_.cast("string"))).cast("binary"))


def cuts(slim: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf: ``whole`` epochs and, of the next epoch, the last place that is still taken (``upto``)."""
    leaf = ["domain", "language", "origin"]
    sizes = slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    planned = budgets(sizes, plan).join(sizes.select(*leaf, "rows"), leaf)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    planned = materialise(planned.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")
    most = planned.agg(F.max("rows")).first()[0] or 1

    def inside(cut: DataFrame) -> DataFrame:
        placed = slim.join(cut, leaf).withColumn("place", _place(plan, F.col("whole"), F.col("id")))
        return placed.where(F.col("place").startswith(F.col("piece")))

    cut = planned.select(*leaf, "whole", "rest", F.lit("").alias("piece"), F.lit(0).cast("long").alias("before"))
    upto = F.col("before") + F.sum("t").over(Window.partitionBy(*leaf).orderBy("next"))
    for level in range(1, max(2, math.ceil(math.log(most, 256)))):
        pieces = inside(cut).groupBy(*leaf, "whole", "rest", "before", F.expr(f"substring(place, 1, {2 * level})").alias("next")).agg(F.sum("n_tokens").alias("t"))
        ends = pieces.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
        cut = materialise(ends.select(*leaf, "whole", "rest", F.col("next").alias("piece"), (F.col("upto") - F.col("t")).alias("before")), "mix-piece")
    places = inside(cut).groupBy(*leaf, "rest", "before", F.col("place").alias("next")).agg(F.sum("n_tokens").alias("t"))
    taken = places.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy(*leaf).agg(F.max("next").alias("in_piece"))
    done = planned.join(cut.select(*leaf, "piece"), leaf, "left").join(taken, leaf, "left")
    # No last piece: the whole epoch fits (its rest is less than an epoch, so only an empty leaf does that).
    # Nothing taken in the last piece: all places below the piece's own prefix are taken.
    return done.select(*leaf, "budget", "whole",
                       F.when(F.col("piece").isNull(), F.lit("~")).otherwise(F.coalesce("in_piece", "piece")).alias("upto"))


def mix(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", lang: str = "lang",
        source: str = "source", out: str = "epochs") -> DataFrame:
    """The documents drawn, with ``out``: how many epochs take each (1 or more), and ``out``_leaf.

    Null ids, languages and sources form values of their own, named ``(none)`` (see ``named``); texts without words weigh nothing
    and ride along with their place.  Repeated rows share a place and are taken or left together.
    Equal seeds give equal draws on any partitioning.  Columns of ``docs`` that have an output's
    name are kept as ``<name>_given``.
    """
    slim = materialise(_keyed(docs, plan, key, text, lang, source), "mix-slim")
    cut = materialise(cuts(slim, plan), "mix-cuts")
    tags = [free_name(docs, f"leaf_{x}") for x in ("domain", "language", "origin", "whole", "upto")]
    rows = docs.withColumns({tags[0]: domain_of(F.col(source)), tags[1]: named(F.col(lang)), tags[2]: named(F.col(source))})
    drawn = rows.join(cut.select("domain", "language", "origin", "whole", "upto").toDF(*tags), tags[:3])
    times = F.col(tags[3]) + (_place(plan, F.col(tags[3]), F.col(key)) <= F.col(tags[4])).cast("long")
    return put(drawn.where(times > 0), **{out: times, f"{out}_leaf": F.concat_ws("/", *tags[:3])}).drop(*tags)


def repeat_epochs(docs: DataFrame, plan: Plan = Plan(), **names) -> DataFrame:
    """``mix`` with a row for each epoch that takes the document, in the columns of ``docs``."""
    out = free_name(docs, "epochs_of_row")
    drawn = mix(docs, plan, out=out, **names)
    return drawn.withColumn(out, F.explode(F.sequence(F.lit(1), F.col(out)))).select(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the default plan, with the times each is taken and its tokens."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", F.col("epochs_leaf").alias("leaf"), word_tokens(F.col("text")).alias("n_tokens"), F.col("epochs").alias("n_epochs"))


def oracle(plan: Plan = Plan(), table: str = "documents") -> str:
    """The same draw as one SQL statement over plain running sums."""

    def weight(column: str, weights: dict) -> str:
        return f"CASE {column} {' '.join(f'WHEN {named_value(name)!r} THEN {int(w)}' for name, w in weights.items())} ELSE 1 END"

    def own(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '(none)' WHEN {value} LIKE '(%' THEN '(' || {value} ELSE {value} END"

    def dealt(name: str, source: str, parent: str, child: str, budget: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        keep = f"{parent}, " if parent else ""
        return f"""
{name}_a AS (SELECT *, cap * 1.0 / w AS r,
    CAST({budget} - coalesce(sum(cap) OVER ({by} ORDER BY cap * 1.0 / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY cap * 1.0 / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER ({by} ORDER BY cap * 1.0 / w, {child}) AS pos FROM {source}),
{name}_b AS (SELECT *, min(CASE WHEN r > level THEN pos END) OVER ({by}) AS open FROM {name}_a),
{name} AS (SELECT {keep}{child}, CAST(CASE WHEN open IS NULL OR pos < open THEN cap
    ELSE least(cap, floor(w * max(CASE WHEN pos = open THEN level END) OVER ({by}))) END AS BIGINT) AS share FROM {name}_b)"""

    return f"""
WITH slim AS (SELECT doc_id, 'd' || coalesce(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> ''
        THEN CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 END, 0) AS domain,
    {own('lang')} AS language, {own('source')} AS origin,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM {table}),
leaf AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {plan.max_epochs} AS BIGINT) AS cap,
    CAST({weight("origin", plan.sources)} AS BIGINT) AS w FROM slim GROUP BY ALL),
top AS (SELECT CAST(floor(sum(tokens) * {plan.target_share} / 100.0) AS BIGINT) AS top FROM leaf),
dom AS (SELECT domain, cap, CAST({weight("domain", plan.domains)} AS BIGINT) AS w, top FROM
    (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY domain), top),{dealt("dom_s", "dom", "", "domain", "top")},
lan AS (SELECT domain, language, cap, CAST({weight("language", plan.languages)} AS BIGINT) AS w, share AS budget FROM
    (SELECT domain, language, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL) JOIN dom_s USING (domain)),{dealt("lan_s", "lan", "domain", "language", "budget")},
lea AS (SELECT leaf.*, share AS budget FROM leaf JOIN lan_s USING (domain, language)),{dealt("lea_s", "lea", "domain, language", "origin", "budget")},
plan AS (SELECT leaf.domain, leaf.language, leaf.origin, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole,
    share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM leaf JOIN lea_s USING (domain, language, origin)),
placed AS (SELECT slim.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, language, origin
    ORDER BY md5('{plan.seed}|' || whole || '|' || {own('CAST(doc_id AS VARCHAR)')})) AS upto FROM slim JOIN plan USING (domain, language, origin)),
drawn AS (SELECT doc_id, domain || '/' || language || '/' || origin AS leaf, n_tokens,
    CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_epochs FROM placed)
SELECT doc_id, leaf, n_tokens, n_epochs FROM drawn WHERE n_epochs > 0"""
