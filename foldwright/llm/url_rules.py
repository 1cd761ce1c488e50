"""URL rules indexed by their rarest literal token.

A rule is a host pattern, that fits the host and all subdomains, and a path pattern, that fits a path which starts so;
``*`` stands for any run of characters.  The tokens of a rule are the runs of letters and digits that must come whole in
every URL it fits.  Counts over all URLs tell which of them is rarest; under that token the rule is filed.  A URL looks
up the rules of its own tokens and runs the regular expressions of these candidates alone.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, put

RULES = "tier int, verdict string, host string, path string"
#: The rules of the query (tier 1), verdict, host and path.
LISTED = [(1, "allow", "org", "/"), (1, "block", "example.org", "/es/"), (1, "block", "example.org", "/en/1"), (1, "allow", "com", "/fr/"), (1, "block", "com", "/de/")]
#: Patterns that judge the URLs no rule of tier 1 fits.
PATTERNS = [(0, "block", h, p) for h, p in (("spam-*", ""), ("casino-*", ""), ("adult-*", ""), ("ads-*", ""), ("free-bets.*", ""), ("cheap-pills.*", ""),
                                            ("*", "/ads/"), ("*", "*/casino/"), ("*", "*/porn/"))]
_EDGE = re.compile(r"[0-9A-Za-z]+")


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens (``h:`` or ``p:`` before them) that a URL must have whole to fit: runs that touch neither ``*`` nor the path's open end."""
    out = {f"h:{m[0]}" for m in _EDGE.finditer(host) if "*" not in (host[m.start() - 1 : m.start()], host[m.end() : m.end() + 1])}
    return sorted(out | {f"p:{m[0]}" for m in _EDGE.finditer(path) if path[m.start() - 1 : m.start()] != "*" and path[m.end() : m.end() + 1] not in ("", "*")})


@lru_cache(100_000)
def compiled(host: str, path: str) -> tuple[re.Pattern, re.Pattern]:
    free = lambda p: ".*".join(map(re.escape, p.split("*")))
    return re.compile(rf"(?s:(?:.*\.)?{free(host)})\Z"), re.compile(f"(?s:{free(path)})")


def fits(host: str, path: str, rule_host: str, rule_path: str) -> bool:
    h, p = compiled(rule_host, rule_path)
    return bool(h.match(host) and p.match(path))


def url_tokens(host: Column, path: Column) -> Column:
    """The different tokens of a URL, and the empty one, under which rules without a token are filed."""
    runs = lambda c, mark: F.transform(F.regexp_extract_all(c, F.lit("([0-9A-Za-z]+)"), F.lit(1)), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), runs(host, "h:"), runs(path, "p:")))


def rule_index(rules: DataFrame, urls: DataFrame, few: bool) -> DataFrame:
    """``token, count, rank, rule, verdict, host, path``: each rule under the token that fewest of ``urls`` (``_tokens``) have, ties by the token.

    ``rank`` orders rules that fit one URL: tier, length, length of the host, block before allow, text.  ``few``: the rules
    are known to be few, so their tokens may be broadcast.
    """

    @F.pandas_udf("array<string>")
    def tokens(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([rule_tokens(h, p) or [""] for h, p in zip(host, path)], dtype=object)

    filed = rules.where("host is not null and path is not null and verdict is not null").dropDuplicates().withColumn("token", F.explode(tokens("host", "path")))
    filed = materialise(filed, "rule-tokens")
    wanted = filed.select("token").distinct()
    seen = urls.select(F.explode("_tokens").alias("token")).join(F.broadcast(wanted) if few else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("count"))
    counted = filed.join(seen, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = counted.groupBy("tier", "verdict", "host", "path").agg(F.min(F.struct("count", "token")).alias("b"))
    name = F.concat("host", "path")
    rank = F.struct(F.coalesce("tier", F.lit(0)).alias("tier"), F.length(name).alias("size"), F.length("host").alias("host_size"),
                    (F.col("verdict") == "block").cast("int").alias("blocks"), name.alias("rule"), F.col("verdict").alias("verdict"))
    return best.select("b.token", "b.count", rank.alias("rank"), "host", "path")


def _few(urls: DataFrame, index: DataFrame, out: str) -> DataFrame:
    """Every task holds the whole index."""
    filed = {}
    for r in index.collect():  # at most ``most_held`` rows
        filed.setdefault(r["token"], []).append((tuple(r["rank"]), r["host"], r["path"]))
    for rows in filed.values():
        rows.sort(reverse=True)
    shared = urls.sparkSession.sparkContext.broadcast(filed)

    @F.pandas_udf("tier int, rule string, verdict string, candidates int")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for hosts, paths, tokens in batches:
            rows = []
            for h, p, every in zip(hosts, paths, tokens):
                found = [c for t in every for c in known.get(t, ())]
                best = max((rank for rank, rh, rp in found if fits(h, p, rh, rp)), default=None)
                rows.append((*(best[0:1] + best[4:6] if best else (None, None, None)), len(found)))
            out = pd.DataFrame(rows, columns=["tier", "rule", "verdict", "candidates"])
            yield out.astype({"tier": "Int32", "candidates": "int32"})

    return urls.withColumn(out, judge("_host", "_path", "_tokens"))


def _many(urls: DataFrame, index: DataFrame, out: str, slice_rows: int) -> DataFrame:
    """URLs and index meet by a shuffle on the token.

    A token that more than ``slice_rows`` URLs have is dealt to so many slices by a hash of the URL row; its rules, no
    more than were filed under it, go to each slice.  The rarest tokens are short lists on the URL side by choice.
    """
    urls = materialise(urls.withColumn("_row", F.monotonically_increasing_id()), "urls")
    slices = F.ceil((F.col("count") + 1) / F.lit(slice_rows))
    spread = index.groupBy("token").agg(F.max(slices).alias("_slices"))
    exploded = urls.select("_row", "_host", "_path", F.explode("_tokens").alias("token"))
    exploded = exploded.join(F.broadcast(spread.where("_slices > 1")), "token", "left")  # each such token has its share of all URLs: few
    exploded = exploded.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.coalesce("_slices", F.lit(1))))
    dealt = index.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long") - 1)))

    @F.pandas_udf("boolean")
    def fit(hosts: pd.Series, paths: pd.Series, rule_hosts: pd.Series, rule_paths: pd.Series) -> pd.Series:
        return pd.Series([fits(*x) for x in zip(hosts, paths, rule_hosts, rule_paths)], dtype=bool)

    found = exploded.join(dealt.select("token", "_slice", "rank", "host", "path"), ["token", "_slice"])
    tried = found.withColumn("_fits", fit("_host", "_path", "host", "path"))
    best = tried.groupBy("_row").agg(F.max(F.when(F.col("_fits"), F.col("rank"))).alias("b"), F.count("*").cast("int").alias("n"))
    return urls.join(best, "_row", "left").withColumn(out, F.struct("b.tier", "b.rule", "b.verdict", F.coalesce("n", F.lit(0)).alias("candidates"))).drop("_row", "b", "n")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", out: str = "judged", most_held: int = 100_000, slice_rows: int = 1_000_000) -> DataFrame:
    """Add struct ``out``: ``host``, ``path``, ``tier``, ``rule`` (host and path of the rule that wins), ``verdict``, ``candidates``.

    Of the rules that fit the one of highest tier wins, then the longest, then the one with the longer host, then
    a block; no rule: ``tier``, ``rule`` and ``verdict`` are null.  ``candidates`` counts the rules whose expressions were run.
    Null URLs and such without ``://`` have empty host and path, which only rules with an empty path fit.  Up to ``most_held``
    rules are counted, then held by every task; more are joined by token.  Rules with a null part are left out, equal
    ones count once.  Repeated rows are judged alike; columns of ``pages`` stay, one named ``out`` as ``<out>_given``.
    """
    kept = [free_name(pages, c) for c in ("kept",)][0]
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(kept), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    held = held.withColumn("_tokens", url_tokens(F.col("_host"), F.col("_path")))
    few = rules.limit(most_held + 1).count() <= most_held
    index = materialise(rule_index(rules, held, few), "rule-index")
    done = _few(held, index, "_out") if few else _many(held, index, "_out", slice_rows)
    verdict = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), "_out.tier", "_out.rule", "_out.verdict", "_out.candidates")
    named = put(pages, **{out: F.lit(0)}).columns[:-1]
    return done.select(*[F.col(kept)[c].alias(n) for c, n in zip(pages.columns, named)], verdict.alias(out))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; pages that no listed rule fits are judged by the patterns, and allowed if none of these fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = F.col("judged")
    return apply_rules(pages, spark.createDataFrame(LISTED + PATTERNS, RULES)).select(
        "page_id", judged["host"].alias("host"), judged["path"].alias("path"), F.when(judged["tier"] == 1, judged["rule"]).alias("rule"),
        F.coalesce(judged["verdict"], F.lit("allow")).alias("verdict"))


#: Every rule on every URL, without an index.
ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
listed(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
        FROM u JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict
    WHEN regexp_matches(host, '(^|[.])(spam-|casino-|adult-|ads-|free-bets[.]|cheap-pills[.])') OR regexp_matches(path, '^/ads/|/casino/|/porn/') THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN (SELECT * FROM hit WHERE place = 1) USING (page_id)"""
