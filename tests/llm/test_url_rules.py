import random
import re

import pytest
from pyspark.sql import functions as F

from foldwright.llm import url_rules as ur

RULES = ur.LISTED + ur.PATTERNS + [(1, "block", "a.b.org", ""), (0, "allow", "*", "*"), (2, "block", "x-*.net", "/q*/z9/"), (2, "allow", "x-*.net", "/q*/z9/"),
                                   (1, "allow", "net", "/EN/7"), (1, "block", "net", "/EN/7"), (1, "block", "net", "/EN/7"), (1, None, "com", "/"), (1, "block", "été.com", "/ä/")]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url, rules):
    host, path = parts(url)
    best = None
    for tier, verdict, h, p in rules:
        if verdict is None:
            continue
        free = lambda x: ".*".join(re.escape(y) for y in x.split("*"))
        if re.fullmatch(f"(.*\\.)?{free(h)}", host, re.S) and re.match(free(p), path, re.S):
            best = max(best or (), (tier, len(h + p), len(h), verdict == "block", h + p, verdict))
    return (host, path, *((best[0], best[4], best[5]) if best else (None, None, None)))


def urls():
    rng = random.Random(8)
    hosts = ["example.org", "EXAMPLE.org", "m.Example.com", "com", "xcom", "org", "org:80", "spam-farm.example.net", "b.org", "a.b.org", "x-1.net", "x-y.z.net", "été.com", "É.com",
             "casino.net", "my-casino-win.net", "casino-win.net", "", "user@example.org", "a.free-bets.net", "free-bets"]
    paths = ["", "/", "/es/", "/es", "/ES/1", "/en/1", "/en/12?x=/fr/", "/en/2", "/fr/1", "/de/3#top", "?a=/de/", "#/fr/", "/ads/x", "/x/ads/y", "/x/casino/", "/q1/z9/", "/q/z/z9/", "/EN/77", "/ä/", "/a\nb/fr/", "//fr/"]
    out = [None, "", "no scheme", "://", "x://", "http:/one.org/", "https://a.org/://b.com/de/", "http://" + "a" * 50_000 + ".com/fr/" + "b" * 100_000, "a\nb://c.org/\n"]
    return out + [rng.choice(("http", "ftp", "")) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(800)]


@pytest.mark.parametrize("most_held", [1000, 0])
def test_equals_every_rule_on_every_url(spark, most_held):
    """With the index held by every task, and joined by token with hot tokens in slices."""
    rows = [(i, u, "c") for i, u in enumerate(urls())] + [(3, "http://org/", "c"), (3, "http://org/", "c"), (None, "http://a.com/de/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, judged string").withColumn("_row", F.lit(0)).repartition(3)
    rules = spark.createDataFrame(RULES, ur.RULES)
    out = ur.apply_rules(pages, rules, most_held=most_held, slice_rows=100)
    assert out.columns == ["page_id", "url", "judged_given", "_row", "judged"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        j = r["judged"]
        assert (j["host"], j["path"], j["tier"], j["rule"], j["verdict"]) == brute(r["url"], RULES), r["url"]
    assert sum(r["judged"]["candidates"] for r in got) < len(rows) * 6 < len(rows) * len(RULES)
    assert ur.apply_rules(pages.limit(0), rules, most_held=most_held).count() == 0
    assert {r["judged"]["verdict"] for r in ur.apply_rules(pages, rules.limit(0), most_held=most_held).collect()} == {None}


def test_a_rule_is_filed_under_its_rarest_token(spark):
    assert ur.rule_tokens("example.org", "/en/1") == ["h:example", "h:org", "p:en"]
    assert ur.rule_tokens("casino-*", "/a*b/c/") == ["h:casino", "p:c"] and ur.rule_tokens("*", "") == []
    pages = spark.createDataFrame([("a.org", "/en/")] * 5 + [("rare.org", "/en/")], "_host string, _path string").withColumn("_tokens", ur.url_tokens(F.col("_host"), F.col("_path")))
    for few in (True, False):
        index = ur.rule_index(spark.createDataFrame([(1, "block", "rare.org", "/en/"), (1, "block", "org", "/en/x"), (1, "block", "*", "")], ur.RULES), pages, few)
        assert {(r["token"], r["count"], r["host"]) for r in index.collect()} == {("h:rare", 1, "rare.org"), ("h:org", 6, "org"), ("", 6, "*")}
