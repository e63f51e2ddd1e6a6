import pytest

from tests.compare import compare, connect
from tidemark.llm import queries, url_filter


def judged(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    found = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), default).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fitting = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fitting, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.B.Net/x?y#z", "http://example.net/en/1",
    "http://www.EXAMPLE.net/en/", "http://example.net/en", "http://notexample.net/en/1", "http://net/", "http://x.org/fr/a/b",
    "http://x.org/fr", "https://m.example.com/de/?q", "http://example.com/de", "a://b://c.net/", "http://ÄÜ.net/é",
    "http://a.net?x=/", "http://x.net/" + "p/" * 5000, "http://" + "s." * 5000 + "net/", "http://a.net/", "http://.net/",
]
RULES = [*queries.URL_RULES, ("net", "/x", "allow"), ("b.net", "", "block"), ("a.net", "/", "block"), ("a.net", "/", "allow"), (None, "/", "block")]


@pytest.mark.parametrize("rules", [RULES, queries.URL_RULES])
def test_matches_brute_force(spark, rules):
    got = judged(spark, URLS, rules, "block")
    usable = [r for r in rules if r[0]]
    assert got == {i: brute(u, usable, "block") for i, u in enumerate(URLS)}


def test_hot_and_repeated_pages(spark):
    urls = [None] * 200 + ["http://a.net/same"] * 200 + [f"http://h{i}.com/" for i in range(100)]
    got = judged(spark, urls, queries.URL_RULES)
    assert len(got) == 500 and got[250] == ("a.net", "/same", "net/", "block") and got[0] == ("", "", None, "allow")


def test_empty_tables(spark):
    assert judged(spark, [], queries.URL_RULES) == {}
    assert judged(spark, ["http://a.net/"], []) == {0: ("a.net", "/", None, "allow")}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_url_filter"])
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, queries.QUERIES[name], queries.SQL[name]) is None
