"""URL filter against matching every rule to every URL."""

import pytest
from pyspark.sql import functions as F

from riskloom.llm import url_filter as U

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("co.uk/a", "block"), ("deep.co.uk/", "allow"), ("plain.org", "block"), (None, "block"), ("x.org/", None)]
URLS = ["http://Example.COM/en/1", "https://www.example.com/en/x?y=/z", "http://a.b.example.com/en", "http://notexample.com/en/", "http://example.com", "http://example.com?x", "ftp://net/es/1", "http://a.net/es/",
        "http://a.net/ES/", "no scheme", None, "", "://x", "http://", "http://t.co.uk/abc", "http://deep.co.uk/abc", "http://q.deep.co.uk/b", "http://plain.org", "http://sub.plain.org/any?x", "http://x.org/",
        "http://listed.org/p/", "https://www.listed.org/p?q=1#f", "http://other.listed.org/p", "http://a..com/b", "http://é.com/ü", "http://u:p@h.com:80/x", "http://one://two.com/z", "http://example.com/en/" + "a/" * 5000]


def by_hand(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in RULES:
        if rule and verdict:
            h, slash, p = rule.partition("/")
            if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), len(h), rule, verdict))
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    form = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
    return host, path, None, "block" if form and form in listed else "allow"


def test_judge(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string").withColumns({"rule": F.lit(1), "HOST": F.lit(2), "found": F.lit(3), "key": F.lit(4)})
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    listed = spark.createDataFrame([("http://listed.org/p",), (None,), ("nothing",)], "url string")
    got = U.judge(pages, rules, listed)
    rows = got.collect()
    assert got.columns == [*pages.columns, "host_", "path", "rule_", "verdict"] and len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host_, r.path, r.rule_, r.verdict) == by_hand(r.url, {"listed.org/p"}), r.url
    nothing = U.judge(pages, rules.filter("rule = 'none'"), listed.filter("url = 'none'"))
    assert {r.verdict for r in nothing.collect()} == {"allow"}
    assert U.judge(pages.filter("page_id < 0"), rules, listed).count() == 0


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_filter_has_no_false_negatives_and_few_false_positives(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("url site"), "id").alias("key"))
    blocks = max(1, -(-n // U.KEYS_PER_BLOCK))
    filter_ = U.bloom(keys, blocks)
    assert filter_.count() <= blocks
    assert U.possible(keys, filter_, blocks).count() == n
    strange = spark.range(20_000).select(F.concat(F.lit("url other"), "id").alias("key"))
    assert U.possible(strange, filter_, blocks).count() < 0.02 * 20_000


def test_a_url_costs_the_rules_of_its_own_host_only(spark):
    """Hundreds of path lengths in the list: a URL of a host without rules has its canonical form as only key."""
    rules = spark.createDataFrame([(f"site{i}.org/{'p' * i}", "block") for i in range(300)] + [("own.org/a", "block"), ("own.org/a/b", "allow"), ("org/", "allow")], "rule string, verdict string")
    known = U.entries(rules, spark.createDataFrame([], "url string"))
    urls = spark.createDataFrame([("http://www.other.com/ppppppppppp",), ("http://x.own.org/a/b/c",), ("http://site7.org/ppppppppppp",)], "url string")
    counts = {r.url: r["count"] for r in U.candidates(urls, known).groupBy("url").count().collect()}
    assert counts == {"http://www.other.com/ppppppppppp": 1, "http://x.own.org/a/b/c": 4, "http://site7.org/ppppppppppp": 3}


def test_repeated_null_urls(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (2, None), (3, "http://a.com/")], "page_id long, url string")
    got = U.judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"), pages.select("url"))
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == [
        (1, "", "", "", "allow"), (1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "a.com", "/", "com/", "allow")]
