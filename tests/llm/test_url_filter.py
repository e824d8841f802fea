"""URL filter rules against a plain loop over all rules."""

import random
import string
from collections import Counter

import pytest

from pathwise.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, rule string, `row` long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end].translate(LOWER), rest[end:]
    return host, tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]


def verdict(url, rules, default="allow"):
    host, path = cut(url)
    fits = [(len(h) + len(p or ""), len(h), h.translate(LOWER) + (p or ""), v == "block", v) for h, p, v in rules if h and v
            and (host == h.translate(LOWER) or host.endswith("." + h.translate(LOWER))) and path.startswith(p or "")]
    best = max(fits, key=lambda f: (f[0], f[1], f[3]), default=None)
    return host, path, best and best[2], best[4] if best else default


URLS = [None, "", "no scheme/en/1", "://", "http://", "http:///en/1", "http://org", "http://org/", "http://ORG/", "http://org?x=/", "http://xorg/",
        "http://a.org./", "http://example.org/en/1", "http://example.org/en/", "https://www.EXAMPLE.org/en/123?u=1#t", "http://notexample.org/en/1",
        "http://example.org:8080/en/1", "http://u@example.org/es/", "http://example.org/ES/", "ftp://b.a.example.org/es/x", "a://b://c.com/de/",
        "http://x.com/de/é", "http://x.com/fr/", "http://x.com/fr", "http://ÀÉ.org/É", "http://com/de/\nx", "http://é.com/de/", "http://.com/de/",
        "http://com/fr/#/de/", "http://" + "a." * 2000 + "com/de/" + "x" * 50000, "http://example.org/en/1", "http://example.org/en/1"]


def run(spark, urls, rules):
    rows = [(i % 7 if i % 5 else None, u, "<html>", "clash", "clash", 1) for i, u in enumerate(urls)]
    got = urlfilter.judge(spark.createDataFrame(rows, PAGES).repartition(3), urlfilter.rule_table(spark, rules)).collect()
    want = Counter((r[0], *verdict(r[1], rules)) for r in rows)
    assert Counter(map(tuple, got)) == want


def test_contract_rules(spark):
    run(spark, URLS, urlfilter.RULES)


def test_ties_null_rules_and_no_rules(spark):
    rules = [("Example.org", "/en/", "allow"), ("example.org", "/en/", "block"), ("a.com", None, "block"), ("com", "/x", "allow"),
             (None, "/", "block"), ("", "/", "block"), ("org", "/", None), ("example.org", "es/", "block"), ("net", "", "watch")]
    run(spark, [*URLS, "http://b.a.com/x", "http://a.com/xy", "http://com/x", "http://n.net"], rules)
    run(spark, URLS, [])


def test_many_rules(spark):
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("x/y") for _ in range(rng.randint(0, 5)))
    rules = [(name(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    run(spark, [f"http://{name()}{path()}" for _ in range(400)], rules)


def test_colliding_prefixes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PREFIX", 1)
    run(spark, URLS, urlfilter.RULES)


def test_empty_pages(spark):
    none = urlfilter.judge(spark.createDataFrame([], PAGES), urlfilter.rule_table(spark))
    assert none.columns == ["page_id", "host", "path", "rule", "verdict"] and none.collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    plan = urlfilter.judge(pages, urlfilter.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("url,rule", [("http://shop.example.org/en/17", "example.org/en/1"), ("http://shop.example.org/en/27", "org/")])
def test_rule_column(spark, url, rule):
    got = urlfilter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), urlfilter.rule_table(spark)).collect()
    assert got[0]["rule"] == rule
