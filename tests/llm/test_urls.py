from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesops.llm import urls
from salesops.llm.queries import RULES, url_filter

URLS = [
    "http://A.Example.NET/en/1", "http://net/x", "http://xnet/x", "https://a.net", "https://a.net/", "ftp://u@b.ORG/fr/x?y#z",
    "http://example.com/de", "http://example.com/de/", "http://sub.example.com/de/x", "http://notexample.com/de/x", "http://b.org/fr",
    "no scheme", "", "://", ":///fr/", "http://example.net?x=/en/", "http://a.net://b/c", "http://ÄB.net/é?q", "http://x.net#/a/", None,
]


def plain(url: str | None) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in urls.judge(frame, RULES, urls.Boosting(trees=1, depth=1)).collect():
        host, path, rule, verdict = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_whole_table_is_judged_twice_alike(spark, small):
    rows = url_filter(spark, small).collect()
    given = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert sorted(r["page_id"] for r in rows) == sorted(given)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == plain(given[r["page_id"]])[:3]
    assert sorted(rows) == sorted(url_filter(spark, small).collect())


def test_features(spark):
    url = "https://a-b.c1.example.org/x/yy/?p=1&q=22#z"
    frame = spark.createDataFrame([(url,), (None,)], "url string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    full, empty = frame.select(*[c.alias(n) for n, c in urls.lexical(F.col("url"), host, path).items()]).collect()
    assert full["url_chars"] == len(url) and full["host_labels"] == 4 and full["depth"] == 2
    assert full["parameters"] == 2 and full["hyphens"] == 1 and full["host_digits"] == 1
    name = "a-b.c1.example.org"
    p = np.array([name.count(c) / len(name) for c in set(name)])
    assert full["host_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert full["digit_ratio"] == pytest.approx(4 / len(url))
    assert not any(empty)


def test_trees_learn_what_a_line_cannot(spark):
    """Blocked if exactly one of two features is large; held-out accuracy."""
    rng = np.random.default_rng(0)
    x = rng.random((1200, 3))
    label = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    rows = [(int(l), *map(float, r)) for l, r in zip(label, x)]
    frame = spark.createDataFrame(rows[:800], "label long, a double, b double, c double")
    prior, trees = urls.boost(frame, ["a", "b", "c"], urls.Boosting(trees=6))
    held = spark.createDataFrame(rows[800:], "label long, a double, b double, c double")
    right = held.filter((urls._margin(prior, trees) > 0) == (F.col("label") == 1)).count()
    assert right / 400 > 0.9


def test_one_kind_of_label_or_none(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 2.0)], "label long, a double")
    assert urls.boost(frame, ["a"]) == (1.0, [])
    assert urls.boost(frame.filter("a > 5"), ["a"]) == (-1.0, [])
    empty = spark.createDataFrame([], "page_id long, url string, score string, suffix_1 string")
    assert urls.judge(empty, RULES).count() == 0
