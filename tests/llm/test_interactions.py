from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from salesops.llm import interactions
from salesops.llm.oracle import oracle_sql
from salesops.llm.queries import queries
from tests.conftest import SMALL

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(rows: list[tuple], labels: list[tuple]) -> dict:
    """Every filter applied to every document in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing = []
    for i, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        failing.append((i, lang or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in failing}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in failing if p == part]
            every = list(left)
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                fails = sum(name in f for _, f in every)
                only = sum(f == {name} for _, f in every)
                lost = [sum(i in s for i in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = (len(left), len(gone), fails - len(gone), only, *lost)
    return out


def found(df) -> dict:
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_query_matches_sql(spark):
    sql = oracle_sql()["op11_interactions"]
    assert differences(queries()["op11_interactions"](spark, SMALL), connect(SMALL), sql) == []


def test_matches_applying_filters(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (4, long + " #", "en"), (5, long + " #", None),
        (6, "SHOUT", "en"), (7, "SHOUT", "en"), (None, "SHOUT", "en"), (None, "SHOUT", "de"), (8, None, "en"), (9, "", "de"),
        (10, "a a a a $", "en"), (11, "A" * 9 + "a" * 91, "en"), (12, " \t".join(["W"] * 200), ""), (13, long + " x", "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 0), (2, 1, 1), (4, 0, 1), (6, None, None), (7, 0, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    result = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found(result) == plain(rows, labels)
    sums = result.groupBy("part", F.expr("substring(filter_order, step, 1)")).agg(F.sum("removed").alias("s"), F.min("shapley").alias("a"), F.max("shapley").alias("b"))
    assert all(r["s"] == r["a"] == r["b"] for r in sums.collect())


def test_hot_text(spark):
    """One text as nearly all rows: salted, and all but the first are copies."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = interactions.flagged(docs, interactions.standard_filters())
    copied = interactions.copies(docs, rows.select("doc_id", "hash"))
    assert sorted(r["doc_id"] for r in copied.collect()) == list(range(1, 2900))


def test_same_hash_is_not_same_text(spark):
    """Texts are compared, whatever the hashes say."""
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x")], "doc_id long, text string, lang string")
    hashes = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    assert [r["doc_id"] for r in interactions.copies(docs, hashes).collect()] == [3]


def test_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert found(interactions.audit(odd, labels)) == plain(rows, [(1, None, 1)])
    assert interactions.audit(no_docs, labels).count() == 0


def test_own_filters(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    result = interactions.audit(documents, labels, {"x": F.length("text") > 500}, copied="y")
    assert {r["filter_order"] for r in result.select("filter_order").distinct().collect()} == {"xy", "yx"}
    with pytest.raises(ValueError):
        interactions.audit(documents, labels, {"E": F.lit(True)})
