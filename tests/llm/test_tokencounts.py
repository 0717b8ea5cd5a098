from __future__ import annotations

import pytest

from checks.compare import connect, differences
from salesops.llm import tokencounts
from salesops.llm.oracle import oracle_sql
from salesops.llm.queries import token_counts
from tests.llm.conftest import ODD

CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, tokens long, chars long"


@pytest.fixture
def store(spark, tmp_path):
    return tokencounts.Store(spark, str(tmp_path / "store"))


def totals(store) -> dict:
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_matches_sql(spark, small):
    found = token_counts(spark, small)
    assert differences(found, connect(small), oracle_sql()["op6_tokencounts"]) == []


def test_signed_changes(spark, store):
    first = [("insert", 1, "t1", "a", "en", 10, 50), ("insert", 1, "t2", "a", "en", 20, 50), ("insert", 2, "t1", "a", "en", 7, 30)]
    assert store.commit("1", spark.createDataFrame(first, CHANGES))
    assert totals(store) == {("a", "en", "t1"): (2, 17, 80), ("a", "en", "t2"): (1, 20, 50)}
    later = [("revise", 1, "t1", "b", "en", 11, 51), ("delete", 2, None, None, None, None, None), ("delete", 9, None, None, None, None, None)]
    assert store.commit("2", spark.createDataFrame(later, CHANGES))
    assert totals(store) == {("b", "en", "t1"): (1, 11, 51), ("a", "en", "t2"): (1, 20, 50)}
    assert not store.commit("2", spark.createDataFrame(later, CHANGES))
    assert not store.commit("1", spark.createDataFrame(first, CHANGES))
    assert totals(store) == {("b", "en", "t1"): (1, 11, 51), ("a", "en", "t2"): (1, 20, 50)}
    assert store.commit("3", spark.createDataFrame([("insert", 2, "t1", "a", "en", 7, 30)], CHANGES))
    assert store.commit("4", spark.createDataFrame([("insert", 2, "t1", "a", "en", 8, 30)], CHANGES))
    assert totals(store)[("a", "en", "t1")] == (1, 8, 30)
    held = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in store.current().collect()}
    assert held == {(1, "t1"): 11, (1, "t2"): 20, (2, "t1"): 8}


def test_a_broken_off_commit_does_not_count(spark, store, monkeypatch):
    rows = spark.createDataFrame([("insert", 1, "t1", "a", "en", 10, 50)], CHANGES)
    real = tokencounts.Store._part
    monkeypatch.setattr(tokencounts.Store, "_part", lambda s, b, p: real(s, b, p) if p != "done" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.commit("1", rows)
    monkeypatch.undo()
    assert totals(store) == {}
    assert store.commit("1", rows)
    assert totals(store) == {("a", "en", "t1"): (1, 10, 50)}


def test_latest_change_of_a_batch_holds(spark, store):
    rows = [("insert", 1, "t", "a", "en", 5, 5, 1), ("delete", 1, "t", None, None, None, None, 2), ("insert", 1, "t", "a", "en", 6, 6, 3)]
    store.commit("1", spark.createDataFrame(rows, CHANGES + ", seq long"))
    assert totals(store) == {("a", "en", "t"): (1, 6, 6)}
    assert store.commit("2", spark.createDataFrame([], CHANGES))
    assert totals(store) == {("a", "en", "t"): (1, 6, 6)}


def test_unknown_changes_are_refused(spark, store):
    with pytest.raises(Exception, match="unknown op"):
        store.commit("1", spark.createDataFrame([("upsert", 1, "t", "a", "en", 5, 5)], CHANGES))


def test_odd_rows(spark, odd, no_docs, store):
    assert store.commit("1", tokencounts.counted(odd, "insert"))
    documents = sum(v[0] for k, v in totals(store).items() if k[2] == "words-1")
    assert documents == len({r[0] for r in ODD})
    assert store.commit("2", tokencounts.counted(no_docs, "insert"))
    assert sum(v[0] for k, v in totals(store).items() if k[2] == "words-1") == documents
