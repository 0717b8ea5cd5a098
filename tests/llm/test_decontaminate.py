from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesops.llm import decontaminate
from salesops.llm.queries import benchmark_leaks
from tests.llm.conftest import ODD


def plain_distance(pattern: str, text: str) -> int:
    """Smallest edit distance to any stretch of the text, by the table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(last[i] + (p != c), last[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_myers_is_the_table(pattern, text):
    distance, end = decontaminate.myers(pattern, text)
    assert distance == plain_distance(pattern, text)
    assert plain_distance(pattern, text[:end]) == distance


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=200), st.floats(0, 0.3))
def test_pieces(item, rate):
    cut = decontaminate.pieces(item, rate)
    assert "".join(p for _, p in cut) == item and len(cut) == int(len(item) * rate) + 1
    assert all(p and item.startswith(p, at) for at, p in cut)


def edited(rng: random.Random, item: str, edits: int) -> str:
    letters = list(item)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("xyz")
        elif kind == 1:
            letters.insert(at, rng.choice("xyz"))
        else:
            del letters[at]
    return "".join(letters)


def test_edited_items_are_found_and_others_not():
    rng = random.Random(5)
    words = ["stone", "river", "cloud", "amber", "table", "quiet", "green", "lamp", "of", "the", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [decontaminate.normal(text(25)) for _ in range(20)]
    matcher = decontaminate.Matcher(items, 0.08)
    for number, item in enumerate(items):
        k = int(len(item) * 0.08)
        for edits in (0, 1, k, k + 6, 3 * k):
            leak = decontaminate.normal(edited(rng, item, edits))
            doc = f"{text(30)} {leak} {text(30)}"
            found = {h.item: h for h in matcher.find(doc)}
            distance = plain_distance(item, doc)
            assert (number in found) == (distance <= k)
            if number in found:
                hit = found[number]
                assert hit.distance == distance
                assert plain_distance(item, doc[hit.start : hit.end]) == distance
        assert {h.item for h in matcher.find(text(200))} == set()


def test_whole_table(spark, small, texts):
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in benchmark_leaks(spark, small).collect()}
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if item in decontaminate.normal(t)}
    assert exact and exact <= set(found)
    for (d, i), r in found.items():
        stretch = decontaminate.normal(texts[d])[r["start"] : r["end"]]
        assert plain_distance(items[i], stretch) == r["distance"] <= len(items[i]) * decontaminate.RATE
        assert (r["distance"] == 0) == ((d, i) in exact)


def test_blocks_of_items_give_the_same(spark, documents, small, monkeypatch):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(decontaminate.matches(documents, benchmark).collect())
    clean = sorted(r["doc_id"] for r in decontaminate.without_benchmark(documents, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1500)
    assert sorted(decontaminate.matches(documents, benchmark).collect()) == whole
    cleaned = decontaminate.without_benchmark(documents, benchmark)
    assert sorted(r["doc_id"] for r in cleaned.collect()) == clean
    assert set(clean) == {r["doc_id"] for r in documents.collect()} - {r["doc_id"] for r in whole}


def test_odd_rows(spark, odd, no_docs):
    item = "a plain TEXT  of a few words here"
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, "no id at all but some words"), (4, "never there at all")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    found = [tuple(r)[:2] for r in decontaminate.matches(odd, benchmark).collect()]
    assert sorted(found, key=repr) == sorted([(1, 1)] * 4 + [(None, None)], key=repr)
    clean = decontaminate.without_benchmark(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 3
    nothing = benchmark.filter("item_id > 50")
    assert decontaminate.matches(odd, nothing).count() == 0
    assert decontaminate.without_benchmark(odd, nothing).count() == len(ODD)
    assert decontaminate.matches(no_docs, benchmark).count() == 0
