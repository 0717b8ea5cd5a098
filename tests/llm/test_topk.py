from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from salesops.llm import topk
from salesops.llm.oracle import oracle_sql
from salesops.llm.queries import exact_top_k


def plain(rows: list[tuple], k: int) -> list[tuple]:
    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(Fraction(x) * 256) for x in v]))
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)]
        best = enumerate(sorted(scored)[:k])
        out += [(q, r + 1, i, -s if -(2**63) <= -s < 2**63 else None) for r, (s, i) in best]
    return sorted(out, key=str)


def found(spark, rows: list[tuple], k: int, kind: str = "float") -> list[tuple]:
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, k).collect()), key=str)


def test_matches_sql(spark, small):
    assert differences(exact_top_k(spark, small), connect(small), oracle_sql()["op8_topk"]) == []


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed"])
def test_matches_comparing_all(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", (60, 60))
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 40)) * (np.linspace(2, 0.01, 40) if kind == "skewed" else 0.3)
    if kind == "ties":
        x = rng.integers(-1, 2, size=(400, 40)) * 0.25
        x[100:250] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    assert found(spark, rows, 5) == plain(rows, 5)


def test_bounds_throw_candidates_out():
    rng = np.random.default_rng(1)
    c = (rng.normal(size=(3000, 64)) * np.linspace(300, 1, 64)).astype(np.int64)
    for number, at, scores in topk.search_cell(c[:5], np.arange(5), c, np.arange(3000), 5):
        exact = c @ c[number]
        exact[number] = -(2**62)
        assert at.tolist() == np.argsort(-exact, kind="stable")[:5].tolist()
        assert scores.tolist() == exact[at].tolist()


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v), (0, v), (50, [1.0, 1.0, 1.0]), (50, [-1.0, 0.0, 0.0]), (3, v), (4, None), (5, []), (6, [1.0, None, 2.0]),
        (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 0.0, 0.0]), (None, v), (100, [1.0, 2.0]), (9, v), (9, v), (150, [0.0] * 5),
    ]
    assert found(spark, rows, 4) == plain(rows, 4)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, v string, dims string, query_no string")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_wide_vectors_take_part(spark):
    rows = [(0, [0.5, 1.0]), (50, [1e6, -3.0]), (1, [70000.0, 0.25]), (2, [65536.0, 65536.5]), (3, [-1e6, 1e6])]
    assert found(spark, rows, 4, "double") == plain(rows, 4)


def test_components_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", (20, 20))
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    sizes = np.array([1.0, 1e4, 1e6, 1e6, 1e12, 1e30, 1e300])[rng.integers(0, 7, size=(150, 1))]
    x = rng.normal(size=(150, 6)) * sizes
    x[20:30], x[60] = x[10], [1.7e308, -1.7e308, 5e-324, 0.0, 1e306, -0.3]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(50, [1e300, 1.0, -1e-300, 2.0, 7e305, 0.0]), (77, [2.0**60, 3.5, -(2.0**59), 0.0, 0.0, 0.1])]
    assert found(spark, rows, 7, "double") == plain(rows, 7)


def test_only_wide_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(120, 20)) * 1e7).tolist())]
    assert found(spark, rows, 5, "double") == plain(rows, 5)
