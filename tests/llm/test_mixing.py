from __future__ import annotations

import numpy as np
import pytest

from salesops.llm import mixing
from salesops.llm.queries import mixing_sources
from tests.llm.conftest import ODD


def plain_targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Hand out by weight, cap, hand out again what is over."""
    target, rest = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    while rest > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            target[i] += rest * weights[i] / total
        rest = sum(max(0.0, target[i] - most * sizes[i]) for i in open_)
        target = [min(t, most * s) for t, s in zip(target, sizes)]
        open_ = [i for i in open_ if target[i] < most * sizes[i] - 1e-9]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_handing_out_by_turns(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(s) for s in rng.lognormal(4, 1.5, 9)] + [0]
    names = [f"s{i}" for i in range(9)] + [None]
    frame = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(frame, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(10)]
    for name, wanted in zip(names, plain_targets(sizes, weights, 1.5, 2.0)):
        assert found[name] == pytest.approx(wanted, rel=1e-9, abs=1e-6)


def test_flight_keeps_number_and_words():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 400)
    p = np.full(400, 0.37)
    done = mixing.fly(size, p, rng)
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert done.sum() == pytest.approx(p.sum(), abs=1e-6)
    assert (done * size).sum() == pytest.approx((p * size).sum(), rel=1e-6)


def test_flight_keeps_expectation():
    size = np.array([5, 9, 14, 3, 8, 30])
    p = np.array([0.2, 0.7, 0.5, 0.4, 0.6, 0.3])
    runs = np.mean([mixing.land(size, p, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(runs - p).max() < 0.04


def test_landing_makes_up_for_heavy_documents():
    rng = np.random.default_rng(3)
    size = np.concatenate([[20_000, 9_000], rng.integers(10, 300, 500)])
    p = np.full(502, 0.4)
    done = mixing.land(size, p, rng)
    assert set(done) <= {0.0, 1.0}
    assert abs((done * size).sum() - (p * size).sum()) < 300


def test_mix_comes_near_its_targets(spark, small):
    rows = mixing_sources(spark, small).collect()
    again = mixing_sources(spark, small).collect()
    assert sorted(rows) == sorted(again)
    assert len(rows) == 200
    by_source: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source"], r["target"], r["source_size"]), []).append(r)
    for (_, target, source_size), members in by_source.items():
        assert sum(m["size"] for m in members) == source_size
        assert abs(sum(m["taken"] for m in members) - target) <= max(m["size"] for m in members)


def test_many_blocks_stay_balanced(spark):
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(n), "a" if i % 3 else "b") for i, n in enumerate(rng.lognormal(3, 1, 9000))]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(mixed) == 9000
    for name in "ab":
        members = [r for r in mixed if r["source"] == name]
        taken = sum(r["copies"] * r["size"] for r in members)
        assert taken == pytest.approx(members[0]["target"], rel=2e-3)
        share = members[0]["target"] / members[0]["source_size"]
        assert sum(r["copies"] for r in members) == pytest.approx(share * len(members), rel=1e-2)


def test_odd_rows(spark, odd, no_docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["source"] for r in rows} == {"web", "books", "", None}
    assert all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(no_docs).count() == 0
