from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesops.llm import setsketch
from salesops.llm.queries import queries
from tests.llm.conftest import ODD


def plain_set(text: str | None, width: int = 2) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_groups(texts: dict, width: int = 2) -> dict:
    """All pairs of documents."""
    sets = {i: plain_set(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            if len(sets[b]) * 80 > len(sets[a]) * 100:
                break
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def edited(rng: random.Random, words: list[str], changes: int) -> list[str]:
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"changed{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("width", [1, 2, 5])
@pytest.mark.parametrize("text", [None, "", "One", "a B", "b a a b a", "a b c d e f a b c d e f"])
def test_shingles(text, width):
    assert len(setsketch.shingles(text, width)) == len(plain_set(text, width))


def test_order_of_words_counts():
    assert not np.intersect1d(setsketch.shingles("a b"), setsketch.shingles("b a")).size


@pytest.mark.parametrize("n", [1, 30, 3000])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_joint_estimate_and_merge(n, share):
    """The estimate is near the exact similarity, and the sketch of a union is the union of sketches."""
    rng = np.random.default_rng(int(n * 100 * share))
    values = np.unique(rng.integers(0, 2**64, size=2 * n + 2, dtype=np.uint64))
    both = int(round(2 * n * share / (1 + share)))
    a, b = values[:n], np.concatenate([values[:both], values[n : 2 * n - both]])
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = setsketch.registers(a), setsketch.registers(b)
    best, nats = setsketch.estimated(x[None], y[None], np.array([len(a)]), np.array([len(b)]), at=exact)
    assert abs(best[0] - exact) < 0.15 and nats[0] < 8
    assert (setsketch.merged(x, y) == setsketch.registers(np.union1d(a, b))).all()


@pytest.mark.parametrize("n", [1, 40, 900, 20_000])
def test_parities_give_up_no_pair_at_the_bound(n):
    rng = np.random.default_rng(n)
    for both in (n, -(-8 * n // 9), -(-8 * n // 9) - 1, 2 * n // 3):
        values = rng.permutation(np.unique(rng.integers(0, 2**64, size=2 * n + 9, dtype=np.uint64)))[: 2 * n - both]
        a, b = values[:n], np.concatenate([values[:both], values[n:]])
        rows = [setsketch.parities(np.sort(x))[None] for x in (a, b)]
        kept = setsketch.may_reach(*rows, np.array([n]), np.array([n]), 80)[0]
        assert kept or 100 * both < 80 * (2 * n - both)
        if n == 900 and both == 600:
            assert not kept


def test_query_matches_all_pairs(spark, small, texts):
    assert found(queries()["op13_setsketch"](spark, small)) == plain_groups(texts)


def test_chains_around_the_bound(spark):
    rng, texts = random.Random(13), {}
    for base in range(10):
        words = [f"w{rng.randrange(2000)}" for _ in range(60)]
        for k in range(14):
            texts[100 * base + k] = " ".join(words)
            words = edited(rng, words, rng.randint(0, 4))
    # Many sets of one origin that are near it and, mostly, not near each other.
    origin = [f"o{i}" for i in range(200)]
    for k in range(60):
        texts[5000 + k] = " ".join(edited(rng, origin, 16))
    texts[5900] = " ".join(origin)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    expected = plain_groups(texts)
    assert found(setsketch.groups(frame)) == expected
    assert len({r for _, r, _ in expected.values()}) < len(texts)


def test_buckets_without_links_are_worked_off(spark):
    """Sets that share two thirds of their shingles meet in buckets but never link."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(160)]
    texts = {k: " ".join(common + [f"x{k}y{rng.randrange(10**6)}" for _ in range(44)]) for k in range(80)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(setsketch.groups(frame)) == plain_groups(texts)


@pytest.mark.parametrize("middles_grow", [1, 3])
def test_large_buckets_in_blocks(spark, monkeypatch, middles_grow):
    """Blocks of three: near sets, linked ones among them, dealt out over many cells and rounds."""
    monkeypatch.setattr(setsketch, "BLOCK", 3)
    monkeypatch.setattr(setsketch, "GROWTH", 1 + middles_grow)
    rng, texts = random.Random(11), {}
    origin = [f"o{i}" for i in range(150)]
    for k in range(24):
        texts[k] = " ".join(edited(rng, origin, 13))
    for k in range(6):
        texts[100 + k] = " ".join(edited(rng, texts[k].split(), 2))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = plain_groups(texts)
    assert found(setsketch.groups(frame)) == expected
    assert len({r for _, r, _ in expected.values()}) > 10


def test_cells_hold_every_pair_once(monkeypatch):
    """Blocks 0 to 3 of a bucket against the middle blocks 0 and 1, and a bucket of one block; a few pairs at a time."""
    monkeypatch.setattr(setsketch, "PAIRS", 5)
    rows = []
    for i in range(2):
        for j in range(i, 4):
            rows += [(7, i, j, b, 10 * b + k) for b in {i, j} for k in range(4)]
    rows += [(9, 0, 0, 0, 90 + k) for k in range(6)]
    table = pa.table(dict(zip(("key", "i", "j", "block", "node"), map(list, zip(*rows)))))
    node = table.column("node").to_numpy()
    pairs = [tuple(sorted(p)) for left, right in setsketch._pairs_of_cells(table) for p in zip(node[left], node[right])]
    members = [10 * b + k for b in range(4) for k in range(4)]
    wanted = [(x, y) for x in members for y in members if x < y and x < 20]
    wanted += [(x, y) for x in range(90, 96) for y in range(x + 1, 96)]
    assert sorted(pairs) == sorted(wanted)


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_cells_over_batches(at_once):
    """A cell that goes on in the next batches is compared as one."""
    rng = random.Random(3)
    base = {k: [f"b{k}w{rng.randrange(10**6)}" for _ in range(80)] for k in range(3)}
    sets = [setsketch.shingles(" ".join(edited(rng, base[k % 3], 1))) for k in range(9)]
    rows = [
        {"key": k % 3, "i": 0, "j": 0, "block": 0, "node": k, "n": len(s), "root": k,
         "registers": setsketch.registers(s).astype(">u2").tobytes(), "odd": setsketch.parities(s).tobytes()}
        for k, s in sorted(enumerate(sets), key=lambda e: e[0] % 3)
    ]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=at_once)
    pairs = sorted((a, b) for out in setsketch._cells(80)(iter(batches)) for a, b in zip(*[c.to_pylist() for c in out.columns]))
    assert pairs == [(a, b) for a in range(9) for b in range(a + 1, 9) if a % 3 == b % 3]


def test_one_of_each(spark, odd, no_docs):
    out = setsketch.one_of_each(odd)
    assert out.columns == odd.columns
    # Two texts of the id 1, all without words, and the text without an id; repeated rows once.
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6] and len(ODD) == 10
    assert setsketch.one_of_each(no_docs).count() == 0
    mapped = odd.withColumn("extra", F.create_map(F.lit("k"), F.col("lang")))
    assert setsketch.one_of_each(mapped).count() == out.count()


def test_odd_rows(spark, odd, no_docs):
    rows = setsketch.groups(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 1} == {(1, True)}
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if not r["n_shingles"] and r["doc_id"] is not None)
    assert setsketch.groups(no_docs).count() == 0
