from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from salesops.llm import simhash
from salesops.llm.components import components
from salesops.llm.queries import near_duplicates
from tests.llm.conftest import ODD


def plain_print(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict, radius: int) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one TWO", "a b c d", "É é\x0b\x1cx y z", "a a a a " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_text_in_portions(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def test_whole_table(spark, small, texts):
    rows = near_duplicates(spark, small).collect()
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_groups(prints, 2)


@pytest.mark.parametrize("radius", [2, 4])
def test_links_lose_nothing(spark, radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(base)
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(0, radius + 1)))
    numbered = dict(enumerate(prints))
    signed = {p: int(np.uint64(p % 2**64).astype(np.int64)) for p in prints}
    frame = spark.createDataFrame([(s,) for s in set(signed.values())], "fp long")
    links = simhash.links(frame, radius)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in links.collect())
    root = {r["node"]: r["root"] for r in components(links).collect()}
    found: dict = {}
    for i, p in numbered.items():
        found.setdefault(root.get(signed[p], signed[p]), []).append(i)
    wanted: dict = {}
    for i, c in plain_groups({i: p % 2**64 for i, p in numbered.items()}, radius).items():
        wanted.setdefault(c, []).append(i)
    assert sorted(found.values()) == sorted(wanted.values())


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 999) for i in range(1, 200)] + [(5000, 5000), (7, 8), (8, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0}
    assert {found[i] for i in range(999, 1200) if i != 1000} == {999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(400))
    docs = [(5, base, "x"), (3, base, "y"), (9, base + " end", "z"), (11, "other text altogether", "z"), (11, "other text altogether", "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, fp string")
    found = simhash.one_of_each(frame)
    assert found.columns == frame.columns
    kept = [r["doc_id"] for r in found.collect()]
    assert 3 in kept and 5 not in kept and kept.count(11) == 1


def test_odd_rows(spark, odd, no_docs):
    rows = simhash.groups(odd).collect()
    assert len(rows) == len(ODD)
    blank = {r["component_id"] for r in rows if r["fp"] == 0}
    assert blank == {2}
    out = simhash.one_of_each(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(1) == 1 and 3 not in kept and 4 not in kept and 2 in kept
    assert simhash.groups(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
