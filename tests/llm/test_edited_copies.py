"""Edited copies: word shingles of five at similarity 0.8, as the pipeline takes them."""

from __future__ import annotations

import random

import corpus_pipeline

from salesops.llm import setsketch
from salesops.llm.common import written


def plain_shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng: random.Random, words: list[str], changes: int) -> str:
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(out)


def test_planted_edited_copies_go(spark, small):
    """Four changed words in 200 leave a similarity of 0.81 or more; 30 changed words leave far less."""
    rng = random.Random(4)
    docs, kept = [], set()
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        docs += [(10 * i, " ".join(words)), (10 * i + 1, edited(rng, words, 4)), (10 * i + 2, edited(rng, words, 30))]
        docs += [(10 * i + 3, " ".join(words).upper())]
        kept |= {10 * i, 10 * i + 2}
    frame = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    found = frame
    for _, stage in corpus_pipeline.STAGES[1:3]:
        found = written(stage(spark, found, small), "planted-stage")
    assert found.columns == frame.columns
    assert {r["doc_id"] for r in found.collect()} == kept


def test_groups_match_comparing_all(spark):
    """Chains of copies of copies at every similarity around the bound."""
    rng, texts = random.Random(5), {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for k in range(12):
            texts[100 * base + k] = " ".join(words)
            words = edited(rng, words, rng.randint(0, 2)).split()
    ids, sets = sorted(texts), {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in setsketch.one_of_each(frame).collect())
    assert kept == sorted({find(i) for i in ids}) and len(kept) < len(ids)
