from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from salesops.llm import periodic
from salesops.llm.queries import queries


def plain_runs(words: list) -> list[tuple]:
    """Every period, every stretch of words that are as many words apart alike."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    values, best = np.array([numbers[w] for w in words], dtype=np.int64), {}
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate([[0], (values[q:] == values[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start + q >= max(6, 4 * q):
                best.setdefault((start, end + q), q)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id: int, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (doc_id, len(runs), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_every_period_tried(spark, small, texts):
    found = {tuple(r[c] for c in COLUMNS) for r in queries()["op12_periodic"](spark, small).collect()}
    assert found == {plain_row(i, t) for i, t in texts.items()}
    assert sum(r[1] > 0 for r in found) > 5


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words, kinds = [], rng.choice([1, 2, 3, 5, 50])
            while len(words) < rng.choice([0, 3, 30, 200]):
                words += [b"w%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 2, 4, 5, 9])
                if rng.random() < 0.3:
                    words = words[: -rng.randint(1, 2)]
            texts.append(words)
        assert periodic.runs_of(texts) == [plain_runs(t) for t in texts]


def test_lengths_that_count():
    """Six words of period 1, four times any other period, and not a word less."""
    for text, runs in (
        ("a a a a a", []), ("a a a a a a", [(0, 6, 1)]), ("a b a b a b a", []), ("a b a b a b a b", [(0, 8, 2)]),
        ("x a b a b a b a b a y", [(1, 9, 2)]), ("a b c " * 4, [(0, 12, 3)]), ("a b c " * 3 + "a b", []),
        ("a a b " * 4 + "b b b b b", [(0, 12, 3), (11, 6, 1)]),
    ):
        assert periodic.runs_of([text.encode().split()])[0] == runs, text


def test_long_repetitive_texts_stay_fast():
    rng = random.Random(3)
    blocks = ([b"p%d" % i for i in range(30)] * 6 + [b"x"]) * 300
    for words in ([b"a"] * 100_000, [b"w%d" % (i % 999) for i in range(100_000)], [b"w%d" % rng.randrange(2) for _ in range(60_000)], blocks):
        runs = periodic.runs_of([words])[0]
        assert all(length >= max(6, 4 * q) for _, length, q in runs) and runs


def test_texts_of_a_batch_do_not_meet():
    line = b"the same line in every text".split()
    assert periodic.runs_of([line] * 50) == [[]] * 50


def test_collapsed_text_and_general_result(spark):
    docs = spark.createDataFrame([(1, "so\tred red red red red red it is"), (2, "a b a b a b a b a c")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.find(docs).collect()}
    assert rows[1]["text"] == "so red it is" and rows[2]["text"] == "a b c"
    assert [tuple(r) for r in rows[2]["runs"]] == [(0, 9, 2)]


def test_odd_rows(spark, odd, no_docs):
    rows = periodic.digest(periodic.find(odd)).collect()
    assert len(rows) == odd.count()
    for row in rows:
        assert row["runs_sha256"] and row["collapsed_sha256"]
    long = next(r for r in rows if r["doc_id"] == 5)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 80_000, 4)
    assert periodic.digest(periodic.find(no_docs)).count() == 0
