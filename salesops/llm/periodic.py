"""Runs of words that repeat with a period, and the texts without the repetitions.

A run is a stretch of words of smallest period q, at least ``EXPONENT`` times q and ``SHORTEST`` words
long, that no neighbouring word extends. Two places of a text are a maximal pair when the words behind
them agree up to some length and the words before them, and after that length, differ. A run of period q
starts with such a pair at distance q, and a maximal pair that agrees for long enough against its
distance is a run with a multiple of the smallest period: so the pairs are the runs, after keeping the
smallest distance for every stretch.

The pairs come from the suffixes of a text in order and the lengths on which neighbours agree: the tree of
intervals of common length is walked from below, every interval holding its places as sorted lists by the
word before them. Where two intervals join, the places of the smaller look for places within a third of
the common length in the lists of other words of the larger. Texts without a chance of a run, and
suffixes without a neighbour near enough, are left out before that. A task holds ``AT_ONCE`` words, or one
text, at a time, and rows are looked at one by one.

Defined results: a null text is empty and has no runs; white space is as in ``common.WORD`` and comes out
as one space. Repeated rows and null ids stay rows of their own. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least length of a run against its period, and its least length in words.
EXPONENT, SHORTEST = 4, 6
# Words of a pair at distance 1 that agree in the shortest run; all other pairs agree on more.
LEAST = SHORTEST - 1
# Words taken together; a longer text is taken alone.
AT_ONCE = 200_000

_MIX = np.random.default_rng(12).integers(0, 2**64, size=LEAST + 1, dtype=np.uint64) | np.uint64(1)


class _Ids(dict):
    """A number for every word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def may_run(words: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a text can hold a run: a stretch of places whose next like place is near against its length.

    ``words`` holds the texts one after the other, each closed by a word of its own. A run gives as many
    places in a row, up to the last few words of it, whose ``LEAST`` words come again within its period.
    Places are compared by a hash; a collision only keeps a text that has no run.
    """
    mixed = words.astype(np.uint64) * _MIX[-1]
    mixed ^= mixed >> np.uint64(29)
    n = len(words) - LEAST + 1
    hashes = doc[:n].astype(np.uint64) * _MIX[0]
    for i in range(LEAST):
        hashes += mixed[i : i + n] * _MIX[i]
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[1:]] == hashes[order[:-1]]
    gap = np.full(n + 1, 0, dtype=np.int64)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    inside = gap > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    out = np.zeros(len(sizes), dtype=bool)
    if len(starts):
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        gap[~inside] = np.iinfo(np.int64).max
        nearest = np.minimum.reduceat(gap, starts)
        # The pair agrees on up to this many words; a stretch may join that of the next text, which keeps more.
        common = ends - starts + LEAST - 1
        for start, end in zip(starts[nearest * (EXPONENT - 1) <= common], ends[nearest * (EXPONENT - 1) <= common]):
            out[doc[start] : doc[end - 1] + 1] = True
    return out


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and on how many words each agrees with the one before it.

    By doubling: places of like rank are told apart by the rank of the place behind the words compared so
    far. The last word of every text must occur once.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [], 1
    while not new.all():
        levels.append(rank.astype(np.int32))
        open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        places = order[open_]
        key = rank[places] * n + rank[places + length]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[open_] = places
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_] = first
        rank[places] = np.maximum.accumulate(np.where(first, open_, 0))
        length *= 2
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][a] == levels[level][b]
        step = same.astype(np.int64) << level
        common[1:] += step
        a += step
        b += step
    return order, common


class _Places:
    """Places of an interval: all of them, and by the word before them; sorted lists of growing lengths."""

    __slots__ = ("size", "every", "by_left")

    def __init__(self, place: int, left: int):
        self.size, self.every, self.by_left = 1, [[place]], {left: [[place]]}

    def absorb(self, other: _Places) -> None:
        self.size += other.size
        _absorb(self.every, other.every)
        for left, lists in other.by_left.items():
            mine = self.by_left.get(left)
            if mine is None:
                self.by_left[left] = lists
            else:
                _absorb(mine, lists)


def _absorb(lists: list, others: list) -> None:
    """Keeps few lists: each at least twice as long as the next."""
    lists += others
    lists.sort(key=len, reverse=True)
    while len(lists) > 1 and len(lists[-2]) < 2 * len(lists[-1]):
        last = lists.pop()
        # Two sorted lists: merged in one pass.
        lists[-1] = sorted(lists[-1] + last)


def _near(lists: list, low: int, high: int) -> Iterator[int]:
    for places in lists:
        at = bisect_left(places, low)
        while at < len(places) and places[at] <= high:
            yield places[at]
            at += 1


def maximal_pairs(places: list[int], common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, j, length) with i < j: maximal pairs whose length is at least EXPONENT - 1 times their distance.

    ``places`` are suffixes in order, ``common`` how far each agrees with the one before it, ``left`` the words
    before them.
    """
    found: list[tuple[int, int, int]] = []

    def joined(a: _Places, b: _Places, length: int) -> _Places:
        if a.size < b.size:
            a, b = b, a
        reach = length // (EXPONENT - 1)
        for word, lists in b.by_left.items():
            for x in chain.from_iterable(lists):
                if next(_near(a.every, x - reach, x + reach), None) is None:
                    continue
                for other, candidates in a.by_left.items():
                    if other != word:
                        found.extend((min(x, y), max(x, y), length) for y in _near(candidates, x - reach, x + reach))
        a.absorb(b)
        return a

    stack: list = []
    node = _Places(places[0], left[0])
    for i in range(1, len(places) + 1):
        length = common[i] if i < len(places) else 0
        while stack and stack[-1][0] > length:
            deeper, parent = stack.pop()
            node = joined(parent, node, deeper)
        if stack and stack[-1][0] == length:
            stack[-1][1] = joined(stack[-1][1], node, length)
        else:
            stack.append([length, node])
        if i < len(places):
            node = _Places(places[i], left[i])
    return iter(found)


def _stretches(order: np.ndarray, common: np.ndarray) -> Iterator[slice]:
    """Neighbours in the order of suffixes that agree on ``LEAST`` words and hold two places near enough."""
    linked = common >= LEAST
    starts = np.flatnonzero(linked & ~np.concatenate([[False], linked[:-1]])) - 1
    if not len(starts):
        return
    ends = np.flatnonzero(linked & ~np.concatenate([linked[1:], [False]])) + 1
    member = np.repeat(np.arange(len(starts)), ends - starts)
    index = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
    by = np.lexsort((order[index], member))
    placed, of = order[index][by], member[by]
    gap = np.where(np.diff(of, prepend=-1) == 0, np.diff(placed, prepend=0), np.iinfo(np.int64).max)
    nearest = np.minimum.reduceat(gap, np.flatnonzero(np.diff(of, prepend=-1)))
    deepest = np.array([common[s + 1 : e].max() for s, e in zip(starts, ends)])
    for s, e in zip(starts[nearest * (EXPONENT - 1) <= deepest], ends[nearest * (EXPONENT - 1) <= deepest]):
        yield slice(int(s), int(e))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For every text, given as its words, the runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids = _Ids()
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    numbers = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()) - len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    last = np.cumsum(sizes) - 1
    words = np.empty(len(doc), dtype=np.int64)
    closing = np.zeros(len(doc), dtype=bool)
    closing[last] = True
    words[~closing], words[closing] = numbers, len(ids)
    if len(words) < LEAST + 1:
        return out
    # A word counts for its text only.
    words += doc * (len(ids) + 1)
    keep = may_run(words, doc, sizes)[doc]
    if not keep.any():
        return out
    words, doc = words[keep], doc[keep]
    begins = np.zeros(len(texts), dtype=np.int64)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    begins[doc[first]] = np.flatnonzero(first)
    before = np.concatenate([[-1], words[:-1]])
    order, common = suffixes(words)
    best: dict[tuple[int, int], int] = {}
    for part in _stretches(order, common):
        places = order[part]
        for i, j, length in maximal_pairs(places.tolist(), common[part].tolist(), before[places].tolist()):
            period = j - i
            if length + period >= SHORTEST:
                key = (i, j + length)
                best[key] = min(period, best.get(key, period))
    for (start, end), period in best.items():
        of = int(doc[start])
        out[of].append((start - int(begins[of]), end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds behind its first period."""
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > at:
            kept += words[at:start]
            at = max(at, end)
    return kept + words[at:]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list, texts: list) -> pa.RecordBatch:
        runs = runs_of(texts)
        plain = [b" ".join(collapsed(t, r) if r else t).decode() for t, r in zip(texts, runs)]
        found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        columns = [pa.array(ids, pa.int64()), pa.array(found, _RUNS), pa.array(plain, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "text"])

    for batch in batches:
        ids, texts, total = [], [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            words = (text.as_py() or "").encode().split()
            if texts and total + len(words) > AT_ONCE:
                yield done(ids, texts)
                ids, texts, total = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(words)
            total += len(words)
        if texts:
            yield done(ids, texts)


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, runs, text): the runs by start, then period, and the text without the repetitions."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``find``: the longest run (ties: first, then smallest period) and hashes of all."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    rows = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
