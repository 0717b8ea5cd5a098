"""Benchmark decontamination by pigeonhole edit matching.

An item may appear in a text with up to k edits, a share of its length. Cut into k + 1 pieces, at least
one piece then stands in the text unchanged. All pieces of all items are looked up at once with an
Aho-Corasick automaton; around every hit, Myers' bit-parallel algorithm finds the smallest edit distance of
the item to any stretch of the text. Items are dealt to blocks of bounded size, one automaton each, so a
benchmark of any size fits; every block is one narrow pass over the documents.

Defined results: case and the amount of white space do not count, for texts and items; null and empty
items match nothing, null and empty texts hold nothing. Every (document row, item row) is reported once, with
its smallest distance; repeated rows are reported each. Very long texts are searched whole. Empty tables
give no rows. Other columns pass through ``without_benchmark`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import blocks_for

# Edits allowed for each character of an item.
RATE = 0.08
# Characters of the items that share an automaton.
BLOCK_CHARS = 1_000_000


class Hit(NamedTuple):
    item: int
    start: int
    end: int
    distance: int


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """The item cut into one piece more than its edits: (offset, piece)."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a stretch of the text, and where that first ends.

    The stretch may start anywhere, or at the start of the text if ``anchored``.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = equal.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | ~(diagonal | up) & mask
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | anchored) & mask
        left = (left << 1) & mask
        up = left | ~(diagonal | right) & mask
        down = right & diagonal
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[str], rate: float):
        self.items, self.rate = items, rate
        self.edits = [int(len(item) * rate) for item in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset, piece in pieces(item, rate) if item else []:
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.empty = not places
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[Hit]:
        """The best place of every item in a normal text, by item."""
        if self.empty:
            return []
        diagonals: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                diagonals.setdefault(number, []).append(last + 1 - length - offset)
        hits = []
        for number in sorted(diagonals):
            found = self._verify(number, diagonals[number], text)
            if found:
                hits.append(found)
        return hits

    def _verify(self, number: int, diagonals: list[int], text: str) -> Hit | None:
        """Places where the item would start are put together to windows of the text."""
        item, k = self.items[number], self.edits[number]
        best = None
        places = sorted(set(diagonals))
        i = 0
        while i < len(places):
            begin = max(0, places[i] - k)
            stop = places[i] + len(item) + k
            while i < len(places) and places[i] - k <= stop:
                stop = places[i] + len(item) + k
                i += 1
            distance, end = myers(item, text[begin:stop])
            if distance <= k and (best is None or distance < best.distance):
                backward = text[max(begin, begin + end - len(item) - k) : begin + end][::-1]
                _, length = myers(item[::-1], backward, anchored=True)
                best = Hit(number, begin + end - length, begin + end, distance)
        return best


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (id, normal text), in blocks of about BLOCK_CHARS characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = blocks_for(chars, BLOCK_CHARS)
    for block in range(n):
        here = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block
        yield [(row["item_id"], normal(row["text"])) for row in rows.filter(here).orderBy("item_id", "text").collect()]


_WORKER: dict[str, Matcher] = {}


def _matcher(shared: Broadcast, key: str, rate: float) -> Matcher:
    """One automaton for each block and worker."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Matcher([text for _, text in shared.value], rate)
    return _WORKER[key]


def _report(shared: Broadcast, key: str, rate: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, ids = _matcher(shared, key, rate), [number for number, _ in shared.value]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for hit in matcher.find(normal(text.as_py())):
                    out.append((doc_id, ids[hit.item], hit.start, hit.end, hit.distance))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "distance"]
            )

    return rows


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance): places in the normal texts."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _item_blocks(benchmark):
        part = rows.mapInArrow(
            _report(context.broadcast(items), uuid4().hex, rate), "doc_id long, item_id long, start long, end long, distance long"
        )
        found = part if found is None else found.unionByName(part)
    return found


def _clean(shared: Broadcast, key: str, rate: float, column: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, rate)
        for batch in batches:
            stays = [not matcher.find(normal(text.as_py())) for text in batch.column(column)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return rows


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all of their columns."""
    context = docs.sparkSession.sparkContext
    column = docs.columns.index("text")
    for items in _item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(context.broadcast(items), uuid4().hex, rate, column), docs.schema)
    return docs
