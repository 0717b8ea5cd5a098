"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit for each of 64 places: 1 if the bit is set in over half of the
XXH64 hashes of its shingles. Two fingerprints link when at most ``radius`` bits differ. Every
distinct fingerprint is sent to all values within half the radius of it; two linked fingerprints
meet at a value half way. Of the fingerprints that meet, sorted, neighbours are compared, then the
verified links are put together to components. The radius is even, so that all that meet at one value
are within the radius of each other and a chain of neighbours loses no link.

Defined results: text is lower-cased in A-Z only and split at white space; fewer words than a shingle
give one shingle of them all; no words, or null, give fingerprint zero, which links like any other.
Repeated rows stay, each with its component. A component is named by its smallest doc_id; null ids
are never the smallest unless a component has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import written
from salesops.llm.components import components

SEED = 42
# Shingles hashed at a time, so that a very long text needs little memory.
AT_ONCE = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = (np.concatenate([[0], ends[:-1]])).tolist()
    stops = (ends - 1).tolist()
    n = max(len(tokens) - words + 1, 1)
    stops = stops[min(words, len(tokens)) - 1 :]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, AT_ONCE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + AT_ONCE], stops[i : i + AT_ONCE])][: n - i]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n).view(">u8")[0])


def _fingerprints(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], names=["doc_id", "fp"])

    return rows


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _masks(flips: int) -> list[int]:
    """All numbers of 64 bits with at most so many set, as signed longs."""
    masks = [sum(1 << i for i in bits) for k in range(flips + 1) for bits in combinations(range(64), k)]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints that join all within the radius of each other.

    Both sides of a pair of radius 2r meet where each flips r bits. The fingerprints that meet at one
    value are within 2r of each other, so a chain through them in order loses no link.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    near = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in _masks(radius // 2)])).alias("mask"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), "fp")
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    pairs = near.withColumn("a", before).filter("a IS NOT NULL").select("a", F.col("fp").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.distinct().filter(differing <= radius)


def groups(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per document."""
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = written(components(links(distinct.select("fp"), radius)), "components")
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(whole, "root").select("fp", "component_id"), "named-fingerprints")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def one_of_each(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """The documents without the near copies of others: of each group the smallest doc_id stays.

    Documents without an id cannot be told apart; they stay only where no other stands for them.
    Of rows that repeat the id that stays, one is kept.
    """
    member = groups(docs, radius, words)
    kept = member.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", _ID)
    same_id = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    stays = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(_ID)), "left_semi")
    return stays.withColumn(_ID, F.row_number().over(same_id)).filter(F.col(_ID) == 1).drop(_ID)


# A column name that no table has.
_ID = "__simhash_kept"
