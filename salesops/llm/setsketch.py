"""Near duplicates by SetSketch registers: bands of registers, joint estimates, exact verification.

The sketch of a set holds ``REGISTERS`` numbers. A number is the least of exponentially distributed values,
one per element, cut down to whole steps of a logarithm of base ``BASE``: the scale is exponential, and
finer or coarser than MinHash needs in one place. The sketch of a union is the greater number in every
place, and two sets agree in a place about as often as their similarity says.

Distinct shingle sets meet where a band of ``ROWS`` registers agrees. At similarity 0.8 a pair shares none of
``BANDS`` bands with a probability of at most (1 - 0.8**5)**40, one in eight million. In a bucket all sets are
compared with the smallest first, which then leaves it: a group of near copies is mostly linked by few stars. A bucket
whose sets are not all connected then is dealt into blocks of some ``BLOCK`` sets, by a hash, and the blocks are put
together in cells that tasks compare row by row of numbers, so that only likely pairs leave a task; one block of a
bucket is compared with all blocks first, then ``GROWTH`` more, and so on in rounds. Sets that were compared leave the
bucket, and a bucket is done when all that are left are connected: no pair of a bucket is left out unless it is
connected already.
A pair is judged by its registers first: likelihood of how often one is greater, given both sizes. Pairs
whose best similarity is below the wanted one, and ``DOUBT`` nats more likely, are given up; an honest pair is
lost so with a probability below exp(-DOUBT). The verification of the others begins with ``PARITIES`` bits per set, whether
an odd number of its hashes falls into a place: two sets differ in at least as many elements as bits, and a pair that
differs in too many cannot reach the similarity. What is left is held against the sets themselves.

Defined results: text is lower-cased in A-Z only and split at white space; fewer words than a shingle
give one shingle of them all; without words, or null, the set is empty and linked with nothing. Sets are held
as 64-bit hashes of shingles, told apart by 128 bits. Repeated rows stay. A component is named by its smallest
doc_id; a null id only where it has no other. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import written
from salesops.llm.components import components

SEED = 42
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
# Base of the logarithm of a register, rate of the values, and the greatest register.
BASE, RATE, GREATEST = 1.02, 20.0, 2**16 - 1
DOUBT = 20.0
PARITIES = 2_048
# Sets of a bucket that are dealt out together, and how many times more of these blocks are compared with all from round to round.
BLOCK, GROWTH = 4_096, 16
# Pairs of a cell that are held at a time.
PAIRS = 32_768
# Shingles sketched or returned at a time, and words whose hashes a task remembers.
AT_ONCE, BATCH, REMEMBERED = 1_024, 500_000, 500_000

_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, size=(3, max(REGISTERS, 64)), dtype=np.uint64)
_FACTORS, _MASKS, _PLACES = _DRAWN[0, :REGISTERS] | np.uint64(1), _DRAWN[1, :REGISTERS], _DRAWN[2] | np.uint64(1)


class _Hashes(dict):
    """Hashes of words, for as long as they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingles(text: str | None, words: int = 2, known: _Hashes | None = None) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    known = _Hashes() if known is None else known
    each = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        mixed += each[i : i + n] * _PLACES[i % len(_PLACES)]
        # Without this a sum of products would let words change places.
        mixed ^= mixed >> np.uint64(32)
        mixed *= _PLACES[-1]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; zeros for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, dtype=np.uint16)
    least = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), AT_ONCE):
        some = hashes[i : i + AT_ONCE, None] ^ _MASKS
        some *= _FACTORS
        np.minimum(least, some.min(axis=0), out=least)
    values = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(values) / np.log(BASE)), 0, GREATEST).astype(np.uint16)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, packed: whether an odd number of the distinct hashes falls into a place."""
    places = (hashes >> np.uint64(20)) % np.uint64(PARITIES)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8))


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these parities, as rows of packed bits, and sizes can have the similarity; never False if they have."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _log_likelihood(j, u, v, more, less, same) -> np.ndarray:
    def greater(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    tiny = 1e-12
    p, q = greater(u - v * j), greater(v - u * j)
    parts = (more, p), (less, q), (same, 1.0 - p - q)
    return sum(count * np.log(np.maximum(share, tiny)) for count, share in parts)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float | None = None):
    """Most likely similarities of pairs, rows of registers with known sizes; with ``at``, also how many
    nats more likely they are than that similarity."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    counts = more, less, a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    # The likelihood has one peak.
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = _log_likelihood(x, u, v, *counts) > _log_likelihood(y, u, v, *counts)
        low, high = np.where(left, low, x), np.where(left, y, high)
    best = (low + high) / 2
    if at is None:
        return best
    return best, _log_likelihood(best, u, v, *counts) - _log_likelihood(np.full(len(u), at), u, v, *counts)


def _sketched(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            digests, sizes, kept, odd = [], [], [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), words, known)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                kept.append(registers(hashes).astype(">u2").tobytes())
                odd.append(parities(hashes).tobytes())
            columns = [pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (digests, kept, odd)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *columns],
                names=["doc_id", "text_hash", "n", "digest", "registers", "odd"],
            )

    return rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, words: int = 2) -> DataFrame:
    """Rows (doc_id, text_hash, n, digest, registers, odd), one per document: its set's size, digest, sketch, parities."""
    schema = "doc_id long, text_hash long, n long, digest binary, registers binary, odd binary"
    return _texts(docs).mapInArrow(_sketched(words), schema)


def _sets(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()

        def done(nodes: list, sets: list) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["node", "hashes"])

        for batch in batches:
            nodes, sets, total = [], [], 0
            for node, digest, text in zip(batch.column("node"), batch.column("digest"), batch.column("text")):
                hashes = shingles(text.as_py(), words, known)
                # Another text of the same id and hash.
                if xxhash.xxh3_128_digest(hashes.tobytes(), SEED) != digest.as_py():
                    continue
                nodes.append(node.as_py())
                sets.append(hashes)
                total += len(hashes)
                if total > BATCH:
                    yield done(nodes, sets)
                    nodes, sets, total = [], [], 0
            if nodes:
                yield done(nodes, sets)

    return rows


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of numbers from binary values of one length."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return values.view(dtype).reshape(len(column), -1)


def _likely(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches_ = [_matrix(batch.column(c), d) for c, d in (("registers_a", ">u2"), ("registers_b", ">u2"), ("odd_a", "u1"), ("odd_b", "u1"))]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b")]
            stays = pa.array(_near(*sketches_, *sizes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stays) for c in ("a", "b")], names=["a", "b"])

    return rows


def _near(a, b, odd_a, odd_b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether pairs may have the similarity by their parities, and by their registers."""
    near = may_reach(odd_a, odd_b, n_a, n_b, percent)
    at = np.flatnonzero(near)
    if len(at):
        best, nats = estimated(a[at], b[at], n_a[at].astype(np.float64), n_b[at].astype(np.float64), at=percent / 100)
        near[at] = (best >= percent / 100) | (nats <= DOUBT)
    return near


def _pairs_of_cells(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs of every cell, some ``PAIRS`` at a time; the rows are in order of their cells."""
    key, i, j, block = (table.column(c).to_numpy() for c in ("key", "i", "j", "block"))
    ends = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for start, end in zip([0, *ends], [*ends, len(key)]):
        place = np.arange(start, end)
        if i[start] == j[start]:
            for k in range(0, len(place), step := max(1, PAIRS // len(place))):
                left, right = np.meshgrid(place[k : k + step], place[k:], indexing="ij")
                later = right > left
                yield left[later], right[later]
        else:
            first, second = place[block[start:end] == i[start]], place[block[start:end] == j[start]]
            for k in range(0, len(first), step := max(1, PAIRS // max(1, len(second)))):
                left, right = np.meshgrid(first[k : k + step], second, indexing="ij")
                yield left.ravel(), right.ravel()


def _compared(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Likely pairs of the cells in these rows."""
    node, n, root = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "root"))
    sketch, odd = (_matrix(table.column(c).combine_chunks(), d) for c, d in (("registers", ">u2"), ("odd", "u8")))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def judged() -> pa.RecordBatch:
        left, right = (np.concatenate(side) for side in zip(*held))
        near = _near(sketch[left], sketch[right], odd[left], odd[right], n[left], n[right], percent)
        a, b = np.minimum(node[left], node[right])[near], np.maximum(node[left], node[right])[near]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for left, right in _pairs_of_cells(table):
        sizes = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        # Two sets of this similarity cannot differ more in size.
        open_ = (root[left] != root[right]) & (100 * sizes[0] >= percent * sizes[1])
        held.append((left[open_], right[open_]))
        total += len(held[-1][0])
        if total >= PAIRS:
            yield judged()
            held, total = [], 0
    if total:
        yield judged()


def _cells(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            now = key[-1], i[-1], j[-1]
            # The last cell of a batch may go on in the next one.
            start = int(np.argmax(same))
            if start or last not in (None, now):
                yield from _compared(pa.Table.from_batches([*waiting, batch.slice(0, start)]), percent)
                waiting = []
            waiting.append(batch.slice(start))
            last = now
        if waiting:
            yield from _compared(pa.Table.from_batches(waiting), percent)

    return rows


def _shingle_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Rows (node, hashes) of the nodes, from their first documents.

    The nodes are written first: while they are few, as Spark sees from the size of the files, it does not shuffle the texts.
    """
    of = nodes.select("node", "digest", F.col("least.doc_id").alias("of"), F.col("least.text_hash").alias("of_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    # Rows that repeat an id and text are one.
    texts = _texts(docs).join(written(of, "set-owners"), same).select("node", "digest", "text").dropDuplicates(["node", "digest", "text"])
    return written(texts.mapInArrow(_sets(words), "node long, hashes array<long>"), "shingle-sets")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that may reach the similarity by their sketches."""
    for side in ("a", "b"):
        sketch = [F.col(c).alias(f"{c}_{side}") for c in ("n", "registers", "odd")]
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *sketch), side)
    return pairs.mapInArrow(_likely(percent), "a long, b long")


def _verified(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""
    likely = written(likely, "likely-pairs")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    asked = sets.join(written(ends, "asked-nodes"), "node")
    both = likely
    for side in ("b", "a"):
        both = both.join(asked.select(F.col("node").alias(side), F.col("hashes").alias(f"set_{side}")), side)
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return written(both.filter(100 * shared >= percent * (total - shared)).select("a", "b"), "near-links")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, root) after the links: only roots are put together, so that paths stay short."""
    for side in ("a", "b"):
        end = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(end, side)
    edges = written(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "root-links")
    if edges.isEmpty():
        return roots
    found = components(edges).select(F.col("node").alias("root"), F.col("root").alias("smaller"))
    merged_ = roots.join(written(found, "components"), "root", "left")
    return written(merged_.select("node", F.coalesce("smaller", "root").alias("root")), "roots")


def _roots(nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Rows (node, root) of all nodes that share a bucket: root is the smallest node reachable."""
    width = ROWS * 2
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width)))
    )
    sides = nodes.select("node", "n", F.explode(keys).alias("key"))
    shared = sides.groupBy("key").agg(F.count("*").alias("in_bucket"), F.min(F.struct("node", "n")).alias("middle"))
    shared = shared.filter("in_bucket > 1").select("key", F.col("middle.node").alias("m_node"), F.col("middle.n").alias("m_n"))
    # The middles are compared with all others of the bucket now.
    buckets = written(sides.join(shared, "key").filter("node > m_node"), "buckets")
    ends = buckets.select("node").unionByName(buckets.select(F.col("m_node").alias("node"))).distinct()
    nodes = written(nodes.join(ends, "node"), "met-sets")
    sets = _shingle_sets(nodes, docs, words)
    pairs = buckets.filter(100 * F.least("n", "m_n") >= percent * F.greatest("n", "m_n"))
    pairs = written(pairs.select(F.col("m_node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    roots = nodes.select("node", F.col("node").alias("root"))
    roots = _joined(roots, _verified(_likely_pairs(pairs, nodes, percent), sets, percent))
    sketches_ = nodes.select("node", "registers", "odd")
    buckets, middles = buckets.select("key", "node", "n"), 1
    while True:
        rooted = written(buckets.join(roots, "node"), "rooted-buckets")
        sizes = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("in_bucket"))
        mixed = written(sizes.filter("x < y").select("key", F.ceil(F.col("in_bucket") / BLOCK).alias("blocks")), "mixed-buckets")
        block = F.pmod(F.xxhash64("node", "key"), "blocks")
        open_ = written(rooted.join(mixed, "key").withColumn("block", block), "open-buckets")
        if open_.isEmpty():
            return roots
        # Cells (i, j) with a middle block i: of a row, those where its block is the second, and, in a middle block, the first.
        upto = F.transform(F.sequence(F.lit(0).cast("long"), F.least("block", F.lit(middles - 1))), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
        after = F.transform(F.sequence(F.col("block") + 1, F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
        has_after = (F.col("block") < middles) & (F.col("block") + 1 < F.col("blocks"))
        cell = F.explode(F.when(has_after, F.concat(upto, after)).otherwise(upto)).alias("cell")
        sides = open_.join(sketches_, "node").select("key", "block", "node", "n", "root", "registers", "odd", cell)
        sides = sides.select("key", "cell.i", "cell.j", "block", "node", "n", "root", "registers", "odd")
        cells = sides.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        likely = cells.mapInArrow(_cells(percent), "a long, b long").distinct()
        roots = _joined(roots, _verified(likely, sets, percent))
        buckets = open_.filter(F.col("block") >= middles).select("key", "node", "n")
        if buckets.isEmpty():
            return roots
        middles *= GROWTH


def _members(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and rows (digest, least, root): distinct sets, the first document of each, their component."""
    found = written(sketches(docs, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("least")
    same = [F.first(c).alias(c) for c in ("n", "registers", "odd")]
    nodes = found.filter("n > 0").groupBy("digest").agg(first, *same).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "distinct-sets")
    roots = _roots(nodes, docs, percent, words)
    rooted = nodes.select("node", "digest", "least").join(roots, "node", "left")
    return found, written(rooted.withColumn("root", F.coalesce("root", "node")), "rooted-sets")


def groups(docs: DataFrame, percent: int = 80, words: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per document.

    ``kept`` marks the document that names the component; a component without any id keeps all.
    """
    found, rooted = _members(docs, percent, words)
    names = rooted.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = written(rooted.join(names, "root").select("digest", "component_id"), "named-sets")
    alone = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = found.filter("n > 0").join(named, "digest").select("doc_id", "n", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The documents without the near copies of others: of each group the first by id, then text.

    Texts without words stay. Of rows that repeat an id and text, the first by the other columns stays.
    """
    found, rooted = _members(docs, percent, words)
    first = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.text_hash")
    kept = first.unionByName(found.filter("n = 0").select("doc_id", "text_hash").distinct())
    kept = written(kept.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH)), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(_ID)) & (_text_hash() == F.col(_HASH))
    stays = docs.join(kept, same, "left_semi").withColumn(_HASH, _text_hash())
    sortable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    again = Window.partitionBy("doc_id", _HASH).orderBy(*[F.col(f"`{c}`") for c in sortable])
    return stays.withColumn(_ID, F.row_number().over(again)).filter(F.col(_ID) == 1).drop(_ID, _HASH)


# Column names that no table has.
_ID, _HASH = "__setsketch_kept", "__setsketch_hash"
