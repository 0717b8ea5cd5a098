"""Exact top-k by inner product: branch and bound over blocks of dimensions.

Vectors become whole numbers, floor(scale * x). Candidates are dealt to blocks and laid out by column;
every block of queries meets every block of candidates once. In such a cell the scores of all
candidates grow by one block of dimensions at a time, the dimensions of most mass first. After each block, what
the other dimensions can still add is bounded by the product of the remaining lengths
(Cauchy-Schwarz). The k-th best lower bound of a query throws out every candidate whose upper bound
is below it, and the surviving candidates are compacted before the next block. What survives all blocks is
scored exactly in whole numbers; the best k of the cells are ranked over all cells.

Vectors whose components do not fit 64-bit sums (see ``WIDEST``) meet the others in cells of their own, candidates
of about one size together. There the bounds are taken from vectors scaled to one, and what survives is scored in
whole numbers of any length.

Defined results: a vector takes no part if it is null, is empty, or holds a null or a non-finite component.
Vectors of different lengths do not meet. Ties go to the smaller id; a query does not meet rows of its own id;
repeated candidate rows count each, repeated query rows are one query. Rows of one id with different vectors are
queries of their own. Null ids take no part. A query with no candidates has no rows, nor has an empty table. A score
that does not fit a long is ranked as any other and returned as null. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import blocks_for, written

# Candidates of one cell: a share of all, within these bounds. Queries of one cell.
CANDIDATES = (1_024, 16_384)
CELLS = 32
QUERIES = 1_024
# Dimensions added between two prunings.
STEP = 16
# Queries whose bounds are held at a time.
AT_ONCE = 128
# Up to this size of whole components, sums of products fit 64 bits for up to 8,192 dimensions.
WIDEST = 2**24
# Powers of two that the greatest components of wide candidates of one cell differ by at most.
SPREAD = 8
# From this size on a double is a whole number.
INTEGRAL = 2.0**60
# Bytes of the key of a score beyond a long: products of doubles times scales, added up.
KEY_BYTES = 280

_COLUMNS = ["query_no", "query_id", "vec_id", "place", "beyond", "score_key", "score"]
_FOUND = "query_no long, query_id long, vec_id long, place int, beyond int, score_key binary, score long"


def whole(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """Rows (vec_id, v, x, size_class, dims, row_no) of the vectors that take part: v in whole numbers.

    A wide vector has its components as they are in x, no v, and a size class above 0.
    """
    values = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("x")
    )
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = values.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    greatest = F.array_max(F.transform("x", F.abs))
    # Without the scale, which could take a finite number beyond the doubles.
    size_class = F.when(greatest <= float(WIDEST) / scale, 0).otherwise(F.floor(F.log2(greatest) / SPREAD) + SPREAD)
    v = F.transform("x", lambda x: F.floor(F.lit(scale) * x))
    rows = rows.withColumn("size_class", size_class.cast("int"))
    narrow = F.col("size_class") == 0
    return rows.select(
        "vec_id", F.when(narrow, v).alias("v"), F.when(~narrow, F.col("x")).alias("x"), "size_class",
        F.size("x").alias("dims"), F.monotonically_increasing_id().alias("row_no"),
    )


def integers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) in whole numbers of any length; from ``INTEGRAL`` on without rounding."""
    return [math.floor(scale * c) if abs(c) < INTEGRAL else int(c) * scale for c in x.tolist()]


def _scaled_to_one(numbers: list[list[int]]) -> np.ndarray:
    """The rows divided by one power of two, so that no component is above 1; far smaller ones vanish."""
    power = max((abs(c).bit_length() for row in numbers for c in row), default=0)
    shift = max(power - 1_000, 0)
    return np.ldexp(np.array([[float(c >> shift) for c in row] for row in numbers]), shift - power)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64)


def search_cell(
    queries: np.ndarray,
    query_ids: np.ndarray,
    candidates: np.ndarray,
    ids: np.ndarray,
    k: int,
    scores: Callable[[int, np.ndarray], np.ndarray] | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, the places of its best k candidates, and their exact scores.

    ``candidates`` must be in ascending order of id. ``scores`` gives the exact scores of a query and places where
    the vectors are only near to the whole numbers; all of one query may be divided by one number.
    """
    mass = (np.abs(candidates).astype(float).mean(axis=0) + 1e-9) * (np.abs(queries).astype(float).mean(axis=0) + 1e-9)
    order = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(candidates[:, order].T.astype(float))
    wanted = queries[:, order].astype(float)
    dims = len(order)
    bounds = [*range(0, dims, STEP), dims]
    left_c = [np.sqrt((columns[b:] ** 2).sum(axis=0)) for b in bounds[1:]]
    left_q = [np.sqrt((wanted[:, b:] ** 2).sum(axis=1)) for b in bounds[1:]]
    slack = 1e-9 * float(np.abs(columns).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * dims + 1e-6
    for i in range(0, len(queries), AT_ONCE):
        some = slice(i, min(i + AT_ONCE, len(queries)))
        partial = wanted[some, : bounds[1]] @ columns[: bounds[1]]
        for row in range(partial.shape[0]):
            number = i + row
            alive = np.flatnonzero(ids != query_ids[number])
            score = partial[row][alive]
            for block in range(len(bounds) - 1):
                a, b = bounds[block], bounds[block + 1]
                if block:
                    score = score + wanted[number, a:b] @ columns[a:b][:, alive]
                rest = left_q[block][number] * left_c[block][alive]
                if len(alive) > k:
                    least = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                    kept = score + rest >= least - slack
                    alive, score = alive[kept], score[kept]
            exact = candidates[alive] @ queries[number] if scores is None else scores(number, alive)
            best = np.argsort(-exact, kind="stable")[:k]
            yield number, alive[best], exact[best]


def _whole_rows(rows: pd.DataFrame, scale: int) -> list[list[int]]:
    return [v.tolist() if x is None else integers(x, scale) for v, x in zip(rows["v"], rows["x"])]


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int) -> Iterator[tuple]:
    ids, query_ids = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    if (queries["size_class"] == 0).all() and (candidates["size_class"] == 0).all():
        yield from search_cell(_matrix(queries["v"]), query_ids, _matrix(candidates["v"]), ids, k)
        return
    asked, offered = _whole_rows(queries, scale), _whole_rows(candidates, scale)

    def scores(number: int, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), dtype=object)
        out[:] = [sum(map(int.__mul__, asked[number], offered[place])) for place in places]
        return out

    near = np.concatenate([_scaled_to_one([row]) for row in asked])
    yield from search_cell(near, query_ids, _scaled_to_one(offered), ids, k, scores)


def _ordered(score: int) -> tuple[int, bytes | None, int | None]:
    """What a score is ordered by: side beyond the longs, key there, the score itself among the longs."""
    if -(2**63) <= score < 2**63:
        return 0, None, int(score)
    return (1 if score > 0 else -1), (score + (1 << (8 * KEY_BYTES - 1))).to_bytes(KEY_BYTES, "big"), None


def _cell(k: int, scale: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({c: [] for c in _COLUMNS})
        queries = queries.sort_values(["vec_id", "query_no"], ignore_index=True)
        candidates = candidates.sort_values("vec_id", ignore_index=True, kind="stable")
        ids, numbers = candidates["vec_id"].to_numpy(), queries["query_no"].to_numpy()
        query_ids = queries["vec_id"].to_numpy()
        rows = [
            (numbers[q], query_ids[q], ids[place], rank, *_ordered(score))
            for q, at, scores in _search(queries, candidates, k, scale)
            for rank, (place, score) in enumerate(zip(at, scores.tolist()))
        ]
        found = pd.DataFrame(rows, columns=_COLUMNS)
        return found.astype({"score": pd.Int64Dtype()})

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of every query."""
    rows = written(whole(vectors, id_column, column, scale), "vectors")
    asked = rows.filter(is_query).drop("row_no").dropDuplicates(["vec_id", "v", "x"])
    asked = written(asked.withColumn("query_no", F.xxhash64("vec_id", "v", "x")), "queries")
    total = rows.count()
    many = blocks_for(total, min(max(total // CELLS, CANDIDATES[0]), CANDIDATES[1]))
    query_blocks = blocks_for(asked.count(), QUERIES)
    # At most some 150, by the size of doubles.
    classes = sorted(r["size_class"] for r in rows.select("size_class").distinct().collect())
    # Repeated rows are dealt out too.
    candidate_block = F.pmod(F.xxhash64("vec_id", "row_no"), F.lit(many))
    query_block = F.pmod(F.col("query_no"), F.lit(query_blocks))
    narrow_query = F.col("size_class") == 0
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    every_candidate_block = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    every_class = F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))
    both_kinds = F.explode(F.array(*[F.lit(c == 0) for c in sorted({min(c, 1) for c in classes})]).cast("array<boolean>"))
    cells = ["dims", "query_block", "candidate_block", "candidate_class", "narrow_query"]
    left = asked.select(
        "dims", "query_no", "vec_id", "v", "x", "size_class", query_block.cast("int").alias("query_block"),
        narrow_query.alias("narrow_query"), every_candidate_block.alias("candidate_block"),
    ).withColumn("candidate_class", every_class)
    right = rows.select(
        "dims", "vec_id", "v", "x", "size_class", candidate_block.cast("int").alias("candidate_block"),
        F.col("size_class").alias("candidate_class"), every_query_block.alias("query_block"),
    ).withColumn("narrow_query", both_kinds)
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(_cell(k, scale), _FOUND)
    order = [F.desc("beyond"), F.desc("score_key"), F.desc("score"), "vec_id", "place"]
    best = Window.partitionBy("query_no", "query_id").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
