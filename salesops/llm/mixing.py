"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document of the source is then wanted
``target / source_size`` times: the whole part are sure copies, the fraction is an inclusion
probability. The flight phase of the cube method moves these probabilities inside the null space
of the balancing constraints (total of words and number of documents) until all but a few are 0 or
1. Blocks of a source fly independently, what is left of all blocks flies again, and so on until
one small landing problem per source remains, which lets go of the number of documents first.
Documents heavy for their source are decided in the last flight, while light ones can still make
up for them.

Defined results: null text has size 0; a null source is a source of its own, the last one; a source
without words has target 0 and nothing is taken; documents are told apart by doc_id and, where ids
repeat or are null, by their order of source and size; an empty table gives an empty result. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from salesops.llm.common import blocks_for, word_count, written

# Documents that fly together in one block.
BLOCK_DOCS = 1_000
# A document is heavy when it holds more than this share of its source's words.
HEAVY = 1 / 1000
# Undecided documents are few enough for the last flight of a source.
LANDING_DOCS = 2_000
# A probability this close to 0 or 1 is decided.
EPS = 1e-9

_UNIT = "source_no long, block long, key long, doc_id long, rep int, size long, n long, p double"


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Rows (source, source_size) with each source's weight and target.

    Weights are dealt to the sources in ascending order (null last), repeating. The targets share
    ``share`` times all words by weight; none exceeds ``max_repeat`` times its source, and what is
    over goes to the others by weight. Solved in closed form: in ascending order of cap over weight,
    the sources before some place stand at their cap and the others get one common rate. There is
    one row per source here, so the ordered windows are small whatever the corpus holds.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    number = F.row_number().over(by_name).cast("long") - 1
    dealt = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")
    )
    rows = (
        sizes.withColumn("source_no", number)
        .withColumn("weight", dealt)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("total") - F.col("capped")) / F.sum("weight").over(onward))
        .withColumn("fills", F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "source_no", "rate")))
        .withColumn("rate", F.min("fills").over(everything)["rate"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_no", "source_size", "weight", target.alias("target"))


def _rng(source_no: int, block: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, source_no & 0x7FFFFFFF, block & 0x7FFFFFFF])


def _kernel(size: np.ndarray) -> np.ndarray:
    """A move of three probabilities that keeps their number and their words."""
    a, b, c = size
    u = np.array([b - c, c - a, a - b], dtype=float)
    return u if u.any() else np.array([1.0, -1.0, 0.0])


def _steps(p: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """How far p can go along u and against it before a probability reaches 0 or 1."""
    up, down = u > 0, u < 0
    ahead = min(((1 - p[up]) / u[up]).min(initial=np.inf), (p[down] / -u[down]).min(initial=np.inf))
    back = min((p[up] / u[up]).min(initial=np.inf), ((1 - p[down]) / -u[down]).min(initial=np.inf))
    return ahead, back


def _move(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """One random step of the walk that keeps the expectation of p."""
    ahead, back = _steps(p, u)
    moved = p + ahead * u if draw * (ahead + back) < back else p - back * u
    moved[moved < EPS] = 0.0
    moved[moved > 1 - EPS] = 1.0
    return moved


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight over a long block, three documents at a time; at most two stay undecided."""
    p = p.copy()
    draws = rng.random(len(p) + 1)
    active: list[int] = []
    for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)):
        active.append(i)
        if len(active) == 3:
            p[active] = _move(p[active], _kernel(size[active]), draws[i])
            active = [j for j in active if 0 < p[j] < 1]
    return p


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Last flight and landing of a source, the largest documents first.

    The largest undecided document moves against all others, spread over them by their room, so
    that it is decided while they can still balance it. Two constraints hold while three are left,
    then only the words, and the last one is drawn.
    """
    p = p.copy()
    order = np.argsort(-size, kind="stable")
    while True:
        left = order[(p[order] > EPS) & (p[order] < 1 - EPS)]
        if len(left) == 0:
            return np.round(p)
        first, rest = left[0], left[1:]
        u = np.zeros(len(left))
        u[0] = 1.0
        if len(rest):
            room = p[rest] * (1 - p[rest])
            s = size[rest].astype(float)
            m0, m1, m2 = room.sum(), (room * s).sum(), (room * s * s).sum()
            spread = m0 * m2 - m1 * m1
            if len(rest) > 1 and spread > 1e-9 * m0 * m2:
                a = (m2 - m1 * size[first]) / spread
                b = (m0 * size[first] - m1) / spread
                u[1:] = -room * (a + b * s)
            elif m1 > 0:
                u[1:] = -room * s * size[first] / m2
            elif m0 > 0 and size[first] == 0:
                u[1:] = -room / m0
        p[left] = _move(p[left], u, rng.random())


def _flight(seed: int):
    def over(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["key", "doc_id", "rep"], kind="stable", ignore_index=True)
        rng = _rng(int(block["source_no"].iat[0]), int(block["block"].iat[0]), seed)
        block["p"] = fly(block["size"].to_numpy(), block["p"].to_numpy(), rng)
        return block

    return over


def _landing(seed: int):
    def over(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["key", "doc_id", "rep"], kind="stable", ignore_index=True)
        rng = _rng(int(block["source_no"].iat[0]), -1, seed)
        block["p"] = land(block["size"].to_numpy(), block["p"].to_numpy(), rng)
        return block

    return over


def _in_blocks(units: DataFrame, seed: int) -> DataFrame:
    """Deal each source's n documents to blocks by hash; n becomes what they may leave undecided."""
    blocks = F.ceil(F.col("n") / BLOCK_DOCS)
    block = F.pmod(F.xxhash64("key", "doc_id", "rep", F.lit(seed)), F.greatest(blocks, F.lit(1)))
    return units.withColumn("block", block.cast("long")).withColumn("n", 2 * blocks)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Rows (doc_id, rep, size, source, source_size, target, copies), one per document.

    ``copies`` says how often the mix takes the document, ``rep`` numbers documents of one id.
    """
    by_id = _same_id(F.col("size"))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    sized = written(sized.withColumn("rep", F.row_number().over(by_id)), "mix-sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(stats.drop("n"), weights, share, max_repeat).join(
        stats.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of"))
    )
    plan = written(plan.drop("of"), "mix-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(wanted + EPS)
    rows = (
        sized.join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select(
            "doc_id", "rep", "size", sized["source"], "source_no", "source_size", "target", "n",
            sure.cast("long").alias("sure"),
            F.greatest(wanted - sure, F.lit(0.0)).alias("p"),
            F.xxhash64("doc_id", "rep", F.lit(seed)).alias("key"),
        )
    )
    drawn = _drawn(rows, plan.agg(F.max("n")).first()[0] or 0, seed)
    same = ["source_no", "doc_id", "rep"]
    chosen = rows.select(*same, "size", "source", "source_size", "target", "sure").unionByName(
        drawn.select(*same, F.lit(1).cast("long").alias("sure")), allowMissingColumns=True
    )
    return (
        chosen.groupBy(*same)
        .agg(
            F.max("size").alias("size"),
            F.max("source").alias("source"),
            F.max("source_size").alias("source_size"),
            F.max("target").alias("target"),
            F.sum("sure").alias("copies"),
        )
        .drop("source_no")
    )


def mixed(docs: DataFrame, *how, **options) -> DataFrame:
    """The documents, each as many times as the mix takes it, with all of their columns."""
    taken = mix(docs, *how, **options).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias(_OF), F.col("rep").alias(_REP_OF), F.col("copies").alias(_COPIES))
    numbered = docs.withColumn(_REP, F.row_number().over(_same_id(word_count("text"))))
    same = F.col("doc_id").eqNullSafe(F.col(_OF)) & (F.col(_REP) == F.col(_REP_OF))
    found = numbered.join(taken, same)
    repeated = found.withColumn(_OF, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_COPIES))))
    return repeated.drop(_OF, _REP, _REP_OF, _COPIES)


# Column names that no table has.
_OF, _REP, _REP_OF, _COPIES = "__mix_of", "__mix_rep", "__mix_rep_of", "__mix_copies"


def _same_id(size: Column) -> WindowSpec:
    """Documents of one id, in the order in which they are numbered."""
    return Window.partitionBy("doc_id").orderBy(F.col("source").isNull(), "source", size)


def _drawn(rows: DataFrame, largest_source: int, seed: int) -> DataFrame:
    """The documents that get one more copy."""
    names = ["source_no", "block", "key", "doc_id", "rep", "size", "n", "p"]
    open_ = rows.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
    open_ = open_.withColumn("block", F.lit(-1).cast("long"))
    heavy = F.col("size") > F.col("source_size") * HEAVY
    heavies = open_.filter(heavy).select(*names)
    flown = open_.filter(~heavy).select(*names)
    drawn = None
    count = largest_source
    while True:
        blocks = _in_blocks(flown, seed).select(*names)
        after = written(blocks.groupBy("source_no", "block").applyInPandas(_flight(seed), _UNIT), "mix-flight")
        yes = after.filter(F.col("p") >= 1 - EPS)
        drawn = yes if drawn is None else drawn.unionByName(yes)
        flown = after.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        count = 2 * blocks_for(count, BLOCK_DOCS)
        if count <= LANDING_DOCS:
            break
        seed += 1
    landed = flown.unionByName(heavies).groupBy("source_no").applyInPandas(_landing(seed), _UNIT)
    return drawn.unionByName(written(landed, "mix-landing").filter(F.col("p") >= 0.5))
