"""How filters of a corpus overlap: what each removes in every order of application.

Filters are conditions on a text, and one more that fails the copies: documents whose text is that of a
smaller doc_id. Copies come from an existential self-join, a left semi join on hash, exact text and
smaller doc_id; only texts of repeated hashes take part, their right side is one row per text, and hot
hashes are salted. The ids found are put together with those that fail the other filters, and the
documents become counts per part and combination of failed filters, at most two to the power of the
filters per part. All orders are worked out from these counts; no document is looked at again.

Defined results: a null text is empty, a null part the empty string. A null doc_id is no copy, makes no
other text a copy and has no label. Rows that repeat count each; rows of one id and text are no copies of
each other. A document counts as labelled if any row of labels says so. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import written

# White space as in ``common.WORD``, for splitting.
SPACE = r"[\x20\x09-\x0D]+"
# A hash is hot above 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot ones.
HOT_SHARE = 1_000
SALTS = 64


def standard_filters() -> dict[str, Column]:
    """Too short, too repetitive, too many capitals, odd characters; over text, words and code points."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * capitals > 10 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
    )


def flagged(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Rows (doc_id, part, hash, mask): one bit per failed filter, in the order given."""
    words = F.array_remove(F.split("text", SPACE), "")
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0))
    return _texts(docs).withColumn("words", words).select("doc_id", "part", "hash", mask.alias("mask"))


def copies(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows (doc_id, part, hash) of the documents with the exact text of a smaller doc_id.

    ``hashes`` holds doc_id and hash of all documents, so that they are counted without their texts.
    """
    counted = hashes.groupBy("hash").agg(F.count("*").alias("n"), (F.min("doc_id") < F.max("doc_id")).alias("more"))
    counted = written(counted.filter("more"), "repeated-hashes")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") * HOT_SHARE > total).select("hash", F.lit(True).alias("hot"))
    marked = _texts(docs).join(F.broadcast(hot), "hash", "left")
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS))).otherwise(F.lit(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))

    def salted(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.explode(salts)).drop("hot")

    texts = marked.withColumn("salt", spread.cast("int")).drop("hot")
    texts = written(texts.join(salted(counted.select("hash")), ["hash", "salt"], "left_semi"), "repeated-texts")
    least = salted(texts.groupBy("hash", "text").agg(F.min("doc_id").alias("least")))
    mine, other = texts.alias("mine"), least.alias("other")
    same = reduce(lambda a, b: a & b, [F.col(f"mine.{c}") == F.col(f"other.{c}") for c in ("hash", "salt", "text")])
    found = mine.join(other, same & (F.col("other.least") < F.col("mine.doc_id")), "left_semi")
    return found.select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the filters they fail; the copies have the last bit."""
    rows = written(flagged(docs, filters), "filter-flags")
    copied = copies(docs, rows.select("doc_id", "hash"))
    ids = rows.withColumn("n", F.lit(1)).unionByName(
        copied.select("*", F.lit(1 << len(filters)).alias("mask"), F.lit(0).alias("n"))
    )
    failed = ids.groupBy("doc_id", "part", "hash").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    flags = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f) for c, f in (("quality", "good"), ("toxic", "bad"))]
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags)
    # Without an id there is no label; so rows without one do not meet in a task of the join.
    named = failed.filter("doc_id IS NOT NULL").join(known, "doc_id", "left")
    nameless = failed.filter("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("bad"))
    sums = [F.sum(F.when(F.col(f), F.col("n")).otherwise(0)).alias(c) for f, c in (("good", "good"), ("bad", "toxic"))]
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copied: str = "E") -> DataFrame:
    """One row per part, order of the filters and step; see the columns of the result.

    Names of filters are one character each; ``copied`` names the filter that fails copies. ``labels``
    has doc_id, quality and toxic.
    """
    filters = standard_filters() if filters is None else filters
    names = "".join([*filters, copied])
    if len(set(names)) != len(filters) + 1:
        raise ValueError("names of filters are single characters, each once")
    one = F.struct("mask", "n", "good", "toxic")
    parts = combinations(docs, labels, filters).groupBy("part").agg(F.collect_list(one).alias("cells"))
    orders = F.explode(F.lit(["".join(p) for p in permutations(names)]))
    steps = parts.select("part", "cells", orders.alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))

    def bit(name: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), name) - 1)

    before = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    steps = steps.withColumns({
        "letter": letter,
        "bit": bit(letter),
        "earlier": F.aggregate(before, F.lit(0), lambda m, name: m.bitwiseOR(bit(name))),
    })

    def count(which, column: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(which(c["mask"]), c[column]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    left = lambda m: m.bitwiseAND(F.col("earlier")) == 0
    counts = steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "letter",
        count(lambda m: left(m) & ~fails(m)).alias("kept"),
        count(lambda m: left(m) & fails(m)).alias("removed"),
        count(lambda m: ~left(m) & fails(m)).alias("redundant"),
        count(lambda m: m == F.col("bit")).alias("unique_fails"),
        count(lambda m: left(m) & fails(m), "good").alias("good_lost"),
        count(lambda m: left(m) & fails(m), "toxic").alias("toxic_lost"),
    )
    # Orders times steps are all rows of a part.
    total = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return counts.withColumn("shapley", total).drop("letter")
