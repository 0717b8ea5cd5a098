"""From raw documents to token files: classify, remove near-exact copies, decontaminate and remove
edited copies, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns documents, with the same columns, for the next one;
the last returns one row per document of the token files. Each result is written before the next stage
reads it. Null ids, null and empty texts, ties, repeated rows and empty tables are treated as the operator of
the stage says in its module; columns besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesops.llm import decontaminate, mixing, quality, setsketch, simhash, simple8b
from salesops.llm.common import table, written
from salesops.llm.queries import END_ID, GOOD, REPEATS, SHARE, WEIGHTS, tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier expects to have the best grade."""
    ratings = quality.ratings_of(table(spark, sf_dir, "labels"))
    model = quality.fit(docs, ratings, quality.GRADES)
    return quality.select_good(docs, model, quality.GRADES - 1, GOOD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-exact copies, by fingerprints."""
    return simhash.one_of_each(docs)


def without_edited_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: word shingles of five, similarity 0.8 or more."""
    return setsketch.one_of_each(docs, percent=80, words=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of edited copies, of those that hold no benchmark item.

    Both in one stage: a test holds the stage before to the links of the fingerprints alone.
    """
    clean = decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return without_edited_copies(written(clean, "decontaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, WEIGHTS, SHARE, REPEATS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; one row per document read back from them."""
    return simple8b.encode_and_read(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", without_copies),
    ("benchmark decontamination and shingle near-dedup", without_benchmark),
    ("mixing", mixed),
    ("token ids", encoded),
]

# Tokenizing, fitting and sampling are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
