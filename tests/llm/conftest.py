from __future__ import annotations

import pytest
from pyspark.sql import types as T

# What every operator must live with: nulls in any column, empty and blank texts, a very long text,
# repeated rows and ids, and columns whose names operators use inside.
LONG = "word and another one, " * 20_000
ODD = [
    (1, "a plain text of a few words here", "en", "web", 32),
    (1, "a plain text of a few words here", "en", "web", 32),
    (1, "another text under the same id", "en", None, None),
    (2, None, None, None, None),
    (None, "no id at all but some words", "de", "books", 5),
    (None, None, None, None, None),
    (3, "", "en", "web", 0),
    (4, " \n\t ", "en", "web", 4),
    (5, LONG, "en", "books", len(LONG)),
    (6, "Ünïcödé ツ <|endoftext|> \x00 text", "fr", "", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "rep", "block", "fp", "spans", "start", "p", "key", "copies", "shard", "root", "terms", "n")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with clashing extra columns."""
    rows = [(*r, *["x"] * len(CLASHING)) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict:
    return {r["doc_id"]: r["text"] for r in documents.collect()}
