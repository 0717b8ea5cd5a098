"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.llm import (
    decontaminate,
    html,
    interactions,
    mixing,
    periodic,
    pii,
    quality,
    setsketch,
    simhash,
    simple8b,
    tokencounts,
    topk,
    urls,
)
from salesops.llm.common import table, written
from salesops.plans.lineage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

# Weights of the sources in ascending order, share of all words, and most repeats.
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2.0
# The tokenizer of the token files and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
# The URL rules.
RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]
# The line by which a text says under which licence it stands.
LICENCE = r"^Released under the [^\n]*\n"
# Least probability of the best grade for a document to stay.
GOOD = 0.5


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, REPEATS)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents counted; then exact copies deleted, licence lines cut from the rest, the first batch sent again."""
    docs = table(spark, sf_dir, "documents")
    store = tokencounts.Store(spark, scratch_path(spark, "token-counts"))
    inserts = tokencounts.counted(docs, "insert")
    store.commit("1-load", inserts)
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    first = docs.select("doc_id", text.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Written, so that a text with very many copies is a skewed join that Spark can split.
    first = written(first, "first-of-text")
    marked = docs.withColumn("digest", text).join(first, "digest")
    copies = marked.filter("doc_id != first").select(
        F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("tokenizer"), "source", "lang",
        F.lit(0).alias("tokens"), F.lit(0).alias("chars"),
    )
    store.commit("2-copies", written(copies, "copies"))
    licensed = docs.filter(F.col("text").rlike(LICENCE))
    licensed = licensed.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    cut = licensed.withColumn("text", F.regexp_replace("text", LICENCE, ""))
    store.commit("3-licences", tokencounts.counted(cut, "revise"))
    store.commit("1-load", inserts)
    return store.totals()


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.ratings_of(labels), quality.GRADES)
    scored = quality.score(docs, model, quality.GRADES - 1)
    return scored.withColumn("keep", F.col("p_good") >= GOOD)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the CRC of its id, with a tail of repeated words; the others as they are."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), interactions.SPACE), "")
    rows = docs.select("doc_id", "text", code.alias("h"), F.when(code % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumns({"a": F.try_mod(g, n).cast("int"), "n": n, "g": g})
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    tail = F.transform(F.sequence(a, F.col("n") - 1), lambda i: F.get("words", a + (i - a) % p))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(with_periods(table(spark, sf_dir, "documents"))))


def near_duplicate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": mixing_sources,
        "op2_simple8b": token_ids,
        "op3_pii": personal_data,
        "op4_urls": url_filter,
        "op5_simhash": near_duplicates,
        "op6_tokencounts": token_counts,
        "op7_quality": quality_classifier,
        "op8_topk": exact_top_k,
        "op9_html": main_text,
        "op10_decontaminate": benchmark_leaks,
        "op11_interactions": filter_interactions,
        "op12_periodic": periodic_runs,
        "op13_setsketch": near_duplicate_sets,
    }
