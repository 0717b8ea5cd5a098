"""Token counts as delta-maintained rollups.

A store keeps totals of documents, tokens and characters by source, language and tokenizer version. It takes
batches of changes: inserts, deletes and revised counts. A batch is turned into signed rows, what is
taken back and what is added for every document and tokenizer it touches; their sums are the batch's
delta of the totals. Totals are the sum of the deltas, never a recount.

    <store>/batch=<id>/rows      signed rows (doc_id, tokenizer, source, lang, tokens, chars, sign)
    <store>/batch=<id>/delta     their sums by source, lang, tokenizer
    <store>/batch=<id>/done      written last: the batch counts from here on

A batch without its last part does not exist for readers, so a commit that broke off leaves nothing
behind and is simply run again; a batch id that is committed already is left alone, so that a batch
delivered twice counts once.

Changes have columns (op, doc_id, tokenizer, source, lang, tokens, chars); op is ``insert``, ``revise`` or
``delete``. Defined results: an insert of a known document and tokenizer, and a revision of an unknown
one, mean the same: it now has these counts. A delete of an unknown one does nothing; a delete with a null
tokenizer takes all of the document's. Of several changes of one document and tokenizer in a batch, the
one with the largest ``seq`` holds, if there is such a column; otherwise a delete after all, and the
largest counts of the others. Null doc_id, source and lang are values like others; null tokens and chars
count 0; rows with an unknown op are refused. Empty batches are committed and change nothing. Other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesops.llm.common import word_count

KEYS = ["source", "lang", "tokenizer"]
_ROWS = "doc_id long, tokenizer string, source string, lang string, tokens long, chars long, sign int"
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _part(self, batch: str, part: str) -> str:
        return f"{self.path}/batch={batch}/{part}"

    def committed(self) -> list[str]:
        """Ids of the batches that count; one small file tells of each."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/done/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(f.getPath().getParent().getParent().getName().removeprefix("batch=") for f in found)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [self._part(b, part) for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read("rows", _ROWS)

    def current(self) -> DataFrame:
        """Rows (doc_id, tokenizer, source, lang, tokens, chars) of what the store holds now.

        For each document and tokenizer there is at most one state whose signs do not cancel out.
        """
        state = ["doc_id", "tokenizer", "source", "lang", "tokens", "chars"]
        return self.rows().groupBy(*state).agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was there already."""
        if self._exists(self._part(batch, "done/_SUCCESS")):
            return False
        signed = self._signed(_latest(changes))
        signed.write.mode("overwrite").parquet(self._part(batch, "rows"))
        signed = self.spark.read.schema(_ROWS).parquet(self._part(batch, "rows"))
        delta = signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"),
            F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("chars")).alias("chars"),
        )
        delta.coalesce(1).write.mode("overwrite").parquet(self._part(batch, "delta"))
        self.spark.range(0).write.mode("overwrite").parquet(self._part(batch, "done"))
        return True

    def _signed(self, changes: DataFrame) -> DataFrame:
        """What the changes take back of the current state, and what they add."""
        touched = changes.select(F.col("doc_id").alias("of"), F.col("tokenizer").alias("by"))
        held = self.current()
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("by").isNull() | (F.col("tokenizer") == F.col("by")))
        back = held.join(touched, same, "left_semi").withColumn("sign", F.lit(-1))
        added = changes.filter("op != 'delete'").withColumn("sign", F.lit(1))
        columns = ["doc_id", "tokenizer", "source", "lang", "tokens", "chars", "sign"]
        return back.select(*columns).unionByName(added.select(*columns))

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, documents, tokens, chars) from the deltas alone."""
        summed = self._read("delta", _DELTA).groupBy(*KEYS)
        total = summed.agg(*[F.sum(c).alias(c) for c in ("documents", "tokens", "chars")])
        return total.filter("documents != 0 OR tokens != 0 OR chars != 0")


def _latest(changes: DataFrame) -> DataFrame:
    """One change for each document and tokenizer."""
    known = F.col("op").isin("insert", "revise", "delete")
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    order: list[Column] = [F.desc("seq")] if "seq" in changes.columns else []
    rows = changes.select(
        F.when(known, F.col("op")).otherwise(wrong.cast("string")).alias("op"),
        F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang",
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "chars")],
        *(["seq"] if order else []),
    )
    order += [F.col("op") != "delete", F.desc("tokens"), F.desc("chars"), "source", "lang"]
    last = F.row_number().over(Window.partitionBy("doc_id", "tokenizer").orderBy(*order))
    return rows.withColumn("n", last).filter("n = 1").drop("n", "seq")


# Tokenizer versions that need nothing but a pattern.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "ascii-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"}


def counted(docs: DataFrame, op: str, text: str = "text", tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """Changes with the counts of a text column by every tokenizer version; null text counts 0."""
    counts = [
        F.struct(
            F.lit(name).alias("tokenizer"),
            (word_count(text) if name == "words-1" else F.regexp_count(F.col(text), F.lit(pattern)))
            .cast("long").alias("tokens"),
        )
        for name, pattern in tokenizers.items()
    ]
    rows = docs.select(
        F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
        F.length(text).cast("long").alias("chars"), F.explode(F.array(*counts)).alias("t"),
    )
    return rows.select("op", "doc_id", "t.tokenizer", "source", "lang", "t.tokens", "chars")
