"""Personal data: patterns, and terms that give away what the patterns find.

The base finds e-mail addresses, IP addresses, card and phone numbers. Blanking them is not enough
where a word of the same document tells who is meant. So the corpus is asked how much a term t in the
documents of a protected entity e (one found value) says about it: the share of e's information that t
discloses is PMI(e; t) / IC(e) = 1 - log p(e|t) / log p(e), from document counts. From a threshold on
the term is generalised to its kind, from a higher one it is removed.

All of it is DataFrame expressions; positions come from what stands between the matches of a
pattern, summed up. Text itself is never shuffled: only words of documents with found values and counts
of words are.

Defined results: a null text is empty and has no spans; starts and ends count code points, the end is
exclusive; a kind's spans do not overlap each other, spans of different kinds may. Rows that repeat
get the same spans each. An empty table gives no rows. Other columns stay out of the search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import written

# The kinds, in order, and what they look like. The possessive quantifiers and the
# looks behind find the same as their plain forms, in linear time on long runs of one class.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character without which a text has no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "term"
_WORDS = r"[\p{L}\p{N}]+"
_CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(steps: Column, base: Column) -> Column:
    """Sums of all steps before each, plus the base, for a short array."""
    start = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
    summed = F.aggregate(
        steps,
        start,
        lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )
    return summed["all"]


def _starts(steps: Column) -> Column:
    """Sums of all steps before each. Chunks are summed first, so that long arrays stay cheap."""

    def chunk(steps: Column, i: Column) -> Column:
        return F.slice(steps, i * _CHUNK + 1, _CHUNK)

    def by_chunk(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
        sums = F.transform(numbers, lambda i: F.aggregate(chunk(steps, i), F.lit(0), lambda a, s: a + s))
        return F.flatten(
            _let(
                _running(sums, F.lit(0)),
                lambda bases: F.transform(bases, lambda base, i: _running(chunk(steps, i), base)),
            )
        )

    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(by_chunk(steps))


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value), by code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(parts: Column) -> Column:
        found, between = parts["found"], F.slice(parts["between"], 1, F.size(parts["found"]))
        steps = F.zip_with(between, found, lambda b, f: F.length(b) + F.length(f))
        gaps = F.transform(between, lambda b: F.length(b))
        both = F.arrays_zip(_let(steps, _starts).alias("at"), gaps.alias("gap"), found.alias("value"))
        return F.transform(
            both,
            lambda m: F.struct(
                (m["at"] + m["gap"]).alias("start"),
                (m["at"] + m["gap"] + F.length(m["value"])).alias("end"),
                m["value"].alias("value"),
            ),
        )

    return _let(F.struct(found.alias("found"), between.alias("between")), placed)


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digits of the results add up to tens."""

    def value(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
        return F.forall(F.split(value, r"\."), lambda p: small(p) & (F.substring(p, -3, 3).cast("int") <= 255))
    if kind == "card":
        count = F.length(_digits(value))
        return F.when(count.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans_of(kind: str, found: Column) -> Column:
    kept = F.filter(found, lambda m: _holds(kind, m["value"]))
    spans = F.transform(
        kept,
        lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")
        ),
    )
    return spans.cast(_SPANS)


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end, value) of all kinds, kind by kind, each in order of its start."""
    parts = []
    for kind, pattern in PATTERNS.items():
        spans = _spans_of(kind, matches(text, pattern))
        none = F.array().cast(_SPANS)
        if _NEEDS[kind]:
            spans = F.when(text.contains(_NEEDS[kind]), spans).otherwise(none)
        else:
            spans = F.when(text.rlike(pattern), spans).otherwise(none)
        parts.append(spans)
    return F.concat(*parts)


def entity(span: Column) -> Column:
    """What is protected: the kind and the value without its dressing."""
    bare = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.regexp_replace(span["value"], r"[^0-9.]", "")
    )
    return F.concat_ws(":", span["kind"], bare)


def _terms(text: Column, spans: Column, min_chars: int) -> Column:
    """Words (term, start, end, value) of a text outside of its base spans."""
    words = F.filter(
        matches(text, _WORDS),
        lambda w: (F.length(w["value"]) >= min_chars)
        & ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
    )
    return F.transform(
        words,
        lambda w: F.struct(
            F.lower(w["value"]).alias("term"), w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"),
            w["value"].alias("value"),
        ),
    )


def _key(docs: DataFrame) -> list[Column]:
    """Tells rows apart as far as their spans can differ."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_key")]


def find(
    docs: DataFrame,
    min_chars: int = 4,
    min_docs: int = 3,
    generalise_from: float = 0.9,
    remove_from: float = 0.97,
) -> DataFrame:
    """Rows (doc_id, text_key, spans, terms): base spans, and terms (start, end, value, removed).

    A term is a word of at least ``min_chars`` outside of all base spans, anywhere in a document that
    has some. It is judged by each entity of the document, if the two share at least ``min_docs``
    documents and not only copies of one text. What is judged is marked wherever it stands in the
    documents that hold the entity.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*_key(docs), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    none = F.array().cast("array<struct<term:string,start:int,end:int,value:string>>")
    words = F.when(F.size("spans") > 0, _terms(F.col("text"), F.col("spans"), min_chars)).otherwise(none)
    rows = written(rows.withColumn("words", words).select("doc_id", "text_key", "spans", "words"), "pii-spans")
    found = rows.filter(F.size("spans") > 0)
    # By distinct texts, each with the number of its rows; a document counts once for a pair.
    holds = found.select("text_key", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    holds = written(holds.groupBy("text_key", "entity").agg(F.count("*").alias("copies")), "pii-entities")
    # A pair is in no more documents than its entity.
    often = holds.groupBy("entity").agg(F.sum("copies").alias("entity_docs")).filter(F.col("entity_docs") >= min_docs)
    often = written(holds.join(often.select("entity"), "entity"), "pii-often")
    held = found.join(often.select("text_key").distinct(), "text_key", "left_semi")
    terms = held.select("text_key", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    together = often.join(terms.distinct(), "text_key").groupBy("entity", "term")
    together = together.agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    asked = together.filter((F.col("both") >= min_docs) & (F.col("texts") > 1)).drop("texts")
    judged = written(_judged(docs, rows, written(asked, "pii-pairs"), generalise_from, remove_from), "pii-terms")
    marked = often.join(judged, "entity").groupBy("text_key", "term").agg(F.max("removed").alias("removed"))
    places = held.select("text_key", F.explode("words").alias("w")).select("text_key", "w.*").distinct()
    hits = places.join(marked, ["text_key", "term"])
    terms = hits.groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "value", "removed"))).alias("terms")
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string,removed:boolean>>")
    return rows.join(terms, "text_key", "left").select(
        "doc_id", "text_key", "spans", F.coalesce("terms", empty).alias("terms")
    )


def _judged(docs: DataFrame, rows: DataFrame, asked: DataFrame, low: float, high: float) -> DataFrame:
    """Rows (entity, term, removed) of the pairs that disclose too much, by counts over all documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    held = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    entities = rows.select(
        F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")
    ).groupBy("entity").agg(F.count("*").alias("entity_docs"))
    total = F.lit(float(max(rows.count(), 1)))
    given = F.least(F.col("both") / F.col("term_docs"), F.lit(1.0))
    alone = F.col("entity_docs") / total
    share = F.when(alone < 1, 1 - F.log(given) / F.log(alone)).otherwise(F.lit(0.0))
    judged = asked.join(held, "term").join(entities, "entity").withColumn("share", share)
    return judged.filter(F.col("share") >= low).select("entity", "term", (F.col("share") >= high).alias("removed"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents with column ``clean_text``: values replaced by their kind, terms generalised or removed.

    Where spans overlap, the one that starts first stands for both.
    """
    found = find(docs, **options).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_key"), "spans", "terms")
    keyed = docs.withColumn("_text_key", _key(docs)[1])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_of")) & (F.col("_text_key") == F.col("_key"))
    edits = F.concat(
        F.transform(
            found["spans"],
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"),
            ),
        ),
        F.transform(
            found["terms"],
            lambda t: F.struct(
                t["start"].alias("start"), t["end"].alias("end"),
                F.when(t["removed"], "").when(t["value"].rlike("[0-9]"), "[NUMBER]")
                .when(t["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]").alias("put"),
            ),
        ),
    )
    text = F.coalesce(docs["text"], F.lit(""))

    def applied(edits: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = F.aggregate(
            edits,
            start,
            lambda a, e: F.when(e["start"] < a["at"], a).otherwise(
                F.struct(
                    e["end"].alias("at"),
                    F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["put"]).alias("out"),
                )
            ),
        )
        return _let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))

    joined = keyed.join(found, same, "left").withColumn("clean_text", applied(F.array_sort(edits)))
    return joined.drop("_text_key", "_of", "_key", "spans", "terms")


def written_out(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """One row per document with the numbers of base spans, their digest, and all spans."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS
    ]
    base = written_out(F.col("spans"))
    terms = F.transform(
        "terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))
    )
    extra = written_out(terms)
    both = F.concat(base, F.when((base != "") & (extra != ""), ",").otherwise(""), extra)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))
