from __future__ import annotations

import corpus_pipeline
from checks.queries import queries as other_queries
from salesops.llm import decontaminate, quality, simhash
from salesops.llm.common import table, written
from salesops.llm.queries import queries, tokenizer_path
from tests.llm.test_simhash import plain_groups, plain_print
from tests.llm.test_simple8b import expected


def test_every_stage_against_a_plain_version(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    held = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, quality.ratings_of(table(spark, small, "labels")), quality.GRADES)
    good = {r["doc_id"] for r in quality.score(docs, model, 2).collect() if r["p_good"] >= 0.5}
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(written(stage(spark, after[-1], small), "test-stage"))
    ids = [[r["doc_id"] for r in a.collect()] for a in after]
    assert sorted(ids[1]) == sorted(good)
    groups = plain_groups({i: plain_print(held[i]["text"]) for i in ids[1]}, 2)
    assert sorted(ids[2]) == sorted(set(groups.values()))
    items = [decontaminate.normal(r["text"]) for r in table(spark, small, "benchmark").collect()]
    assert not any(item in decontaminate.normal(held[i]["text"]) for item in items for i in ids[3])
    assert set(ids[3]) <= set(ids[2])
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 2
    assert all(a.columns == columns for a in after[:-1])
    from tokenizers import Tokenizer

    rows = sorted(after[-1].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids[4])
    plain = expected({i: held[i]["text"] for i in set(ids[4])}, Tokenizer.from_file(tokenizer_path()))
    assert all((r["n_tokens"], r["ids_crc32"]) == plain[r["doc_id"]][1:] for r in rows)
    assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
    assert rows and corpus_pipeline.run(spark, small).count() == len(rows)


def test_odd_rows_pass_every_stage(spark, odd, no_docs, small):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small), "odd-stage")
        docs.count()


def test_registered(spark):
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert set(queries()) | {"pipeline"} | set(other_queries()) == names
    assert set(driver.oracle_sql()) <= names
    assert simhash.SEED == 42
