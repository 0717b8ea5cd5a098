from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from checks.compare import connect, differences
from salesops.llm import pii
from salesops.llm.oracle import oracle_sql
from salesops.llm.queries import personal_data
from tests.llm.conftest import ODD

# The kinds in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in value.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        total = sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text: str) -> list[str]:
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if holds(kind, m.group())
    ]


TRICKY = [
    "a@b.c%d@e.f x@y z@w. @a.b a.b@c-d.e.f, ü@x.y _@-.-",
    "1.2.3.4.5.6.7.8 999.1.2.3 1.2.3.256 0001.02.3.4 1.2.3 10.0.0.1.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000 12345678901234567890 5 5 5",
    "+49 (30) 123-4567-89. +1 2 +12 +1234567890123456 ++4912345678901 +4 9 1 2 3 4 5 6 7 8 (",
    "tel +1 (555) 010-9999 ip 127.0.0.1 mail Jörg.ö@x.de 😀 me@x.org card 4012888888881881",
    "",
    "x" * 5000 + "@" + "y" * 3000,
    "1" * 40_000 + ".2" * 3,
    "a@b" + ".c" * 20_000,
    " ".join(f"u{i}@mail{i}.org" for i in range(1500)),
]


@pytest.fixture(scope="module")
def tricky(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}


@pytest.mark.parametrize("i", range(len(TRICKY)))
def test_spans_match_the_plain_patterns(tricky, i):
    wanted = ",".join(plain_spans(TRICKY[i]))
    found = ",".join(s for s in tricky[i]["spans"].split(",") if s and not s.startswith("term"))
    assert found == wanted
    assert tricky[i]["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()


def test_whole_table(spark, small, texts):
    rows = personal_data(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(w.startswith(kind + ":") for w in wanted)
        extra = [s for s in r["spans"].split(",") if s.startswith("term")]
        assert wanted or not extra


def people(spark):
    """Everybody writes of the weather; only one person's mail stands beside the word zanzibarist."""
    docs = [
        (i, f"the weather was {('fine', 'cold', 'warm', 'wet')[i % 4]} when Zanzibarist{' again' * (i % 3)} wrote from z.one@mail.org today")
        for i in range(6)
    ]
    docs += [(100 + i, f"the weather was fine when person number{i} wrote from p{i}@mail.org today") for i in range(60)]
    docs += [(200 + i, "nobody wrote anything and the weather was fine") for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_terms_that_give_an_entity_away(spark):
    docs = people(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    terms = {}
    for r in pii.find(docs).collect():
        terms[r["doc_id"]] = {text[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]}
    assert all("Zanzibarist" in terms[i] for i in range(6))
    assert not any(word in t for t in terms.values() for word in ("weather", "wrote", "today"))
    assert not any(terms[i] for i in range(200, 260))
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "z.one" not in clean[0] and "Zanzibarist" not in clean[0]
    assert clean[200] == text[200]


def test_matches_sql(spark, small, tmp_path):
    assert differences(personal_data(spark, small), connect(small), oracle_sql()["op3_pii"]) == []
    docs = people(spark).unionByName(spark.createDataFrame(list(enumerate(TRICKY[:6], 900)), "doc_id long, text string"))
    docs = docs.unionByName(docs.limit(20)).cache()
    docs.write.parquet(str(tmp_path / "documents"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    found = pii.digest(pii.find(docs))
    assert found.filter("spans LIKE '%term%'").count() >= 6
    assert differences(found, connection, oracle_sql()["op3_pii"]) == []


def test_copies_alone_give_nothing_away(spark):
    docs = [(i, "Quibbledash may be reached at q@mail.org from noon") for i in range(30)]
    docs += [(100 + i, f"plain text number{i}") for i in range(50)]
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string"))
    assert not any(r["terms"] for r in found.collect())


def test_odd_rows(spark, odd, no_docs):
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == len(ODD)
    assert {r["spans"] for r in rows} == {""}
    assert pii.digest(pii.find(no_docs)).count() == 0
    assert pii.sanitise(odd).count() == len(ODD)


def test_terms_far_from_the_value(spark):
    """The name stands 400 characters away from the address, and again, and a constant signature counts."""
    far = "plain words that anybody may write about anything at all " * 8
    docs = [(i, f"Zanzibarist number{i} begins. {far} write to z.one@mail.org now. {far} So says zanzibarist, Quillon") for i in range(4)]
    docs += [(100 + i, f"other{i} {far} write to p{i}@mail.org now. {far}") for i in range(60)]
    docs += [(200, "Zanzibarist wrote of z.two@mail.org here"), (201, "nothing of anybody")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: [text[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]] for r in pii.find(docs).collect()}
    # One in five documents with the name is another's, which still gives 0.92 of the address away.
    assert all({"Zanzibarist", "zanzibarist", "Quillon"} <= set(found[i]) for i in range(4))
    assert not {"plain", "write", "anybody"} & set(found[0])
    assert not any(found[i] for i in (*range(100, 160), 200, 201))
