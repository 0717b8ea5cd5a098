"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# The kinds of personal data, their patterns, and when a match is one.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    (
        "ip",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "list_bool_and([len(ltrim(p, '0')) <= 3 AND right(p, 3)::INT <= 255 FOR p IN string_split(value, '.')])",
    ),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        """len(digits) BETWEEN 13 AND 19 AND list_sum([
          CASE WHEN i % 2 = 1 THEN digits[-i]::INT WHEN digits[-i]::INT > 4 THEN digits[-i]::INT * 2 - 9
          ELSE digits[-i]::INT * 2 END FOR i IN range(1, len(digits) + 1)]) % 10 = 0""",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
)


def _placed(text: str, pattern: str) -> str:
    """A list of (s, e, value) of all matches: what stands between them, summed up."""
    found, between = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    before = "list_sum([len(x) FOR x IN g[1:i]]) + coalesce(list_sum([len(x) FOR x IN f[1:i - 1]]), 0)"
    return f"""(SELECT list({{'s': s, 'e': s + len(value), 'value': value}} ORDER BY s) FROM (
      SELECT unnest([({before})::BIGINT FOR i IN range(1, len(f) + 1)]) AS s, unnest(f) AS value
      FROM (SELECT {found} AS f, {between} AS g)))"""


def _personal_data() -> str:
    """Patterns; then terms in the 48 characters around a value, judged by counts of documents."""
    kinds = " UNION ALL ".join(
        f"""SELECT rid, {k} AS k, '{kind}' AS kind, m.s, m.e, m.value FROM (
          SELECT rid, unnest(coalesce({_placed('text', pattern)}, [])) AS m FROM d) AS found,
          LATERAL (SELECT m.value AS value, regexp_replace(m.value, '[^0-9]', '', 'g') AS digits) AS v
        WHERE {holds}"""
        for k, (kind, pattern, holds) in enumerate(_KINDS)
    )
    word = r"[\p{L}\p{N}]+"
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), spans AS ({kinds}), entities AS (
    SELECT *, kind || ':' || CASE kind WHEN 'email' THEN lower(value) ELSE regexp_replace(value, '[^0-9.]', '', 'g') END
      AS entity
    FROM spans
), sides AS (
    SELECT rid, k, s AS place, entity, greatest(s - 48, 0) AS lo, s AS hi FROM entities
    UNION ALL
    SELECT rid, k, s, entity, e, e + 48 FROM entities
), pieces AS (
    SELECT sides.*, greatest(lo - 1, 0) AS cut,
      substring(text, greatest(lo - 1, 0) + 1, hi + 1 - greatest(lo - 1, 0)) AS piece
    FROM sides JOIN d USING (rid)
), words AS (
    SELECT rid, k, place, entity, lo, hi, cut + m.s AS s, cut + m.e AS e, m.value AS value
    FROM (SELECT *, unnest(coalesce({_placed('piece', word)}, [])) AS m FROM pieces)
), near AS (
    SELECT rid, k, place, entity, s, e, value, lower(value) AS term,
      string_agg(value, ' ') OVER (
        PARTITION BY rid, k, place ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS context
    FROM words w
    WHERE s >= lo AND e <= hi AND len(value) >= 4
      AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.rid = w.rid AND x.s < w.e AND w.s < x.e)
), pairs AS (
    SELECT entity, term, count(DISTINCT rid) AS together FROM near GROUP BY entity, term
    HAVING together >= 3 AND count(DISTINCT context) > 1
), term_counts AS (
    SELECT term, count(*) AS term_docs
    FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{word}'))) AS term FROM d) GROUP BY term
), entity_counts AS (
    SELECT entity, count(DISTINCT rid) AS entity_docs FROM entities GROUP BY entity
), judged AS (
    SELECT entity, term FROM pairs JOIN term_counts USING (term) JOIN entity_counts USING (entity),
      (SELECT count(*) AS total FROM d)
    WHERE entity_docs < total
      AND 1 - ln(least(together / term_docs, 1)) / ln(entity_docs / total) >= 0.9
), terms AS (
    SELECT rid, string_agg('term:' || s || ':' || e, ',' ORDER BY s, e) AS listed
    FROM (SELECT DISTINCT rid, s, e FROM near JOIN judged USING (entity, term)) GROUP BY rid
), base AS (
    SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS listed,
      {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _KINDS)}
    FROM spans GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in _KINDS)},
  sha256(coalesce(base.listed, '')) AS base_sha256, concat_ws(',', base.listed, terms.listed) AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN terms USING (rid)
"""


_OP6 = r"""
WITH kept AS (
    SELECT d.source, d.lang, regexp_replace(d.text, '^Released under the [^\n]*\n', '') AS text
    FROM documents d
    JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')) f USING (doc_id)
), counted AS (
    SELECT source, lang, 'words-1' AS tokenizer, coalesce(length(text), 0) AS chars,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
    FROM kept
    UNION ALL
    SELECT source, lang, 'ascii-2', coalesce(length(text), 0),
        coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')), 0)
    FROM kept
)
SELECT source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(chars)::BIGINT AS chars
FROM counted
GROUP BY source, lang, tokenizer
"""

_OP8 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


_OP11 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), failed AS (
    SELECT doc_id, part,
      (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
      + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
      + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS mask
    FROM texts JOIN firsts USING (text)
), counted AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS toxic
    FROM failed LEFT JOIN (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id) USING (doc_id)
    GROUP BY part, mask
), letters AS (
    SELECT unnest(string_split('ABCDE', '')) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
      [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier
    FROM orders, range(1, 6) AS r(step)
), counts AS (
    SELECT part, filter_order, step, bit,
      sum(CASE WHEN mask::INT & earlier::INT = 0 AND mask::INT & bit = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask::INT & earlier::INT = 0 AND mask::INT & bit > 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask::INT & earlier::INT > 0 AND mask::INT & bit > 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask::INT & earlier::INT = 0 AND mask::INT & bit > 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask::INT & earlier::INT = 0 AND mask::INT & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_pii": _personal_data(), "op6_tokencounts": _OP6, "op8_topk": _OP8, "op11_interactions": _OP11}
