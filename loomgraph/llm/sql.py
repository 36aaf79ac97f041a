"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _entities(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"


OP4 = f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ranked AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(4 + sum(length({_entities("text")}) + CASE WHEN rn = 1 THEN 5 + length({_entities("role")}) WHEN prev = role THEN 3 ELSE 9 + length({_entities("role")}) END) AS BIGINT) AS formatted_chars
FROM ranked GROUP BY conv_id
"""


def _level(name: str, source: str, parents: str, node: str, keys: str, weight: str) -> str:
    part = f"PARTITION BY {parents}, given"
    return f"""
{name}_n AS (
  SELECT {keys}, 0 AS r, {weight} AS weight, sum(capacity) AS capacity FROM leaves GROUP BY {keys}
), {name}_a AS (
  SELECT n.*, p.given, (p.given - coalesce(sum(capacity) OVER (PARTITION BY {", ".join("p." + c.strip() for c in parents.split(","))} ORDER BY CAST(capacity AS DOUBLE) / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (PARTITION BY {", ".join("p." + c.strip() for c in parents.split(","))} ORDER BY CAST(capacity AS DOUBLE) / weight, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM {name}_n n JOIN {source} p USING ({parents})
), {name} AS (
  SELECT r, {keys}, CAST(CASE WHEN CAST(capacity AS DOUBLE) / weight <= lvl THEN capacity
    ELSE greatest(0, floor(max(CASE WHEN CAST(capacity AS DOUBLE) / weight > lvl THEN lvl END) OVER ({part}) * weight)) END AS BIGINT) AS given
  FROM {name}_a
)"""


OP5 = f"""
WITH docs AS (
  SELECT doc_id, 'domain' || (coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 3 AS BIGINT) AS capacity FROM docs GROUP BY 1, 2, 3
), root AS (SELECT 0 AS r, CAST(floor(sum(tokens) * 3 / 5) AS BIGINT) AS given FROM leaves),
{_level("a", "root", "r", "domain", "domain", "1 + CAST(substring(domain, 7) AS INT)")},
{_level("b", "a", "r, domain", "lang", "domain, lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level("c", "b", "r, domain, lang", "source", "domain, lang, source", "1 + length(source) % 3")},
planned AS (
  SELECT domain, lang, source, given // tokens AS whole, given % tokens AS part FROM c JOIN leaves USING (domain, lang, source) WHERE tokens > 0
), placed AS (SELECT * FROM docs JOIN planned USING (domain, lang, source)),
partial AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13], doc_id) AS reached
  FROM placed WHERE part > 0
)
SELECT doc_id, domain, lang, source, CAST(e.epoch AS BIGINT) AS epoch, n_tokens FROM placed, LATERAL (SELECT unnest(range(whole)) AS epoch) e
UNION ALL
SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM partial WHERE reached <= part
"""

#: Base 32 of a SHA-1: ten hex digits at a time, as numbers g0 to g3, are eight letters each.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g{p} >> {35 - 5 * i}) & 31 AS INT) + 1, 1)" for p in range(4) for i in range(8)
)

OP7 = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
parts AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {1 + 10 * p}, 10) AS BIGINT) AS g{p}" for p in range(4))} FROM hashed),
named AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM parts),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

ORACLES = {"op4_chat_format": OP4, "op5_source_mixing": OP5, "op7_warc_revisits": OP7}
