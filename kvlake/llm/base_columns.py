"""The columns of op4 and op10 that SQL can express, as queries of their own.

The methods of these operators (context scores, an isolation forest) have no SQL, so their
queries have none; what both return for their base definitions is held against SQL here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii, quality

SPACE = r"\x20\x09-\x0D"
#: The base patterns of op4, as its contract gives them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base(docs: DataFrame) -> DataFrame:
    return pii.pii_report(docs).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def quality_base(docs: DataFrame) -> DataFrame:
    out = quality.with_stats(docs, keep=["doc_id"])
    return out.select("doc_id", *(F.col(f"_kv_{c}").alias(c) for c in quality.COUNTS[:5]), quality.base_failed("_kv_").alias("base_failed"))


def pii_sql() -> str:
    """Matches are walked from left to right: the text of the leftmost match stands nowhere
    before it, or that place would match.  ``upto`` is what lies behind, in code points."""
    kinds = ", ".join(f"({n}, '{k}', '{p}')" for n, (k, p) in enumerate(PATTERNS.items()))
    return rf"""
WITH RECURSIVE kinds(n, kind, pattern) AS (VALUES {kinds}),
walk AS (SELECT doc_id, n, kind, pattern, coalesce(text, '') AS rest, 0 AS upto, '' AS hit, 0 AS size FROM documents, kinds
  UNION ALL SELECT doc_id, n, kind, pattern, substr(rest, place + length(m)), upto + place - 1 + length(m), m, length(m)
  FROM (SELECT *, strpos(rest, m) AS place FROM (SELECT *, regexp_extract(rest, pattern) AS m FROM walk) WHERE m <> '')),
found AS (SELECT doc_id, n, kind, upto - size AS a, upto AS b, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM walk WHERE hit <> ''),
good AS (SELECT * FROM found WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) <= 255))
  WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER) ELSE CAST(d[length(d) - i + 1] AS INTEGER) * 2 - CASE WHEN d[length(d) - i + 1] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(d) BETWEEN 8 AND 15 END)
SELECT doc_id, count(a) FILTER (kind = 'email') AS n_email, count(a) FILTER (kind = 'ip') AS n_ip, count(a) FILTER (kind = 'card') AS n_card, count(a) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY n, a), '')) AS base_sha256
FROM documents LEFT JOIN good USING (doc_id) GROUP BY doc_id"""


def quality_sql() -> str:
    w = quality.WINDOW
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
part AS (SELECT doc_id, p, array_to_string(w[p:p + {w - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) AS p FROM doc WHERE len(w) >= {w})),
again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM part) WHERE c > 1),
held AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {w})) AS q FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM doc),
twice AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^{SPACE}]') GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(twice.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(held.n, 0) AS BIGINT) AS n_repeat_words, len(w) < {quality.MIN_WORDS} OR 100 * coalesce(held.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(w) AS base_failed
FROM doc LEFT JOIN held USING (doc_id) LEFT JOIN twice USING (doc_id)"""
