"""op6: secrets in all documents, from an empty ledger."""

from pyspark.sql import functions as F

from stemloom.llm.secrets import RULES, findings, scan, versions_of
from stemloom.llm.store import table


def op6_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = findings(versions_of(docs), scan(docs))
    line = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("path").alias("doc_id"), *[count(r.kind) for r in RULES], F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))


def _positions(kind: str, rank: int, pattern: str, group: int, least: int, options: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s AS b, s + length(m) AS e FROM (
  SELECT doc_id, p, m, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(ps) AS p, unnest(range(1, CAST(len(ms) + 1 AS BIGINT))) AS k, gaps, ms FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}', 0{options}) AS ms, regexp_extract_all(t, '{p}', {group}{options}) AS ps, regexp_split_to_array(t, '{p}'{options}) AS gaps FROM texts)))
WHERE length(p) >= {least}"""


_PARTS = " UNION ALL ".join([
    _positions("assign", 0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ", 'i'"),
    _positions("access", 1, "AKIA[A-Z0-9]+", 0, 16, ""),
    _positions("hex", 2, "[0-9a-f]+", 0, 32, ""),
])
SQL = {
    "op6_secret_scan": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_PARTS}),
lines AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lines USING (doc_id)
"""
}
QUERIES = {"op6_secret_scan": op6_secret_scan}
