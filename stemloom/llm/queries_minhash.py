"""op2: near-duplicate groups of all documents."""

from stemloom.llm.minhash import near_duplicates
from stemloom.llm.store import table


def op2_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=3, percent=85)


def dedup_sql(docs: str, words_each: int, percent: int) -> str:
    """All links by a join of the shingles, and their closure."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least({words_each}, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - least({words_each}, len(w)) + 2 AS BIGINT))) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
rare AS (SELECT s FROM shingle GROUP BY s HAVING count(*) > 1),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingle a JOIN rare USING (s) JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * k >= {percent} * (x.n + y.n - k)),
way AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT r.a, w.v FROM reach r JOIN way w ON r.b = w.u)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM {docs} d LEFT JOIN size s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n
"""


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
SQL = {"op2_minhash_dedup": dedup_sql("documents", 3, 85)}
