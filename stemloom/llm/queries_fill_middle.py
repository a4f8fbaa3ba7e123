"""op11: all documents as fill-in-the-middle examples, and the texts rebuilt from them."""

from pyspark.sql import functions as F

from stemloom.llm.fill_middle import fill_in_middle, restored
from stemloom.llm.store import table

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")


def op11_fill_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    return restored(made).select(*COLUMNS, F.sha2("restored", 256).alias("restored_sha256"))


_NUMBER = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
SQL = {
    "op11_fill_middle": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, {", ".join(f"{_NUMBER.format(at=1 + 8 * k)} AS h{k + 1}" for k in range(4))} FROM texts),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""
}
QUERIES = {"op11_fill_middle": op11_fill_middle}
