"""Tracebacks as recursive queries over tables of back-pointers.

``back`` is (fam, j, i): for each end column, the column that its best pair begins
in. An interval of columns is traced from its right end: if the end's pair begins
inside it, that pair stands and what lies inside and what lies before it are
traced; else the end stays free. Each level of the recursion is one join of the
open intervals with the table, so its work follows the structure. The table has a
row a column, not a row an interval, and is written first, as each level reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.sources.shared import written

#: Columns between the ends of a pair, one more.
APART = 4


def traced(back: DataFrame, whole: DataFrame, levels: int) -> DataFrame:
    """(fam, i, j, level) of the pairs that are traced from the intervals (fam, lo, hi) of ``whole``; ``levels`` bounds the depth: the columns of the widest interval are enough.

    An interval that has no back-pointer at its end loses that column; an error if the depth isn't enough.
    """
    spark = back.sparkSession
    tip = "b.i IS NOT NULL AND b.i >= w.lo"
    inner, outer = "named_struct('lo', b.i + 1, 'hi', w.hi - 1)", "named_struct('lo', w.lo, 'hi', b.i - 1)"
    query = f"""
WITH RECURSIVE walk(fam, lo, hi, level) MAX RECURSION LEVEL {int(levels)} AS (
  SELECT fam, CAST(lo AS INT), CAST(hi AS INT), 0 FROM {{whole}}
  UNION ALL
  SELECT fam, n.lo, n.hi, level + 1 FROM (
    SELECT w.fam, w.level, explode(CASE WHEN {tip} THEN array({inner}, {outer}) ELSE array(named_struct('lo', w.lo, 'hi', w.hi - 1)) END) AS n
    FROM walk w JOIN {{back}} b ON w.fam = b.fam AND w.hi = b.j) WHERE n.hi - n.lo >= {APART})
SELECT w.fam, b.i, b.j, w.level FROM walk w JOIN {{back}} b ON w.fam = b.fam AND w.hi = b.j WHERE {tip}"""
    every = whole.select("fam", F.explode(F.sequence("lo", "hi")).alias("j"))
    full = every.join(back.select("fam", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i")), ["fam", "j"], "left").select("fam", "j", "i")
    full, whole = written(full), written(whole.select("fam", "lo", "hi"))
    return spark.sql(query, whole=whole.where(f"hi - lo >= {APART}"), back=full)


def expected(pairs: DataFrame, bpp: DataFrame) -> DataFrame:
    """(fam, pairs, hits): how many pairs a traceback found, and how many of them are expected to be right."""
    met = pairs.select("fam", "i", "j").join(bpp.select("fam", "i", "j", "prob"), ["fam", "i", "j"], "left")
    return met.groupBy("fam").agg(F.count("*").alias("pairs"), F.sum(F.coalesce("prob", F.lit(0.0))).alias("hits"))
