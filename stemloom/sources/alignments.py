"""Alignments as tables, and alignments derived from other tables; ``files`` reads them.

``cells`` is the long form of a set of alignments: (fam, seq, col, code), one row
for each alignment, sequence and column, with nucleotide codes A 0, C 1, G 2,
U 3, other 4, gap 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 32


def normalised(text: str) -> Column:
    """Upper case, with U for T."""
    return F.replace(F.upper(F.col(text)), F.lit("T"), F.lit("U"))


def cells_of(msa: DataFrame, key: str = "msa") -> DataFrame:
    """(fam, seq, col, code) of (msa, seq, text), where ``key`` names the alignment; rows of one alignment must have equal lengths."""
    spread = msa.select(F.col(key).alias("fam"), "seq", F.posexplode(F.split("text", "")).alias("col", "c")).where("c <> ''")
    at = F.instr(F.lit("ACGU"), F.col("c"))
    return spread.select("fam", "seq", "col", F.when(F.col("c") == "-", 5).when(at > 0, at - 1).otherwise(4).cast("int").alias("code"))


def rows_of(cells: DataFrame) -> DataFrame:
    """(msa, seq, text) of (fam, seq, col, code)."""
    letter = F.substring(F.lit("ACGUN-"), F.col("code") + 1, F.lit(1))
    return cells.groupBy("fam", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", letter.alias("c")))), lambda x: x.c), "").alias("text")).select(F.col("fam").alias("msa"), "seq", "text")


def derived(rows: DataFrame) -> DataFrame:
    """(fam, seq, text), alignments from rows of the same names: a hairpin ancestor of the family, varied by the digest of each whole text."""
    half = [min(c, WIDTH - 1 - c) for c in range(WIDTH)]
    ancestor = F.lit("")
    for k in range(4):
        arms = [(h * h + 3 * h + k) % 4 for h in half]
        ancestor = F.when(F.pmod("fam", F.lit(4)) == k, "".join("ACGU"[a if c < WIDTH // 2 else 3 - a] for c, a in enumerate(arms))).otherwise(ancestor)
    digits = F.split(F.md5(F.coalesce("text", F.lit("")).cast("binary")), "")
    varied = F.zip_with(digits, F.split(ancestor, ""), lambda d, a: F.when(d == "d", "-").when(d == "c", F.translate(a, "ACGU", "CGUA")).otherwise(a))
    return rows.select("fam", "seq", F.array_join(varied, "").alias("text"))


def document_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fam, seq, text): one alignment a source, one sequence a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return derived(docs.select(F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("fam"), F.col("doc_id").alias("seq"), "text"))


def nation_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment a region, one sequence a nation: small alignments, for operators on pairs of sequences."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return derived(rows.select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("text")))


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(document_msa(spark, sf_dir), "fam")
