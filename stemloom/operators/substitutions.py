"""Substitution tables for each alignment, chosen by its identities, and conservation scores by them.

``tables`` is (max_bin, min_bin, k, l, value): a matrix of pair codes for the bins
of an alignment's greatest and least identity, see ``columns.identity_bins``. It
has at most 20 x 20 bins of 7 x 7 values, whatever the number of alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.operators import pairs as P
from stemloom.operators.columns import identity_bins

SIDE = 7


def listed(tables: DataFrame) -> DataFrame:
    """(max_bin, used, matrix): each table as one array, row by row; entries that aren't given are 0."""
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("k") * SIDE + F.col("l")).cast("int").alias("at"), F.col("value").cast("double").alias("value"))))  # at most 49
    fit = tables.where("min_bin > 0 and k between 0 and 6 and l between 0 and 6").groupBy("max_bin", "min_bin", "k", "l").agg(F.max("value").alias("value"))
    known = fit.groupBy("max_bin", F.col("min_bin").alias("used")).agg(entries.alias("m"))
    return known.select("max_bin", "used", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("matrix"))


def chosen(bins: DataFrame, tables: DataFrame) -> DataFrame:
    """(fam, max_bin, min_bin, used): the table of an alignment's bins, or that of the next lower bin of least identity for which there is one; null if there is none."""
    there = tables.where("min_bin > 0").select("max_bin", F.col("min_bin").alias("used")).distinct()
    lower = bins.select("fam", "max_bin", "min_bin").join(there, "max_bin").where("used <= min_bin")  # at most 20 an alignment
    best = lower.groupBy("fam").agg(F.max("used").alias("used"))
    return bins.select("fam", "max_bin", "min_bin").join(best, "fam", "left")


def matrices(msa: DataFrame, tables: DataFrame) -> DataFrame:
    """(fam, matrix) of each alignment of (fam, seq, text); zeros for one whose rows are all equal or that has one row only; an error where no table fits."""
    used = chosen(identity_bins(msa), tables)
    missing = F.raise_error(F.concat(F.lit("no substitution table for the bins "), F.col("max_bin"), F.lit(", "), F.col("min_bin"))).cast("array<double>")
    found = used.join(listed(tables), ["max_bin", "used"], "left").select("fam", F.coalesce("matrix", missing).alias("matrix"))
    none = F.array(*[F.lit(0.0)] * (SIDE * SIDE))
    return msa.select("fam").distinct().join(found, "fam", "left").select("fam", F.coalesce("matrix", none).alias("matrix"))


def scored(counts: DataFrame, chosen_matrices: DataFrame, beta: float = 1.2, delta: float = 0.1) -> DataFrame:
    """(fam, i, j, pscore) of the gated pairs, each alignment by its own matrix."""
    met = P.gated(counts).join(chosen_matrices, "fam")
    return met.select("fam", "i", "j", F.round(P.conservation_score(F.col("matrix"), beta, delta), 6).alias("pscore"))


def by_rule(tables: DataFrame, value: Column) -> DataFrame:
    """(max_bin, min_bin, k, l, value) of (max_bin, min_bin), every pair of codes with a value that an expression over them gives."""
    codes = F.explode(F.sequence(F.lit(1), F.lit(SIDE - 1)))
    return tables.select("max_bin", "min_bin", codes.alias("k")).select("*", codes.alias("l")).withColumn("value", value.cast("double"))
