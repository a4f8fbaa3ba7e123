"""Queries that fold the alignments derived from documents. SQL can't express the sweep; tests hold it against known results and all structures of short alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators.folding import Model, counters, ensemble, evaluated, fold, pair_probabilities, projections, samples
from stemloom.sources.alignments import document_msa
from stemloom.sources.sinks import probability_lines, report


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_msa(spark, sf_dir).withColumnRenamed("fam", "msa")


def mfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fold(alignments(spark, sf_dir))
    return found.select("msa", "structure", *(F.round(x, 4).alias(x) for x in ("mfe", "energy", "covariation")))


def mfe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fold(alignments(spark, sf_dir))
    return found.select("msa", report(found).alias("report"))


def mfe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(alignments(spark, sf_dir), Model(beam=0)).select("msa", "structure", F.round("mfe", 4).alias("mfe"))


def mfe_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(alignments(spark, sf_dir), Model(by_columns=True)).select("msa", "structure", F.round("mfe", 4).alias("mfe"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_probabilities(alignments(spark, sf_dir)).select("msa", "i", "j", F.round("prob", 6).alias("prob"))


def probability_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_lines(pair_probabilities(alignments(spark, sf_dir)))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(alignments(spark, sf_dir))


def best_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(alignments(spark, sf_dir), Model(gamma=0)).select("msa", "gamma", F.round("pmcc", 6).alias("pmcc"), "centroid", "mea")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(alignments(spark, sf_dir), count=10, seed=1)


def on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    msa = alignments(spark, sf_dir)
    return projections(msa, fold(msa))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best structure of each alignment against the hairpin it descends from, with ends off by one allowed."""
    gold = F.concat(F.lit("(" * 14), F.lit("." * 4), F.lit(")" * 14))
    return evaluated(fold(alignments(spark, sf_dir)).select("msa", gold.alias("gold"), F.col("structure").alias("predicted")), slip=True)


def lazy_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_probabilities(alignments(spark, sf_dir), Model(lazy=True)).select("msa", "i", "j", F.round("prob", 6).alias("prob"))


def sweep_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(alignments(spark, sf_dir), Model(beam=20))


QUERIES = {"fold_lazy_probabilities": lazy_probabilities, "fold_counters": sweep_counters, "fold_mfe": mfe, "fold_mfe_report": mfe_report, "fold_mfe_exact": mfe_exact, "fold_mfe_by_columns": mfe_by_columns, "fold_probabilities": probabilities, "fold_probability_file": probability_file, "fold_structures": structures, "fold_best_correlation": best_correlation, "fold_samples": sampled, "fold_on_rows": on_rows, "fold_agreement": agreement}
