"""Queries of the steps of a fold over tables: chosen substitution tables, energies of loops, tracebacks, slips, grids; their SQL is in ``step_twins``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators import brackets, loops, slips, substitutions, tracebacks
from stemloom.operators import columns as C
from stemloom.operators import pairs as P
from stemloom.operators import probabilities as B
from stemloom.sources import files
from stemloom.sources.alignments import WIDTH, cells_of
from stemloom.sources.shared import written

#: Columns of the wide alignments.
WIDE = 128


def rule_tables(spark: SparkSession) -> DataFrame:
    """Substitution tables by a rule, in every third bin of least identity only, so that the bins between fall back."""
    bins = spark.range(12, 21).select(F.col("id").cast("int").alias("max_bin"), F.explode(F.sequence(F.lit(3), F.lit(18), F.lit(3))).alias("min_bin")).where("min_bin < max_bin")
    return substitutions.by_rule(bins, (F.col("k") * 3 + F.col("l") * 5) % 7 / 2 + F.col("min_bin") / 8)


def rule_loops(spark: SparkSession) -> DataFrame:
    """Energies of small internal loops by a rule; a third of them isn't listed."""
    bases = lambda c: F.explode(F.sequence(F.lit(0), F.lit(4))).alias(c)
    rows = spark.range(1, 8).select(F.col("id").cast("int").alias("t1"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("t2"))
    for c in "abcd":
        rows = rows.select("*", bases(c))
    of = rows.select(F.explode(F.array(F.lit("1x1"), F.lit("1x2"), F.lit("2x2"))).alias("loop"), "*").where("(loop = '2x2' or d = 0) and (loop <> '1x1' or c = 0)")
    listed = of.where("(t1 + 2 * t2 + a + b + c + d) % 3 <> 0")
    return listed.withColumn("energy", F.expr("100 + 10 * t1 - 5 * t2 + 7 * a - 3 * b + 2 * c - d"))


def wide_msa(x) -> DataFrame:
    """(fam, seq, text): alignments of 128 columns, by two digests of each whole text."""
    docs = x.spark.read.parquet(f"{x.sf_dir}/documents.parquet")
    own = F.coalesce("text", F.lit(""))
    text = F.translate(F.concat(F.sha2(own, 256), F.sha2(F.concat(own, F.lit("/")), 256)), "0123456789abcdef", "AAAACCCCGGGGUU-U")
    return docs.select(F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("fam"), F.col("doc_id").alias("seq"), text.alias("text"))


def drawn_kinds(x) -> DataFrame:
    """(fam, seq, structure): the brackets of each row, in four kinds, and one more that closes nothing in every fifth row."""
    pairs = x.brackets.withColumn("kind", (F.col("i") + F.col("j") * 3 + F.col("i") * F.col("seq")) % 4)
    text = B.drawn(pairs, x.cells.select("fam", "seq", "col"), "fam", "seq", kind="kind")
    return text.select("fam", "seq", F.when(F.col("seq") % 5 == 0, F.concat("structure", F.lit("}"))).otherwise(F.col("structure")).alias("structure"))


def traced(x) -> DataFrame:
    back = P.best_states(x.pairable).select("fam", "j", "i")
    return tracebacks.traced(back, x.spine.groupBy("fam").agg(F.min("col").alias("lo"), F.max("col").alias("hi")), WIDTH)


def file_names(x) -> DataFrame:
    """(fam, name): names with numbers of unlike lengths in them."""
    return x.msa.select("fam", F.concat(F.lit("k_"), (F.col("seq") * 7) % 120, F.when(F.col("seq") % 2 == 0, F.concat(F.lit("_00"), F.col("seq"))).otherwise(F.lit("")), F.lit(".fasta")).alias("name")).distinct()


def naturally(names: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return names.select("fam", "name", F.row_number().over(Window.partitionBy("fam").orderBy(files.natural("name"))).alias("place"))


def _small_loops(x) -> DataFrame:
    cells = cells_of(x.small, "fam")
    near = P.enclosing(written(P.pairable(P.scored(P.pair_counts(x.small)), -400)), C.cumulative_occupancy(cells), 6)
    return loops.loop_energies(cells, near, rule_loops(x.spark))


def _slip_hits(x) -> DataFrame:
    hits = slips.matched_slips(x.partners, x.gold).groupBy("fam").agg(F.count("*").alias("hit"))
    whole = x.partners.groupBy("fam").agg(F.count("*").alias("predicted"))
    return whole.join(hits, "fam", "left").select("fam", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), "predicted")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


OPERATORS: dict[str, Callable] = {
    "substitution_choice": lambda x: substitutions.chosen(C.identity_bins(x.msa), rule_tables(x.spark)),
    "pscore_by_identity": lambda x: substitutions.scored(x.counts, substitutions.matrices(x.msa, rule_tables(x.spark))),
    "loop_energies": _small_loops,
    "loop_sums": lambda x: loops.loop_totals(x.msa, P.enclosing(written(x.pairable), x.upto, 6), rule_loops(x.spark)),
    "special_hairpins": lambda x: loops.special_loops(x.cells),
    "bracket_closings": lambda x: brackets.closing_pairs(drawn_kinds(x)),
    "traceback_pairs": lambda x: traced(x).select("fam", "i", "j", "level"),
    "traceback_hits": lambda x: _rounded(tracebacks.expected(traced(x), x.bpp)),
    "slip_hits": _slip_hits,
    "eval_slip": lambda x: _rounded(slips.compared(x.partners, x.gold, x.spine)),
    "gamma_grid": lambda x: _rounded(B.expected_correlations(x.bpp, x.spine)),
    "best_gamma": lambda x: _rounded(B.best_gammas(B.expected_correlations(x.bpp, x.spine))),
    "natural_order": lambda x: naturally(file_names(x)),
    "beam_prefix_topk": lambda x: P.beam(P.with_prefix(x.pairable), 5, F.round(F.col("prefix") + F.col("pscore"), 6)),
    "wide_pscore_pairs": lambda x: P.pairable(P.scored(P.pair_counts(wide_msa(x)))),
}
