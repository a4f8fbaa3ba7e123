"""All queries of the library over the driver's tables, and SQL for DuckDB that says what they must return.

The queries call the operators on alignments derived from documents; the SQL is
written apart, in ``twins`` and ``step_twins``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators import columns as C
from stemloom.operators import pairs as P
from stemloom.operators import probabilities as B
from stemloom.plans import files, folding, step_twins, steps, twins
from stemloom.sources.alignments import WIDTH, cells_of, document_msa, nation_msa

#: Probabilities of the derived alignments are small; partners need this much.
PARTNER = 0.02


class Inputs:
    """Relations that several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.msa, self.small = document_msa(spark, sf_dir), nation_msa(spark, sf_dir)

    @property
    def cells(self) -> DataFrame:
        return cells_of(self.msa, "fam")

    @property
    def upto(self) -> DataFrame:
        return C.cumulative_occupancy(self.cells)

    @property
    def spine(self) -> DataFrame:
        return C.occupancy(self.cells).select("fam", "col")

    @property
    def counts(self) -> DataFrame:
        return P.pair_counts(self.msa)

    @property
    def scores(self) -> DataFrame:
        return P.scored(self.counts)

    @property
    def pairable(self) -> DataFrame:
        return P.pairable(self.scores)

    @property
    def possible(self) -> DataFrame:
        w = sum((F.col(f"f{k}") for k in range(2, 7)), F.col("f1"))
        return self.counts.select("fam", "i", "j", w.alias("w")).where("w > 0")

    @property
    def bpp(self) -> DataFrame:
        """Stand-ins for probabilities: how many rows form a pair, against the most that either of its columns forms, and the rows."""
        w = P.gated(self.counts).select("fam", "i", "j", "n", sum((F.col(f"f{k}") for k in range(2, 7)), F.col("f1")).alias("w"))
        load = w.select("fam", "w", F.explode(F.array("i", "j")).alias("pos")).groupBy("fam", "pos").agg(F.sum("w").alias("load"))
        at = lambda c: load.select("fam", F.col("pos").alias(c), F.col("load").alias(f"{c}_load"))
        both = w.join(at("i"), ["fam", "i"]).join(at("j"), ["fam", "j"])
        return both.select("fam", "i", "j", (F.col("w") / (F.greatest("i_load", "j_load") + F.col("n"))).alias("prob"))

    @property
    def partners(self) -> DataFrame:
        return B.mutual_best(self.bpp, PARTNER)

    @property
    def marks(self) -> DataFrame:
        """A bracket in each column of a row that opens at the left column's base and closes in the column opposite."""
        c = self.cells
        left = c.where((F.col("col") < WIDTH // 2) & (F.col("code") < 3)).select("fam", "seq", F.explode(F.array(F.struct("col", F.lit(1).alias("sign")), F.struct((WIDTH - 1 - F.col("col")).alias("col"), F.lit(-1).alias("sign")))).alias("m"))
        return left.select("fam", "seq", "m.*")

    @property
    def brackets(self) -> DataFrame:
        return B.matched(self.marks, "fam", "seq")

    @property
    def gold(self) -> DataFrame:
        """The pairs of opposite columns whose commonest bases are complements."""
        c = C.consensus(self.cells)
        right = c.select("fam", F.col("col").alias("j"), (WIDTH - 1 - F.col("col")).alias("i"), F.col("code").alias("other"))
        return c.select("fam", F.col("col").alias("i"), "code").join(right, ["fam", "i"]).where("i < j - 3 and code + other = 3").select("fam", "i", "j")


def rounded(df: DataFrame, places: int = 6, **changed: int) -> DataFrame:
    """Doubles rounded, as sums of them depend on the order of the rows."""
    return df.select(*[F.round(f.name, changed.get(f.name, places)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _rmsd(x: Inputs) -> DataFrame:
    """Each family against the next one."""
    a = x.bpp.withColumn("a_fam", F.col("fam")).withColumn("b_fam", F.col("fam") + 1)
    b = x.bpp.withColumn("a_fam", F.col("fam") - 1).withColumn("b_fam", F.col("fam"))
    return B.deviation_summary(B.deviations(a, b, "a_fam", "b_fam"), "a_fam", "b_fam")


OPERATORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "msa_cells": lambda x: x.cells,
    "a2s_map": lambda x: C.ungapped_positions(x.cells),
    "neighbour_s5": lambda x: C.bases_before(x.cells),
    "neighbour_s3": lambda x: C.bases_after(x.cells),
    "column_occupancy": lambda x: rounded(C.occupancy(x.cells).select("fam", "col", (F.col("bases") / F.col("n")).alias("occupancy"))),
    "smart_gap": lambda x: rounded(x.upto.select("fam", "col", "upto"), 5),
    "energy_codes": lambda x: C.energy_codes(x.cells),
    "row_identity": lambda x: rounded(C.row_identity(x.small)),
    "identity_minmax": lambda x: rounded(C.identity_range(x.small), 4),
    "ribosum_bin": lambda x: C.identity_bins(x.small),
    "msa_identity_avg": lambda x: rounded(C.mean_identity(x.small, F.col("fam") % 2)),
    "ungapped_length": lambda x: rounded(C.mean_length(x.msa)),
    "ungapped_rows": lambda x: C.ungapped(x.msa),
    "consensus_bases": lambda x: C.consensus(x.cells),
    "pair_histogram": lambda x: x.counts,
    "pair_gate": lambda x: P.gated(x.counts).select("fam", "i", "j"),
    "pscore_pairs": lambda x: x.pairable,
    "next_pairable": lambda x: P.next_pairable(x.pairable),
    "prev_pairable": lambda x: P.previous_pairable(x.pairable),
    "hairpin_candidates": lambda x: P.hairpins(x.pairable, x.upto),
    "range_pairs_30": lambda x: P.enclosing(x.pairable, x.upto),
    "range_pairs_6": lambda x: P.enclosing(x.pairable, x.upto, 6),
    "multiloop_openings": lambda x: P.multiloop_openings(x.partners, x.pairable, x.upto, 6),
    "m_p_composition": lambda x: P.composed(x.possible, x.possible),
    "ranked_composition": lambda x: P.ranked_composition(x.possible, x.possible, 10),
    "beam_topk": lambda x: P.beam(x.pairable, 5),
    "sorted_m": lambda x: P.placed(x.pairable),
    "viterbi_argmax": lambda x: P.best_states(x.pairable),
    "logsumexp_by_group": lambda x: rounded(P.log_sum(x.pairable, "pscore", "fam", "j")),
    "fast_log_exp": lambda x: x.pairable.select("fam", "i", "j", F.round(P.log_plus_one(F.col("pscore") / P.KT), 6).alias("logexp"), F.round(P.cut_exp(F.col("pscore") / P.KT), 6).alias("fastexp")),
    "dotbracket_pairs": lambda x: x.brackets,
    "bracket_depth": lambda x: B.depths(x.marks, "fam", "seq").select("fam", "seq", "col", "depth"),
    "project_structure": lambda x: B.canonical(x.brackets, x.cells).select("fam", "seq", "i", "j"),
    "project_on_rows": lambda x: B.on_rows(x.partners.select("fam", "i", "j"), x.cells, C.ungapped_positions(x.cells)),
    "project_probabilities": lambda x: rounded(B.on_rows(x.bpp.where("prob >= 0.02"), x.cells, C.ungapped_positions(x.cells))),
    "pseudo_bpp": lambda x: rounded(x.bpp),
    "bpp_filter": lambda x: rounded(B.supported(x.bpp, PARTNER)),
    "bpp_mass": lambda x: rounded(B.mass(x.bpp), 5),
    "unpaired_prob": lambda x: rounded(B.unpaired(x.bpp, x.spine)),
    "bpp_rmsd": lambda x: rounded(_rmsd(x).drop("box")),
    "bpp_deviation_box": lambda x: _rmsd(x).select("a_fam", F.posexplode("box").alias("point", "deviation")).select("a_fam", "point", F.round("deviation", 6).alias("deviation")),
    "mutual_best_pairs": lambda x: rounded(x.partners),
    "pseudoknot_layers": lambda x: B.crossings(x.partners),
    "pseudoknot_kinds": lambda x: B.layers(x.partners).select("fam", "i", "j", "layer"),
    "pairs_to_structure": lambda x: B.drawn(x.partners, x.spine, "fam"),
    "gold_pairs": lambda x: x.gold,
    "eval_prf_sd": lambda x: rounded(B.compared(x.partners, x.gold, x.spine)),
    "ensemble_defect": lambda x: rounded(B.ensemble_defect(x.bpp, x.gold, x.spine), 4),
    "slip_edges": lambda x: B.slip_edges(x.partners, x.gold),
    "family_rollup": lambda x: rounded(B.rolled_up(x.bpp, F.col("fam") % 4).select(F.col("kind").cast("int").alias("kind"), F.col("mean").alias("mean_prob"), F.col("least").alias("min_prob"), F.col("most").alias("max_prob"))),
    "distinct_families": lambda x: x.msa.select((F.col("fam") % 4).alias("kind")).distinct(),
    "set_union_pairs": lambda x: x.partners.select("fam", "i", "j").union(x.gold).distinct(),
    "set_intersect_pairs": lambda x: x.partners.select("fam", "i", "j").intersect(x.gold),
    "set_except_pairs": lambda x: x.partners.select("fam", "i", "j").subtract(x.gold),
    "bag_union_pairs": lambda x: x.partners.select("fam", "i", "j").unionByName(x.gold),
    "empirical_bpp": lambda x: rounded(B.empirical(x.brackets, x.cells)),
    "covariation_energy": lambda x: rounded(B.covariation_energy(x.partners, x.scores)),
}


def _query(f: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Inputs(spark, sf_dir))


QUERIES = {name: _query(f) for name, f in (OPERATORS | steps.OPERATORS).items()} | files.QUERIES | folding.QUERIES

RELATIONS = twins.RELATIONS | step_twins.RELATIONS
_NAME = re.compile(r"\{(\w+)\}")


def _steps(text: str) -> list[str]:
    """The relations that a text needs, each after those it needs itself."""
    out: list[str] = []
    for name in _NAME.findall(text):
        out += [x for x in [*_steps(RELATIONS[name]), name] if x not in out]
    return out


def _whole(text: str) -> str:
    parts = [f"{n} AS {'MATERIALIZED ' * (n in step_twins.ONCE)}({RELATIONS[n]})" for n in _steps(text)]
    begin = "WITH RECURSIVE "
    if text.startswith(begin):
        return _NAME.sub(r"\1", begin + "".join(f"{p}, " for p in parts) + text.removeprefix(begin))
    return _NAME.sub(r"\1", (f"WITH {', '.join(parts)} " if parts else "") + text)


SQL: dict[str, str] = {name: _whole(text) for name, text in (twins.OPERATORS | step_twins.OPERATORS).items()}
