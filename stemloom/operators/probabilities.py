"""Operators on pair probabilities and on structures as pairs: thresholds, partners, brackets, projection, comparison, roll-ups.

``bpp`` is (fam, i, j, prob) with i < j; ``pairs`` is (fam, i, j); ``spine`` is (fam, col),
each column of a structure once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.functions import structures as st
from stemloom.operators.pairs import pair_code

#: Columns between the ends of a pair, one more.
APART = 4
SMALL = 1e-10


def supported(bpp: DataFrame, least: float, first: int = 1) -> DataFrame:
    """Pairs of at least a probability and four columns apart, counted from ``first``."""
    return bpp.where((F.col("prob") >= least) & (F.col("j") >= F.col("i") + APART)).select("fam", (F.col("i") + first).alias("i"), (F.col("j") + first).alias("j"), "prob")


def mass(bpp: DataFrame) -> DataFrame:
    return bpp.where(F.col("j") >= F.col("i") + APART).groupBy("fam").agg(F.sum("prob").alias("mass"), F.count("*").alias("pairs"))


def both_ends(bpp: DataFrame) -> DataFrame:
    """(fam, pos, other, prob): each pair from either end."""
    return bpp.select("fam", "prob", F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("j").alias("other")), F.struct(F.col("j").alias("pos"), F.col("i").alias("other")))).alias("e")).select("fam", "e.pos", "e.other", "prob")


def unpaired(bpp: DataFrame, spine: DataFrame) -> DataFrame:
    """(fam, col, unpaired): one less the probabilities of a column's pairs."""
    used = both_ends(bpp).groupBy("fam", F.col("pos").alias("col")).agg(F.sum("prob").alias("p"))
    return spine.select("fam", "col").join(used, ["fam", "col"], "left").select("fam", "col", (1 - F.coalesce("p", F.lit(0.0))).alias("unpaired"))


def mutual_best(bpp: DataFrame, least: float = 0.3) -> DataFrame:
    """(fam, i, j, prob): pairs that are the most probable of both their columns; ties of a column go to the lesser partner."""
    w = Window.partitionBy("fam", "pos").orderBy(F.round("prob", 9).desc(), "other")
    best = both_ends(bpp.where(F.col("prob") >= least)).withColumn("k", F.row_number().over(w)).where("k = 1")
    pairs = best.select("fam", F.least("pos", "other").alias("i"), F.greatest("pos", "other").alias("j"), "prob")
    return pairs.groupBy("fam", "i", "j").agg(F.count("*").alias("n"), F.max("prob").alias("prob")).where("n = 2").drop("n")


def crossings(pairs: DataFrame, block: int = 32) -> DataFrame:
    """(fam, i, j, crossed): how many pairs begin before a pair and end inside it.

    A pair meets the others in the blocks of columns that it spans, each where the other ends.
    """
    own = pairs.select("fam", "i", "j", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor(F.col("j") / block))).alias("bucket"))
    ends = pairs.select("fam", F.col("i").alias("p"), F.col("j").alias("q"), F.floor(F.col("j") / block).alias("bucket"))
    met = own.join(ends, ["fam", "bucket"]).where("p < i and i < q and q < j").groupBy("fam", "i", "j").agg(F.count("*").alias("crossed"))
    return pairs.select("fam", "i", "j").join(met, ["fam", "i", "j"], "left").select("fam", "i", "j", F.coalesce("crossed", F.lit(0)).cast("long").alias("crossed"))


def layers(pairs: DataFrame, kinds: int = len(st.KINDS)) -> DataFrame:
    """(fam, i, j, layer): 0 for pairs that no earlier one crosses; those that are crossed go on to the next layer, of ``kinds`` in all. A group is one structure."""
    kind = pairs.schema["fam"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        found = sorted(zip(t.column("i").to_pylist(), t.column("j").to_pylist(), strict=True))
        return pa.table({"fam": t.column("fam").combine_chunks(), "i": pa.array([i for i, _ in found], pa.int32()), "j": pa.array([j for _, j in found], pa.int32()), "layer": pa.array(st.layers(found, kinds), pa.int32())})

    return pairs.select("fam", F.col("i").cast("int"), F.col("j").cast("int")).groupBy("fam").applyInArrow(run, f"fam {kind}, i int, j int, layer int")


def depths(marks: DataFrame, *keys: str) -> DataFrame:
    """keys, col, sign, depth of opening (+1) and closing (-1) brackets (keys, col, sign); an opener and its closer have the same depth."""
    w = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.where("sign <> 0").select(*keys, "col", "sign", (F.sum("sign").over(w) - F.when(F.col("sign") > 0, 1).otherwise(0)).cast("int").alias("depth"))


def matched(marks: DataFrame, *keys: str) -> DataFrame:
    """keys, i, j of the brackets that close each other; one of a kind of brackets at a time."""
    w = Window.partitionBy(*keys, "depth").orderBy("col")
    return depths(marks, *keys).withColumn("j", F.lead("col").over(w)).where("sign > 0 and j is not null").select(*keys, F.col("col").alias("i"), "j")


def bracket_marks(structures: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, col, sign of the brackets of (keys, structure); kinds are the four of () [] {} <>."""
    cells = structures.select(*keys, F.posexplode(F.split("structure", "")).alias("col", "c")).where("c <> '' and c <> '.'")
    opens, closes = F.instr(F.lit("([{<"), F.col("c")), F.instr(F.lit(")]}>"), F.col("c"))
    return cells.select(*keys, (F.greatest(opens, closes) - 1).alias("kind"), "col", F.when(opens > 0, 1).when(closes > 0, -1).otherwise(0).alias("sign"))


def parsed(structures: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, i, j of the pairs of bracket strings (keys, structure)."""
    return matched(bracket_marks(structures, *keys), *keys, "kind")


def drawn(pairs: DataFrame, spine: DataFrame, *keys: str, kind: str | None = None) -> DataFrame:
    """keys, structure: the bracket string of (keys, i, j) over the columns of ``spine`` (keys, col)."""
    at = F.lit(0) if kind is None else F.col(kind)
    signs = lambda c, text: F.substring(F.lit(text), at + 1, F.lit(1)).alias(c)
    marks = pairs.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("col"), signs("c", "([{<")), F.struct(F.col("j").alias("col"), signs("c", ")]}>")))).alias("m")).select(*keys, "m.*")
    cells = spine.select(*keys, "col").join(marks, [*keys, "col"], "left").groupBy(*keys, "col").agg(F.coalesce(F.max("c"), F.lit(".")).alias("c"))
    whole = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col", "c"))).alias("s"))  # the columns of one structure
    return whole.select(*keys, F.array_join(F.transform("s", lambda x: x.c), "").alias("structure"))


def canonical(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Those of (fam, i, j, …) and rows (fam, seq) whose bases can pair: with seq; ``pairs`` may hold seq itself."""
    keys = ["fam", "seq"] if "seq" in pairs.columns else ["fam"]
    left = cells.select("fam", "seq", F.col("col").alias("i"), F.col("code").alias("_a"))
    right = cells.select("fam", "seq", F.col("col").alias("j"), F.col("code").alias("_b"))
    met = pairs.join(left, [*keys, "i"]).join(right, ["fam", "seq", "j"])
    return met.where(pair_code("_a", "_b").between(1, 6)).drop("_a", "_b")


def on_rows(pairs: DataFrame, cells: DataFrame, positions: DataFrame) -> DataFrame:
    """The pairs that each row's bases can form, in the coordinates of the row without gaps; ``positions`` are those of ``columns.ungapped_positions``."""
    found = canonical(pairs, cells)
    at = lambda c: positions.select("fam", "seq", F.col("col").alias(c), F.col("pos").alias(f"{c}_pos"))
    moved = found.join(at("i"), ["fam", "seq", "i"]).join(at("j"), ["fam", "seq", "j"])
    rest = [c for c in moved.columns if c not in ("fam", "seq", "i", "j", "i_pos", "j_pos")]
    return moved.select("fam", "seq", F.col("i_pos").alias("i"), F.col("j_pos").alias("j"), *rest)


def deviations(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, i, j, d, shared: the difference of two tables of probabilities pair by pair, 0 standing for a missing one."""
    x = a.select(*keys, "i", "j", F.col("prob").alias("_x"))
    y = b.select(*keys, "i", "j", F.col("prob").alias("_y"))
    both = x.join(y, [*keys, "i", "j"], "full_outer")
    return both.select(*keys, "i", "j", (F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))).alias("d"), (F.col("_x").isNotNull() & F.col("_y").isNotNull()).cast("int").alias("shared"))


def deviation_summary(d: DataFrame, *keys: str) -> DataFrame:
    """keys, rmsd, mean_dev, max_dev, min_dev, pairs_union, pairs_shared and, as ``box``, the 10, 25, 50, 75 and 90 % points of the deviations."""
    size = F.abs("d")
    return d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmsd"), F.avg(size).alias("mean_dev"), F.max(size).alias("max_dev"), F.min(size).alias("min_dev"), F.count("*").alias("pairs_union"), F.sum("shared").cast("long").alias("pairs_shared"), F.percentile(size, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("box"))


def free_columns(pairs: DataFrame, spine: DataFrame, *keys: str) -> DataFrame:
    used = pairs.select(*keys, F.explode(F.array("i", "j")).alias("col")).distinct()
    return spine.select(*keys, "col").join(used, [*keys, "col"], "left_anti")


def compared(predicted: DataFrame, gold: DataFrame, spine: DataFrame) -> DataFrame:
    """fam, hit, predicted, gold, prec, sens, f1, sd of two structures as pairs: equal pairs, and columns that are in no pair in both.

    ``sd`` is the number of columns less twice the equal pairs and the columns free in both.
    """
    count = lambda df, name: df.groupBy("fam").agg(F.count("*").cast("int").alias(name))
    width = count(spine.select("fam", "col").distinct(), "width")
    p, g = predicted.select("fam", "i", "j").distinct(), gold.select("fam", "i", "j").distinct()
    hit = count(p.join(g, ["fam", "i", "j"], "left_semi"), "hit")
    free = count(free_columns(p, spine, "fam").join(free_columns(g, spine, "fam"), ["fam", "col"], "left_semi"), "free")
    whole = width.join(hit, "fam", "left").join(count(p, "predicted"), "fam", "left").join(count(g, "gold"), "fam", "left").join(free, "fam", "left").fillna(0)
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("predicted") + F.col("gold"))).otherwise(0.0)
    return whole.select("fam", "hit", "predicted", "gold", (F.col("hit") / (F.col("predicted") + SMALL)).alias("prec"), (F.col("hit") / (F.col("gold") + SMALL)).alias("sens"), f1.alias("f1"), (F.col("width") - 2 * F.col("hit") - F.col("free")).alias("sd"))


def ensemble_defect(bpp: DataFrame, gold: DataFrame, spine: DataFrame) -> DataFrame:
    """fam, defect: columns less twice the probabilities of the gold pairs and less the unpaired ones of the gold free columns."""
    width = spine.select("fam", "col").distinct().groupBy("fam").agg(F.count("*").alias("width"))
    paired = gold.select("fam", "i", "j").join(bpp, ["fam", "i", "j"]).groupBy("fam").agg(F.sum("prob").alias("paired"))
    loose = unpaired(bpp, free_columns(gold, spine, "fam")).groupBy("fam").agg(F.sum("unpaired").alias("loose"))
    whole = width.join(paired, "fam", "left").join(loose, "fam", "left").fillna(0.0)
    return whole.select("fam", (F.col("width") - 2 * F.col("paired") - F.col("loose")).alias("defect"))


def slip_edges(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """fam, i, j, gi, gj: predicted pairs and the gold pairs that are equal or have one end off by one; five places are looked up."""
    moves = F.array(*[F.struct((F.col("i") + a).alias("gi"), (F.col("j") + b).alias("gj")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    near = predicted.select("fam", "i", "j", F.explode(moves).alias("m")).select("fam", "i", "j", "m.*")
    return near.join(gold.select("fam", F.col("i").alias("gi"), F.col("j").alias("gj")), ["fam", "gi", "gj"]).select("fam", "i", "j", "gi", "gj")


def rolled_up(values: DataFrame, kind: Column, value: str = "prob", each: str = "fam") -> DataFrame:
    """kind, mean, least, most of the means of ``each``: means of means, not of all rows."""
    first = values.groupBy(kind.alias("kind"), each).agg(F.avg(value).alias("x"))
    return first.groupBy("kind").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


def empirical(pairs: DataFrame, structures: DataFrame) -> DataFrame:
    """fam, i, j, prob: the share of an alignment's structures (fam, seq) that have a pair (fam, seq, i, j)."""
    total = structures.select("fam", "seq").distinct().groupBy("fam").agg(F.count("*").alias("total"))
    return pairs.groupBy("fam", "i", "j").agg(F.count("*").alias("n")).join(total, "fam").select("fam", "i", "j", (F.col("n") / F.col("total")).alias("prob"))


def covariation_energy(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """fam, energy, pairs: the conservation part of a structure's energy, in kcal/mol."""
    return pairs.select("fam", "i", "j").join(scores, ["fam", "i", "j"]).groupBy("fam").agg((F.sum(-F.col("pscore")) / 100).alias("energy"), F.count("*").alias("pairs"))


def expected_correlations(bpp: DataFrame, spine: DataFrame, gammas: tuple[float, ...] = st.GAMMAS) -> DataFrame:
    """(fam, gamma, pairs, hits, correlation): for each weight of the grid, how many pairs have a probability over 1 / (gamma + 1), how many of these are expected to be right, and the expected correlation.

    All weights are counted in one pass over the probabilities, with partial sums; the grid is laid out over the counts. The
    correlation is 0 where one of its factors isn't positive.
    """
    width = spine.select("fam", "col").distinct().groupBy("fam").agg(F.count("*").alias("width"))
    far = bpp.where(F.col("j") >= F.col("i") + APART)
    over = lambda g: F.col("prob") > 1 / (g + 1)
    sums = [x for k, g in enumerate(gammas) for x in (F.sum(over(g).cast("long")).alias(f"n{k}"), F.sum(F.when(over(g), F.col("prob")).otherwise(0.0)).alias(f"h{k}"))]
    counted = width.join(far.groupBy("fam").agg(F.sum("prob").alias("mass"), *sums), "fam", "left").fillna(0)
    grid = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("gamma"), F.col(f"n{k}").alias("pairs"), F.col(f"h{k}").alias("hits")) for k, g in enumerate(gammas)]))
    each = counted.select("fam", "width", "mass", grid.alias("g")).select("fam", "width", "mass", "g.*")
    extra, missed = F.col("pairs") - F.col("hits"), F.col("mass") - F.col("hits")
    rest = F.col("width") * F.floor((F.col("width") - 1) / 2) - F.col("pairs") - F.col("mass") + F.col("hits")
    square = F.col("pairs") * F.col("mass") * (rest + extra) * (rest + missed)
    return each.select("fam", "gamma", "pairs", "hits", F.when(square > 0, (F.col("hits") * rest - extra * missed) / F.sqrt(square)).otherwise(0.0).alias("correlation"))


def best_gammas(correlations: DataFrame) -> DataFrame:
    """(fam, gamma, correlation) of the greatest correlation of ``expected_correlations``, ties to the larger gamma; null where none is over 0."""
    best = F.max(F.when(F.round("correlation", 12) > 0, F.struct(F.round("correlation", 12).alias("correlation"), "gamma"))).alias("b")
    return correlations.groupBy("fam").agg(best).select("fam", F.col("b.gamma").alias("gamma"), F.col("b.correlation").alias("correlation"))
