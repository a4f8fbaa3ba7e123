"""Energies of hairpins, stems, stacks, bulges and internal loops for each row of an alignment, and special hairpins.

Small tables of an energy set are constant arrays of a column expression. Those of
small internal loops have thousands of entries on up to six keys: they are a table
(loop, t1, t2, a, b, c, d, energy) that the loops are joined with, in the form of
``Energies.listing``, and what it doesn't list is scored by the general rule.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemloom.functions.conservation import alignment
from stemloom.functions.energies import FAR, LOG_SLOPE, LONGEST, MAX_ASYMMETRY, SHORT_HAIRPIN, SMALL, Energies, builtin
from stemloom.functions.loop_counts import Counts
from stemloom.operators import columns as C
from stemloom.operators.pairs import pair_code
from stemloom.sources.shared import written


def looked(table: np.ndarray, *at: Column) -> Column:
    """The entry of an array at some indices, from a constant array."""
    place = F.lit(0)
    for size, c in zip(table.shape, at, strict=True):
        place = place * size + c
    return F.element_at(F.expr("array(" + ",".join(str(int(x)) for x in table.ravel()) + ")"), place.cast("int") + 1)


def sites(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """fam, seq, i, j, kind, size and the neighbours of both ends as table bases: what a pair's loop needs to know of each row.

    ``kind`` is 7 where a row's bases can't pair; a neighbour is 0 where the row has none or an unknown base.
    """
    base = lambda c: F.when(F.col(c) < C.OTHER, F.col(c) + 1).otherwise(0).cast("int")
    keys = ["fam", "seq", "col"]
    whole = cells.select(*keys, "code").join(C.ungapped_positions(cells), keys).join(C.bases_before(cells), keys).join(C.bases_after(cells), keys)
    side = lambda c: whole.select("fam", "seq", *[F.col(x).alias(f"{c}_{x}") for x in ("code", "pos", "s5", "s3")], F.col("col").alias(c))
    met = pairs.select("fam", "i", "j").join(side("i"), ["fam", "i"]).join(side("j"), ["fam", "seq", "j"])
    code = pair_code("i_code", "j_code")
    inside = F.col("j_pos") - F.col("i_pos") - (F.col("j_code") != C.GAP).cast("int")
    return met.select("fam", "seq", "i", "j", F.when(code.between(1, 6), code).otherwise(7).alias("kind"), inside.cast("int").alias("size"), *[base(x).alias(y) for x, y in (("i_s5", "i_before"), ("i_s3", "i_after"), ("j_s5", "j_before"), ("j_s3", "j_after"))])


def hairpin_energy(e: Energies | None = None) -> Column:
    """Of ``sites``: loops of fewer than three bases have a fixed energy, of three none of the mismatch."""
    e = e or builtin()
    n = F.col("size")
    table = looked(np.minimum(e.hairpin, FAR), F.least(n, F.lit(LONGEST)))
    over = F.when(n > LONGEST, (LOG_SLOPE * F.log(n / LONGEST)).cast("int")).otherwise(0)
    rest = F.when(n == 3, looked(e.weak, F.col("kind"))).otherwise(looked(e.mismatch_hairpin, F.col("kind"), F.col("i_after"), F.col("j_before")))
    return F.when(n < 3, SHORT_HAIRPIN).otherwise(table + over + rest)


def stem_energy(width: Column, inside: bool = False, e: Energies | None = None) -> Column:
    """Of ``sites``: a stem in a multiloop, or outside of all pairs; at the ends of the alignment there is no neighbour."""
    e = e or builtin()
    before = F.when(F.col("i") > 0, F.col("i_before") + 1).otherwise(0)
    after = F.when(F.col("j") + 1 < width, F.col("j_after") + 1).otherwise(0)
    return looked(e.inner_stem if inside else e.exterior_stem, F.col("kind"), before, after)


def summed(energies: DataFrame, value: str) -> DataFrame:
    """fam, i, j and the sum over the rows, as each state of a fold scores it."""
    return energies.groupBy("fam", "i", "j").agg(F.sum(value).alias(value))


#: What a loop is looked up by: which table, the two pair kinds, and up to four bases.
KEYS = ("loop", "t1", "t2", "a", "b", "c", "d")
#: The pair kinds as a loop is read for its table, which isn't always from its outer pair.
READ = {"t1": "first", "t2": "second"}
#: Each pair kind read from its other end.
TURNED = (0, 2, 1, 4, 3, 6, 5, 7)

# fixed values: hairpins of five, six and eight bases that have energies of their own, each in its list's order
SPECIAL = {
    "tri": ("CAACG", "GUUAC"),
    "tetra": ("CAACGG", "CCAAGG", "CCACGG", "CCCAGG", "CCGAGG", "CCGCGG", "CCUAGG", "CCUCGG", "CUAAGG", "CUACGG", "CUCAGG", "CUCCGG", "CUGCGG", "CUUAGG", "CUUCGG", "CUUUGG"),
    "hexa": ("ACAGUACU", "ACAGUGAU", "ACAGUGCU", "ACAGUGUU"),
}


def pair_sites(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """fam, seq, i, j, kind, bases up to i and j with them (``_upto``) and without (``_under``), and the table bases beside both ends: what loops on either side of a pair need to know of each row."""
    base = lambda c: F.when(F.col(c) < C.OTHER, F.col(c) + 1).otherwise(0).cast("int")
    keys = ["fam", "seq", "col"]
    whole = cells.select(*keys, "code").join(C.ungapped_positions(cells), keys).join(C.bases_before(cells), keys).join(C.bases_after(cells), keys)
    under = F.col("pos") + 1 - (F.col("code") != C.GAP).cast("int")
    own = whole.select(*keys, "code", (F.col("pos") + 1).alias("upto"), under.alias("under"), base("s5").alias("before"), base("s3").alias("after"))
    side = lambda c: own.select("fam", "seq", *[F.col(x).alias(f"{c}_{x}") for x in ("code", "upto", "under", "before", "after")], F.col("col").alias(c))
    met = pairs.select("fam", "i", "j").distinct().join(side("i"), ["fam", "i"]).join(side("j"), ["fam", "seq", "j"])
    code = pair_code("i_code", "j_code")
    return met.withColumn("kind", F.when(code.between(1, 6), code).otherwise(7)).drop("i_code", "j_code")


def loop_sites(cells: DataFrame, enclosed: DataFrame) -> DataFrame:
    """fam, seq, p, q, i, j, n1, n2, t1, t2, si, sj, sp, sq of the loops between (p, q) and (i, j) of ``pairs.enclosing`` in each row.

    A pair is looked at once a row, whatever the number of loops that it closes; the loops and the pairs in each row are written
    once, as several joins read them. n1 and n2 are bases on either side; t2 is the
    inner pair read from inside the loop; si and sj lie inside the outer pair, sp and sq outside the inner one.
    """
    enclosed = written(enclosed.select("fam", "i", "j", "p", "q"))
    known = written(pair_sites(cells, enclosed.select("fam", "i", "j").unionByName(enclosed.select("fam", F.col("p").alias("i"), F.col("q").alias("j")))))
    turned = F.array(*map(F.lit, TURNED))
    inner = known.select("fam", "seq", "i", "j", F.get(turned, F.col("kind")).alias("t2"), "i_under", "j_upto", F.col("i_before").alias("sp"), F.col("j_after").alias("sq"))
    outer = known.select("fam", "seq", F.col("i").alias("p"), F.col("j").alias("q"), F.col("kind").alias("t1"), F.col("i_upto").alias("p_upto"), F.col("j_under").alias("q_under"), F.col("i_after").alias("si"), F.col("j_before").alias("sj"))
    met = enclosed.select("fam", "i", "j", "p", "q").join(inner, ["fam", "i", "j"]).join(outer, ["fam", "seq", "p", "q"])
    return met.select("fam", "seq", "p", "q", "i", "j", (F.col("i_under") - F.col("p_upto")).cast("int").alias("n1"), (F.col("q_under") - F.col("j_upto")).cast("int").alias("n2"), "t1", "t2", "si", "sj", "sp", "sq")


def keyed(sites: DataFrame) -> DataFrame:
    """``loop_sites`` with KEYS, the pair kinds as READ: a 1x2 loop is read from the side of its one base, so one table serves both ways round."""
    n1, n2 = F.col("n1"), F.col("n2")
    one, short, long, two = (n1 == 1) & (n2 == 1), (n1 == 1) & (n2 == 2), (n1 == 2) & (n2 == 1), (n1 == 2) & (n2 == 2)
    of = lambda *names: F.struct(*[(F.lit(0) if x is None else F.col(x).cast("int")).alias(READ.get(k, k)) for k, x in zip(KEYS[1:], names, strict=True)])
    key = F.when(one, of("t1", "t2", "si", "sj", None, None)).when(short, of("t1", "t2", "si", "sq", "sj", None)).when(long, of("t2", "t1", "sq", "si", "sp", None)).when(two, of("t1", "t2", "si", "sp", "sq", "sj"))
    return sites.withColumn("loop", F.when(one, "1x1").when(short | long, "1x2").when(two, "2x2")).withColumn("_key", key).select(*sites.columns, "loop", "_key.*")


def small_loops(spark: SparkSession, e: Energies) -> DataFrame:
    """The energy set's tables of small internal loops as a table: at most 8 x 8 pair kinds and 5 bases on four keys, about 50,000 rows, whatever the data."""
    return spark.createDataFrame(e.listed(), ", ".join(["loop string", *[f"{k} int" for k in (*KEYS[1:], "energy")]]))


def _by_size(table: np.ndarray, n: Column) -> Column:
    over = F.when(n > LONGEST, (LOG_SLOPE * F.log(n / LONGEST)).cast("int")).otherwise(0)
    return looked(np.minimum(table, FAR), F.least(n, F.lit(LONGEST))) + over


def general_loop_energy(e: Energies | None = None) -> Column:
    """Of ``loop_sites``: stacks, bulges and internal loops by size, asymmetry and mismatches."""
    e = e or builtin()
    n1, n2, t1, t2, si, sj, sp, sq = (F.col(c) for c in ("n1", "n2", "t1", "t2", "si", "sj", "sp", "sq"))
    most, least = F.greatest(n1, n2), F.least(n1, n2)
    ends = lambda table: looked(table, t1, si, sj) + looked(table, t2, sq, sp)
    skew = lambda more: F.least(F.lit(MAX_ASYMMETRY), more * e.asymmetry)
    bulge = _by_size(e.bulge, most) + F.when(most == 1, looked(e.stack, t1, t2)).otherwise(looked(e.weak, t1) + looked(e.weak, t2))
    out = F.when(most == 0, looked(e.stack, t1, t2)).when(least == 0, bulge)
    if e.mismatch_one_n is not None:
        out = out.when((least == 1) & (most > 2), _by_size(e.interior, most + 1) + skew(most - 1) + ends(e.mismatch_one_n))
    if e.mismatch_two_three is not None:
        out = out.when((least == 2) & (most == 3), F.lit(int(e.interior[5]) + e.asymmetry) + ends(e.mismatch_two_three))
    return out.otherwise(_by_size(e.interior, n1 + n2) + skew(most - least) + ends(e.mismatch_interior))


def loop_energies(cells: DataFrame, enclosed: DataFrame, table: DataFrame | None = None, e: Energies | None = None) -> DataFrame:
    """(fam, seq, p, q, i, j, energy) of every loop of ``pairs.enclosing`` in each row.

    ``table`` holds small internal loops (KEYS, energy); it is bounded by its keys, so it is sent to every task.
    """
    sites = keyed(loop_sites(cells, enclosed))
    general = general_loop_energy(e)
    if table is None and e is not None and (e.one_one is not None or e.one_two is not None or e.two_two is not None):
        table = small_loops(cells.sparkSession, e)
    if table is not None:
        kinds = F.col("loop").isin(*SMALL)
        for k in KEYS[1:]:
            kinds &= F.col(k).between(0, 7)
        listed = table.where(kinds).groupBy(*KEYS).agg(F.max("energy").alias("_listed")).withColumnsRenamed(READ)
        sites, general = sites.join(F.broadcast(listed), [READ.get(k, k) for k in KEYS], "left"), F.coalesce("_listed", general)
    return sites.select("fam", "seq", "p", "q", "i", "j", general.cast("int").alias("energy"))


def summed_loops(energies: DataFrame) -> DataFrame:
    """(fam, p, q, i, j, energy): the sum over the rows."""
    return energies.groupBy("fam", "p", "q", "i", "j").agg(F.sum("energy").alias("energy"))


#: Rows of an alignment, and loops, that one task meets at once.
ROWS, LOOPS = 1 << 15, 1 << 17


def with_listed(e: Energies, table: DataFrame) -> Energies:
    """``e`` with the small internal loops of (KEYS, energy) in place of its own; at most about 50,000 entries are read, whatever the data."""
    fit = F.lit(True)
    for k in KEYS[1:]:
        fit &= F.col(k).between(0, 7 if k in READ else 4)
    for name, n in SMALL.items():
        for k in KEYS[3 + n :]:
            fit &= (F.col("loop") != name) | (F.col(k) == 0)
    entries = table.where(F.col("loop").isin(*SMALL) & fit & F.col("energy").isNotNull()).groupBy(*KEYS).agg(F.max("energy").alias("energy")).collect()
    return replace(e, one_one=None, one_two=None, two_two=None).listing(map(tuple, entries))


def loop_totals(msa: DataFrame, enclosed: DataFrame, table: DataFrame | None = None, e: Energies | None = None, rows: int = ROWS) -> DataFrame:
    """(fam, p, q, i, j, energy): ``summed_loops`` of ``loop_energies`` over the rows of (fam, seq, text), without a row for each loop in each of them.

    Equal rows are counted before the shuffle. An alignment's rows are dealt into blocks of about ``rows`` by hash, its loops
    into parts, and each task counts how often each look of a loop occurs in a block and scores it once (``loop_counts``);
    what it gives is as large as its loops. Texts are read as by ``cells_of``; rows of unequal lengths raise an error.
    """
    energies = e or builtin()
    if table is not None:
        energies = with_listed(energies, table)
    spark = msa.sparkSession
    kind = msa.schema["fam"].dataType.simpleString()
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = F.regexp_replace("text", "[^ACGU-]", "N")
    counted = written(msa.where("text <> ''").select("fam", text.alias("text")).groupBy("fam", "text").agg(F.count("*").alias("n")))
    enclosed = written(enclosed.select("fam", "p", "q", "i", "j").distinct())
    blocks = counted.groupBy("fam").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    parts = enclosed.groupBy("fam").agg(F.ceil(F.count("*") / LOOPS).cast("int").alias("parts"))
    sizes = blocks.join(parts, "fam")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}s") - 1)).alias(c)
    deal = lambda c, *of: F.pmod(F.xxhash64(*of), F.col(f"{c}s")).cast("int").alias(c)
    keys = ["fam", "block", "part"]
    left = counted.join(sizes, "fam").select("fam", deal("block", "text"), each("part"), "text", "n").repartition(tasks, *keys)
    right = enclosed.join(sizes, "fam").select("fam", each("block"), deal("part", "p", "i"), "p", "q", "i", "j").repartition(tasks, *keys)

    def run(texts: pa.Table, loops: pa.Table) -> pa.Table:
        if not texts.num_rows or not loops.num_rows:
            loops = loops.slice(0, 0)
            energy = np.zeros(0, np.int64)
        else:
            loops = loops.sort_by([(c, "ascending") for c in ("p", "i", "j", "q")])
            a = alignment(texts.column("text").to_pylist(), texts.column("n").to_pylist())
            energy = Counts(a, energies).sums(*(loops.column(c).to_numpy() for c in ("p", "i", "j", "q")))
        return loops.select(["fam", "p", "q", "i", "j"]).append_column("energy", pa.array(energy, pa.int64()))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"fam {kind}, p int, q int, i int, j int, energy long")
    return found.groupBy("fam", "p", "q", "i", "j").agg(F.sum("energy").alias("energy"))


def special_loops(cells: DataFrame, lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(fam, seq, col, kind, place): for each column and kind of special hairpin, its place in the kind's list where one begins at the column's base, else -1.

    Windows are taken over a row's bases without its gaps, and a gap begins none. The lists become a table that the windows
    of each size are joined with.
    """
    lists = SPECIAL if lists is None else lists
    sizes = sorted({len(x) for entries in lists.values() for x in entries})
    along = Window.partitionBy("fam", "seq").orderBy("col")
    letter = F.substring(F.lit("ACGUN"), F.col("code") + 1, F.lit(1))
    bases = cells.where(F.col("code") != C.GAP).select("fam", "seq", "col", letter.alias("c"))
    ahead = bases.select("fam", "seq", "col", *[F.lead("c", k).over(along).alias(f"c{k}") for k in range(max(sizes, default=0))])
    windows = F.array(*[F.concat(*[F.col(f"c{k}") for k in range(n)]) for n in sizes])
    entries = cells.sparkSession.createDataFrame([(x, kind, k) for kind, found in lists.items() for k, x in enumerate(found)], "window string, kind string, place int")
    first = entries.groupBy("window", "kind").agg(F.min("place").alias("place"))
    hits = ahead.select("fam", "seq", "col", F.explode(windows).alias("window")).where("window is not null").join(first, "window").groupBy("fam", "seq", "col", "kind").agg(F.min("place").alias("place"))
    kinds = F.explode(F.array(*map(F.lit, lists))).alias("kind")
    return cells.select("fam", "seq", "col", kinds).join(hits, ["fam", "seq", "col", "kind"], "left").select("fam", "seq", "col", "kind", F.coalesce("place", F.lit(-1)).alias("place"))
