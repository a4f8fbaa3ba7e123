"""Operators on pairs of columns: counts, conservation, neighbours, range and composition joins, ranks and semiring sums.

``pairs`` tables hold (fam, i, j, …) with i < j; ``upto`` tables are those of
``columns.cumulative_occupancy``. Widths, beams, spans and thresholds are arguments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: pair codes CG 1, GC 2, GU 3, UG 4, AU 5, UA 6, gap-gap 7, other 0
PAIRS = {1: "CG", 2: "GC", 3: "GU", 4: "UG", 5: "AU", 6: "UA"}
LETTERS = "ACGU"
KT = 61.63207755
FAST_LOW, FAST_HIGH, FAST_TOP = -9.91152, 46.052, 1e20
_COUNTS = [f"f{k}" for k in range(8)]
#: Keys whose states a task holds at once; columns of an alignment that are counted at once.
STATES, BLOCK = 200_000, 1024


def pair_code(a: str, b: str) -> Column:
    """The pair code of two columns of base codes."""
    both = F.col(a) * 8 + F.col(b)
    out = F.when(both == 45, 7)
    for k, name in PAIRS.items():
        out = out.when(both == LETTERS.index(name[0]) * 8 + LETTERS.index(name[1]), k)
    return out.otherwise(0)


def _codes(texts: list[str]) -> np.ndarray:
    known = np.full(256, 4, np.uint8)
    for code, letters in enumerate(("Aa", "Cc", "Gg", "UuTt")):
        known[[ord(x) for x in letters]] = code
    known[ord("-")] = 5
    if len({len(t) for t in texts}) > 1:
        raise ValueError("the rows of an alignment must have equal lengths")
    return known[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(len(texts), -1)


def _histogram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[kind, column of left, column of right]: how many rows have that pair code there."""
    a, b = ({c: (x == c).astype(np.float32) for c in (0, 1, 2, 3, 5)} for x in (left, right))
    out = np.zeros((8, left.shape[1], right.shape[1]))
    for k, name in PAIRS.items():
        x, y = (LETTERS.index(c) for c in name)
        out[k] = a[x].T @ b[y]
    out[7] = a[5].T @ b[5]
    out[0] = len(left) - out[1:].sum(0)
    return out.astype(np.int64)


def pair_counts(msa: DataFrame, block: int | None = None) -> DataFrame:
    """(fam, i, j, n, f0 … f7): how many rows of an alignment show each pair code in columns i < j.

    Rows are counted where they are read, a batch at a time and BLOCK by BLOCK columns at a time, and the counts are summed
    with partial sums: no row is shuffled, no task holds an alignment or the counts of all its columns. ``block`` deals
    pairs of blocks of so many columns over tasks first, for alignments whose pairs are much work for few rows.
    """
    kind = msa.schema["fam"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    if block is None:
        parts = msa.select("fam", F.lit(0).alias("a"), F.lit(0).alias("b"), text.alias("left"), text.alias("right"))
    else:
        last = F.greatest(F.ceil(F.length(text) / block).cast("int") - 1, F.lit(0))
        first = msa.select("fam", text.alias("text"), last.alias("last")).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("a"))
        both = first.select("*", F.explode(F.sequence("a", "last")).alias("b"))
        parts = both.select("fam", (F.col("a") * block).alias("a"), (F.col("b") * block).alias("b"), *[F.substr("text", F.col(x) * block + 1, F.lit(block)).alias(y) for x, y in (("a", "left"), ("b", "right"))])
        parts = parts.repartition("fam", "a", "b").sortWithinPartitions("fam", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = t.select(["fam", "a", "b"]).append_column("at", pa.array(np.arange(t.num_rows)))
            for g in keys.group_by(["fam", "a", "b"]).aggregate([("at", "list")]).to_pylist():
                own = t.take(pa.array(g["at_list"]))
                left, right = (_codes(own.column(c).to_pylist()) for c in ("left", "right"))
                for x, y in ((x, y) for x in range(0, left.shape[1], BLOCK) for y in range(0, right.shape[1], BLOCK)):
                    i, j = np.meshgrid(np.arange(x, min(x + BLOCK, left.shape[1])) + g["a"], np.arange(y, min(y + BLOCK, right.shape[1])) + g["b"], indexing="ij")
                    use = i < j
                    size = int(use.sum())
                    if size:
                        counts = _histogram(left[:, x : x + BLOCK], right[:, y : y + BLOCK])
                        yield pa.RecordBatch.from_arrays([pa.array([g["fam"]] * size, batch.schema.field("fam").type), pa.array(i[use].astype(np.int32)), pa.array(j[use].astype(np.int32)), *(pa.array(c[use]) for c in counts)], names=["fam", "i", "j", *_COUNTS])

    found = parts.mapInArrow(run, f"fam {kind}, i int, j int, " + ", ".join(f"{c} long" for c in _COUNTS))
    whole = found.groupBy("fam", "i", "j").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return whole.select("fam", "i", "j", sum((F.col(c) for c in _COUNTS[1:]), F.col("f0")).alias("n"), *_COUNTS)


def gated(counts: DataFrame) -> DataFrame:
    """Pairs of columns that at least half of the rows allow."""
    return counts.where(2 * F.col("f0") + F.col("f7") <= F.col("n"))


def differing_bases() -> list[list[float]]:
    """The plain substitution matrix: in how many bases two pair codes differ."""
    return [[float(sum(x != y for x, y in zip(PAIRS.get(k, ""), PAIRS.get(m, ""), strict=False))) for m in range(7)] for k in range(7)]


def _lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def conservation_score(matrix: list[list[float]] | Column | None = None, beta: float = 1.2, delta: float = 0.1) -> Column:
    """Covariation of the pairs that the rows show, less what the rows that show none cost; over the counts of ``pair_counts``.

    A matrix in a column is an array of 7 times 7 values, as ``substitutions.matrices`` gives it for each alignment.
    """
    m = [[matrix[7 * k + n] for n in range(7)] for k in range(7)] if isinstance(matrix, Column) else matrix or differing_bases()
    f = {k: F.col(f"f{k}").cast("double") for k in PAIRS}
    bonus = F.lit(0.0)
    for k in PAIRS:
        bonus += _lit(m[k][k]) * f[k] * (f[k] - 1) / 2
        for other in PAIRS:
            if other > k:
                bonus += _lit(m[k][other]) * f[k] * f[other]
    cost = 100.0 * delta * (F.col("f0") + 0.25 * F.col("f7"))
    return F.lit(beta) * (100.0 * bonus / F.col("n") - cost) / F.col("n")


def scored(counts: DataFrame, matrix: list[list[float]] | None = None, beta: float = 1.2, delta: float = 0.1) -> DataFrame:
    """(fam, i, j, pscore) of the gated pairs."""
    return gated(counts).select("fam", "i", "j", F.round(conservation_score(matrix, beta, delta), 6).alias("pscore"))


def pairable(scores: DataFrame, cutoff: float = -40) -> DataFrame:
    return scores.where(F.col("pscore") >= cutoff)


def next_pairable(pairs: DataFrame) -> DataFrame:
    """(fam, i, j, nxt): the next column after j that may pair with i, -1 if none."""
    w = Window.partitionBy("fam", "i").orderBy("j")
    return pairs.select("fam", "i", "j", F.lead("j", 1, -1).over(w).alias("nxt"))


def previous_pairable(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("fam", "i").orderBy("j")
    return pairs.select("fam", "i", "j", F.lag("j", 1, -1).over(w).alias("prv"))


def hairpins(pairs: DataFrame, upto: DataFrame, columns: int = 4, share: float = 0.5) -> DataFrame:
    """(fam, i, j) that may close a hairpin: ``columns`` apart or more, with that many times ``share`` bases a row between them or more."""
    at = lambda c: upto.select("fam", F.col("col").alias(c), F.col("upto").alias(f"{c}_upto"))
    both = pairs.where(F.col("j") >= F.col("i") + columns).join(at("i"), ["fam", "i"]).join(at("j"), ["fam", "j"])
    return both.where(F.round(F.col("j_upto") - F.col("i_upto"), 6) >= columns * share).select("fam", "i", "j")


def _bases(upto: DataFrame, name: str, shift: int) -> DataFrame:
    """fam, ``name`` and the bases up to that column less ``shift``."""
    return upto.select("fam", (F.col("col") + shift).alias(name), F.col("bases_upto").alias(f"{name}_bases"))


def enclosing(pairs: DataFrame, upto: DataFrame, span: int = 30) -> DataFrame:
    """(fam, i, j, p, q): pairs of which (p, q) encloses (i, j) with at most ``span`` bases a row between them on both sides together.

    Bases up to i and p differ by ``span`` a row at most, so the pairs are dealt into buckets of that many bases and a pair
    meets the bucket of its own and the one before: an equi-join, in which no alignment is one key.
    """
    n = upto.groupBy("fam").agg(F.max("n").alias("n"))
    inner = pairs.select("fam", "i", "j").join(_bases(upto, "i", 1), ["fam", "i"]).join(_bases(upto, "j", 0), ["fam", "j"]).join(n, "fam")
    outer = pairs.select("fam", F.col("i").alias("p"), F.col("j").alias("q")).join(_bases(upto, "p", 0), ["fam", "p"]).join(_bases(upto, "q", 1), ["fam", "q"]).join(n, "fam")
    bucket = lambda c: F.floor(F.col(c) / (span * F.col("n")))
    inner = inner.select("*", F.explode(F.array(bucket("i_bases") - 1, bucket("i_bases"))).alias("bucket"))
    outer = outer.withColumn("bucket", bucket("p_bases")).drop("n")
    met = inner.join(outer, ["fam", "bucket"])
    left, right = F.col("i_bases") - F.col("p_bases"), F.col("q_bases") - F.col("j_bases")
    return met.where((F.col("p") < F.col("i")) & (F.col("j") < F.col("q")) & (left + right <= span * F.col("n"))).select("fam", "i", "j", "p", "q")


def multiloop_openings(inside: DataFrame, pairs: DataFrame, upto: DataFrame, span: int = 30) -> DataFrame:
    """(fam, i, j, p, q): for each of ``inside`` (fam, i, j), all p before i with at most ``span`` bases a row between, and the first q after j that pairs with p."""
    n = upto.groupBy("fam").agg(F.max("n").alias("n"))
    bucket = lambda c: F.floor(F.col(c) / (span * F.col("n")))
    own = inside.select("fam", "i", "j").join(_bases(upto, "i", 1), ["fam", "i"]).join(n, "fam")
    own = own.select("*", F.explode(F.array(bucket("i_bases") - 1, bucket("i_bases"))).alias("bucket"))
    columns = _bases(upto, "p", 0).join(n, "fam").withColumn("bucket", bucket("p_bases")).drop("n")
    opened = own.join(columns, ["fam", "bucket"]).where((F.col("p") < F.col("i")) & (F.col("i_bases") - F.col("p_bases") <= span * F.col("n"))).select("fam", "i", "j", "p")
    partners = pairs.groupBy(F.col("fam"), F.col("i").alias("p")).agg(F.sort_array(F.collect_list("j")).alias("qs"))  # at most the columns of an alignment
    first = opened.join(partners, ["fam", "p"]).withColumn("q", F.get(F.filter("qs", lambda q: q > F.col("j")), F.lit(0)))
    return first.where("q is not null").select("fam", "i", "j", "p", "q")


def composed(left: DataFrame, right: DataFrame, weight: str = "w") -> DataFrame:
    """(fam, i, j, best, ways): what follows when a ``right`` begins in the column after a ``left``."""
    a = left.select("fam", "i", (F.col("j") + 1).alias("at"), F.col(weight).alias("x"))
    b = right.select("fam", F.col("i").alias("at"), "j", F.col(weight).alias("y"))
    return a.join(b, ["fam", "at"]).groupBy("fam", "i", "j").agg(F.max(F.col("x") + F.col("y")).alias("best"), F.count("*").alias("ways"))


def ranked_composition(left: DataFrame, right: DataFrame, k: int, weight: str = "w") -> DataFrame:
    """(fam, i, begins, j, total, place): of what ends in column j, the k compositions of greatest total; ties to the lesser begins, then i.

    A total is a sum, so of the lefts that end before one column only the k greatest can be among them: these meet a right,
    not all, and a window keeps k for each end.
    """
    w = Window.partitionBy("fam", "begins").orderBy(F.col("x").desc(), "i")
    a = left.select("fam", "i", (F.col("j") + 1).alias("begins"), F.col(weight).alias("x")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
    b = right.select("fam", F.col("i").alias("begins"), "j", F.col(weight).alias("y"))
    met = a.join(b, ["fam", "begins"]).withColumn("total", F.col("x") + F.col("y"))
    order = Window.partitionBy("fam", "j").orderBy(F.col("total").desc(), "begins", "i")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("fam", "i", "begins", "j", "total", "place")


def beam(pairs: DataFrame, k: int, rank: Column | None = None) -> DataFrame:
    """The states of each end column j whose rank value is among the k + 1 greatest, ties included."""
    w = Window.partitionBy("fam", "j").orderBy((F.col("pscore") if rank is None else rank).desc())
    return pairs.withColumn("_place", F.rank().over(w)).where(F.col("_place") <= k + 1).drop("_place")


def with_prefix(pairs: DataFrame) -> DataFrame:
    """(fam, i, j, pscore, prefix): with the greatest score of what ends before a state begins, 0 if nothing does: what a beam ranks states by, besides their own score.

    One row an end column is sorted, not one a state.
    """
    along = Window.partitionBy("fam").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    ends = pairs.groupBy("fam", F.col("j").alias("col")).agg(F.max("pscore").alias("most"))
    begins = pairs.select("fam", F.col("i").alias("col")).distinct()
    both = ends.join(begins.withColumn("_begins", F.lit(True)), ["fam", "col"], "full_outer")
    before = both.select("fam", F.col("col").alias("i"), F.coalesce(F.max("most").over(along), F.lit(0.0)).alias("prefix"), "_begins").where("_begins").drop("_begins")
    return pairs.join(before, ["fam", "i"]).select("fam", "i", "j", "pscore", "prefix")


def placed(pairs: DataFrame) -> DataFrame:
    """(fam, i, j, place): states of an end column by score, ties to the greater i."""
    w = Window.partitionBy("fam", "j").orderBy(F.col("pscore").desc(), F.col("i").desc())
    return pairs.select("fam", "i", "j", F.row_number().over(w).cast("int").alias("place"))


def best_states(pairs: DataFrame) -> DataFrame:
    """(fam, j, i, pscore): the greatest score of each end column, ties to the lesser i; partial maxima come before the shuffle."""
    best = pairs.groupBy("fam", "j").agg(F.max(F.struct("pscore", (-F.col("i")).alias("less"))).alias("b"))
    return best.select("fam", "j", (-F.col("b.less")).alias("i"), F.col("b.pscore").alias("pscore"))


def _met(t: pa.Table, keys: list[str]) -> pa.Table:
    """States (keys, most, share) of one key become one: the greatest value, and the sum of exponentials as a multiple of its own."""
    groups = t.select(keys).append_column("_at", pa.array(np.arange(t.num_rows))).group_by(keys).aggregate([("_at", "list")])
    lists = groups.column("_at_list").combine_chunks()
    at, first = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1]
    value, share = t.column("most").to_numpy()[at], t.column("share").to_numpy()[at]
    most = np.maximum.reduceat(value, first) if len(first) else value
    own = np.repeat(most, np.diff(np.append(first, len(at))))
    with np.errstate(invalid="ignore"):
        scaled = np.where(value == own, share, share * np.exp(value - own))
    return groups.select(keys).append_column("most", pa.array(most)).append_column("share", pa.array(np.add.reduceat(scaled, first) if len(first) else scaled))


def log_sum(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, lse: the logarithm of the sum of exponentials; null where a group has no value.

    The sum is one state that merges: the greatest value, and the sum as a multiple of its exponential. Each task brings
    the rows of a key down to a state, at most STATES keys at a time, and the states meet in one shuffle.
    """
    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = batch.column(len(keys))
            known = np.asarray(x.is_valid())
            most = np.where(known, x.fill_null(0).to_numpy(zero_copy_only=False), -np.inf)
            own = pa.table([*batch.columns[: len(keys)], pa.array(most), pa.array(known.astype(float))], names=[*keys, "most", "share"])
            held = _met(own if held is None else pa.concat_tables([held, own]), list(keys))
            if held.num_rows >= STATES:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    states = values.select(*keys, F.col(value).cast("double")).mapInArrow(run, f"{kinds}, most double, share double")
    whole = states.groupBy(*keys).agg(F.max("most").alias("_m"), F.collect_list(F.struct("most", "share")).alias("_s"))  # a few states a task
    total = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + x.share * F.when(x.most == F.col("_m"), 1.0).otherwise(F.exp(x.most - F.col("_m"))))
    return whole.select(*keys, F.when(total > 0, F.col("_m") + F.log(total)).when(F.isnan("_m"), F.col("_m")).alias("lse"))


def log_plus_one(x: Column) -> Column:
    """log(1 + e^x)."""
    return F.log1p(F.exp(x))


def cut_exp(x: Column) -> Column:
    """e^x, 0 below and a fixed value above the range that matters."""
    return F.when(x < FAST_LOW, 0.0).when(x > FAST_HIGH, FAST_TOP).otherwise(F.exp(x))
