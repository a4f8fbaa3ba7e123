"""Operators on the columns of alignments: coordinates, neighbours, occupancy, consensus, identities.

``cells`` is (fam, seq, col, code), see ``stemloom.sources.alignments``; ``msa`` is
(fam, seq, text). Any number of alignments of any width is taken; an alignment is
known by ``fam``, of any type. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.sources.shared import written

GAP, OTHER = 5, 4
#: Bins of 5 % of identity start at these; of substitution matrices, there is none below.
LEAST_HIGH, LEAST_LOW = 12, 5


def is_base(code: str = "code") -> Column:
    return F.col(code) != GAP


def ungapped_positions(cells: DataFrame) -> DataFrame:
    """(fam, seq, col, pos): the place of each column's base among the bases of its row; a gap has that of the base before, -1 if none."""
    w = Window.partitionBy("fam", "seq").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.select("fam", "seq", "col", (F.sum(is_base().cast("int")).over(w) - 1).cast("int").alias("pos"))


def bases_before(cells: DataFrame, name: str = "s5") -> DataFrame:
    """The nearest base strictly left in the row, OTHER at its end."""
    w = Window.partitionBy("fam", "seq").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("fam", "seq", "col", F.coalesce(F.last(F.when(is_base(), F.col("code")), ignorenulls=True).over(w), F.lit(OTHER)).cast("int").alias(name))


def bases_after(cells: DataFrame, name: str = "s3") -> DataFrame:
    """The nearest base strictly right in the row, OTHER at its end."""
    w = Window.partitionBy("fam", "seq").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    return cells.select("fam", "seq", "col", F.coalesce(F.first(F.when(is_base(), F.col("code")), ignorenulls=True).over(w), F.lit(OTHER)).cast("int").alias(name))


def occupancy(cells: DataFrame) -> DataFrame:
    """(fam, col, bases, n): how many of the rows have a base there; counted before the shuffle."""
    return cells.groupBy("fam", "col").agg(F.sum(is_base().cast("long")).alias("bases"), F.count("*").alias("n"))


def cumulative_occupancy(cells: DataFrame) -> DataFrame:
    """(fam, col, n, bases_upto, upto): bases in all columns up to this one, and the same as a share of the rows; a row a column is sorted."""
    w = Window.partitionBy("fam").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return occupancy(cells).select("fam", "col", "n", F.sum("bases").over(w).alias("bases_upto"), F.sum(F.col("bases") / F.col("n")).over(w).alias("upto"))


def consensus(cells: DataFrame) -> DataFrame:
    """(fam, col, code): the commonest code of each column, ties to the lesser."""
    counted = cells.groupBy("fam", "col", "code").agg(F.count("*").alias("n"))
    return counted.groupBy("fam", "col").agg(F.min_by("code", F.struct((-F.col("n")).alias("n"), "code")).alias("code"))


def energy_codes(cells: DataFrame) -> DataFrame:
    """Codes of the energy tables: 0 for gaps and unknown bases, then A, C, G, U."""
    return cells.select("fam", "seq", "col", F.when(F.col("code") < OTHER, F.col("code") + 1).otherwise(0).cast("int").alias("base"))


def mean_length(msa: DataFrame) -> DataFrame:
    """(fam, mean_length) of the rows without gaps."""
    return msa.groupBy("fam").agg(F.avg(F.length(F.replace(F.col("text"), F.lit("-"), F.lit("")))).alias("mean_length"))


def ungapped(msa: DataFrame) -> DataFrame:
    """(fam, seq, text) without gaps."""
    return msa.select("fam", "seq", F.replace(F.col("text"), F.lit("-"), F.lit("")).alias("text"))


def pair_identities(msa: DataFrame, block: int = 256) -> DataFrame:
    """(fam, a_seq, b_seq, width, same, both_gap) of the pairs of rows of each alignment, a_seq < b_seq.

    The result itself is quadratic in the rows of an alignment: it is for alignments of thousands of rows. Rows are dealt
    into blocks of about ``block`` by hash and pairs of blocks over tasks, so that no task holds an alignment; rows of
    unequal lengths raise an error.
    """
    sizes = msa.groupBy("fam").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = msa.select("fam", "seq", F.coalesce("text", F.lit("")).alias("text")).join(sizes, "fam")
    own = rows.withColumn("own", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
    dealt = own.select("fam", "seq", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    kinds = {f.name: f.dataType.simpleString() for f in msa.schema}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        texts = t.column("text").to_pylist()
        if len(set(map(len, texts))) > 1:
            raise ValueError("the rows of an alignment must have equal lengths")
        data = np.array([list(x.encode("latin-1", "replace")) for x in texts], np.uint8).reshape(len(texts), -1)
        left = t.column("own").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        out = []
        for k in np.flatnonzero((left == lo) | (left == hi)):
            later = np.arange(k + 1, len(texts))
            later = later[(left[later] == (hi if left[k] == lo else lo))]
            same = data[later] == data[k]
            out.append((np.full(len(later), k), later, same.sum(1), (same & (data[k] == ord("-"))).sum(1)))
        a, b, same, gaps = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, int)] * 4
        seq = t.column("seq").combine_chunks()
        return pa.table({"fam": t.column("fam").combine_chunks().take(pa.array(a)), "a_seq": seq.take(pa.array(a)), "b_seq": seq.take(pa.array(b)), "width": pa.array(np.full(len(a), data.shape[1])), "same": pa.array(same.astype(np.int64)), "both_gap": pa.array(gaps.astype(np.int64))})

    met = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return met.groupBy("fam", "lo", "hi").applyInArrow(run, f"fam {kinds['fam']}, a_seq {kinds['seq']}, b_seq {kinds['seq']}, width long, same long, both_gap long")


def row_identity(msa: DataFrame) -> DataFrame:
    """(fam, a_seq, b_seq, hamming, identity): differing columns, and the percentage of equal ones among those that are no gap in both (0 if none)."""
    aligned = F.col("width") - F.col("both_gap")
    equal = F.col("same") - F.col("both_gap")
    return pair_identities(msa).select("fam", "a_seq", "b_seq", (F.col("width") - F.col("same")).alias("hamming"), F.when(aligned > 0, 100.0 * equal / aligned).otherwise(0.0).alias("identity"))


def _letters(counted: DataFrame) -> DataFrame:
    """(fam, col, letter, n) of (fam, text, n): how many rows have a letter in a column, counted a batch at a time where the rows are."""
    kind = counted.schema["fam"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = pa.Table.from_batches([b.select(["fam"])]).append_column("at", pa.array(np.arange(b.num_rows)))
            for g in of.group_by("fam").aggregate([("at", "list")]).to_pylist():
                own = b.take(pa.array(g["at_list"]))
                data, times = _bytes(own.column("text").to_pylist()), own.column("n").to_numpy()
                for letter in np.unique(data):
                    n = times @ (data == letter)
                    col = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([g["fam"]] * len(col), b.schema.field("fam").type), pa.array(col, pa.int32()), pa.array([int(letter)] * len(col), pa.int32()), pa.array(n[col], pa.int64())], names=["fam", "col", "letter", "n"])

    return counted.mapInArrow(run, f"fam {kind}, col int, letter int, n long").groupBy("fam", "col", "letter").agg(F.sum("n").alias("n"))


def _bytes(texts: list[str]) -> np.ndarray:
    if len(set(map(len, texts))) > 1:
        raise ValueError("the rows of an alignment must have equal lengths")
    return np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), -1)


def _extremes(rows: DataFrame, block: int) -> DataFrame:
    """(fam, least, most) equal columns over all pairs of the distinct rows (fam, text).

    Pairs of blocks of about ``block`` rows are dealt over tasks, and each gives two numbers.
    """
    spark = rows.sparkSession
    kind = rows.schema["fam"].dataType.simpleString()
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sizes = rows.groupBy("fam").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = rows.join(sizes, "fam").withColumn("own", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    dealt = own.select("fam", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = dealt.select("fam", "text", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(t: pa.Table) -> pa.Table:
        data, own = _bytes(t.column("text").to_pylist()), t.column("own").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        left, right = data[own == lo], data[own == hi]
        most, least = -1, data.shape[1] + 1
        for first in range(0, len(left), block):
            part = left[first : first + block]
            for second in range(first if lo == hi else 0, len(right), block):
                other = right[second : second + block]
                same = np.zeros((len(part), len(other)), np.float32)
                for letter in np.intersect1d(part, other):
                    same += (part == letter).astype(np.float32) @ (other == letter).astype(np.float32).T
                found = same[np.triu_indices(len(part), 1)] if lo == hi and first == second else same.ravel()
                if len(found):
                    most, least = max(most, int(found.max())), min(least, int(found.min()))
        there = most >= 0
        return pa.table({"fam": t.column("fam").combine_chunks().slice(0, int(there)), "least": pa.array([least] * there, pa.int64()), "most": pa.array([most] * there, pa.int64())})

    keys = ["fam", "lo", "hi"]
    found = met.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, f"fam {kind}, least long, most long")
    return found.groupBy("fam").agg(F.min("least").alias("least"), F.max("most").alias("most"))


#: Rows furthest from an alignment's commonest letters that are met first.
FURTHEST = 64


def identity_range(msa: DataFrame, block: int = 2048) -> DataFrame:
    """(fam, lo, hi, mean) of the percentage of equal columns over all pairs of rows; gaps in both count as equal. Alignments of one row give none.

    The mean follows from the letters of each column, and an alignment with equal rows has a hi of 100. Two rows differ in no
    more columns than both together differ from the commonest letters: only rows that are far enough from those to differ
    more than the best pair of the furthest few can be in the least pair, and only these meet. Where no rows are equal,
    or all lie equally far, all pairs meet, block by block.
    """
    kind = msa.schema["fam"].dataType.simpleString()
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x{00}-\\x{FF}]", "?")
    counted = written(msa.select("fam", text.alias("text")).groupBy("fam", "text").agg(F.count("*").alias("n")))
    sizes = counted.groupBy("fam").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"), F.min(F.length("text")).alias("width"), F.max(F.length("text")).alias("_most"))
    uneven = F.raise_error(F.lit("the rows of an alignment must have equal lengths"))
    sizes = sizes.select("fam", "rows", "kinds", F.when(F.col("width") < F.col("_most"), uneven).otherwise(F.col("width")).cast("int").alias("width")).where("rows > 1")
    letters = written(_letters(counted))
    equal = letters.groupBy("fam").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("equal"))
    common = letters.groupBy("fam", "col").agg(F.max_by("letter", F.struct("n", "letter")).alias("letter"))
    common = common.groupBy("fam").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "letter"))), lambda x: x.letter).alias("common"))  # at most the columns of an alignment

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, common = b.column("text").to_pylist(), b.column("common")
            far = np.zeros(b.num_rows, np.int64)
            of = pa.Table.from_batches([b.select(["fam"])]).append_column("at", pa.array(np.arange(b.num_rows)))
            for g in of.group_by("fam").aggregate([("at", "list")]).to_pylist():
                at = g["at_list"]
                far[at] = (_bytes([texts[k] for k in at]) != np.array(common[at[0]].as_py(), np.uint8)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("fam"), b.column("text"), pa.array(far)], names=["fam", "text", "far"])

    spread = counted.join(sizes.where("kinds > 1 and width > 0").select("fam"), "fam").join(common, "fam").select("fam", "text", "common")
    rows = written(spread.mapInArrow(distances, f"fam {kind}, text string, far long"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("fam").orderBy(F.desc("far"), "text"))).where(F.col("k") <= FURTHEST)
    known = _extremes(first.select("fam", "text"), block).select("fam", F.col("least").alias("first"))
    bound = written(known.join(rows.groupBy("fam").agg(F.max("far").alias("top")), "fam").join(sizes, "fam"))
    able = (F.col("rows") == F.col("kinds")) | (F.col("far") + F.col("top") > F.col("width") - F.col("first"))
    found = _extremes(rows.join(bound, "fam").where(able).select("fam", "text"), block)
    whole = sizes.join(equal, "fam", "left").join(bound.select("fam", "first"), "fam", "left").join(found, "fam", "left")
    least = F.coalesce(F.least("first", "least"), F.col("width"))
    most = F.when(F.col("rows") > F.col("kinds"), F.col("width")).otherwise(F.coalesce("most", "width"))
    share = lambda x: 100.0 * x / F.greatest("width", F.lit(1))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    return whole.select("fam", share(least).alias("lo"), share(most).alias("hi"), (share(F.coalesce("equal", F.lit(0.0))) / pairs).alias("mean"))


def identity_bins(msa: DataFrame) -> DataFrame:
    """(fam, max_bin, min_bin): bins of the greatest and the least identity, which choose the substitution matrix; null for all-equal rows."""
    whole = identity_range(msa).where(F.col("lo") + 0.5 <= 100.45)
    top = F.greatest(F.lit(LEAST_HIGH), F.floor(F.floor(F.col("hi") + 0.5) / 5))
    low = F.greatest(F.lit(LEAST_LOW), F.floor(F.floor(F.col("lo") + 0.5) / 5))
    return whole.select("fam", top.cast("int").alias("max_bin"), F.least(low, top - 1).cast("int").alias("min_bin"))


def mean_identity(msa: DataFrame, family: Column) -> DataFrame:
    """(family, identity, length): the mean over a family's alignments of their mean row identity, and the mean length without gaps; an alignment of one row has no identity."""
    own = msa.select("fam", family.alias("family")).distinct()
    each = row_identity(msa).groupBy("fam").agg(F.avg("identity").alias("identity"))
    rows = msa.select(family.alias("family"), F.length(F.replace(F.col("text"), F.lit("-"), F.lit(""))).alias("n")).groupBy("family").agg(F.avg("n").alias("length"))
    return own.join(each, "fam").groupBy("family").agg(F.avg("identity").alias("identity")).join(rows, "family")


def checked(msa: DataFrame, letters: str = "ACGUN-") -> DataFrame:
    """The same rows; an error where an alignment has rows of other letters or of unequal lengths. One row an alignment is compared."""
    sizes = msa.groupBy("fam").agg(F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"), F.max(F.length(F.translate("text", letters, ""))).alias("odd"))
    said = F.when(F.col("odd") > 0, F.raise_error(F.lit("letters other than " + letters))).when(F.col("least") != F.col("most"), F.raise_error(F.lit("the rows of an alignment must have equal lengths"))).otherwise(F.lit(True))
    return msa.join(sizes.select("fam", said.alias("fine")).where("fine"), "fam").select(*msa.columns)

