"""Structures of long sequences judged on two regions: the first columns, and a stretch near the end, joined by filler columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.operators.pairs import pair_code


class Regions(NamedTuple):
    """Columns 0 … first - 1 and low … high - 1, with ``filler`` columns between them where they are joined."""

    first: int = 400
    low: int = 29_493
    high: int = 29_999
    filler: int = 10

    def holds(self, c: Column) -> Column:
        """In either region, the column after each one's last included."""
        return c.between(0, self.first) | c.between(self.low, self.high)

    def joined(self, text: Column) -> Column:
        return F.concat(F.substring(text, 1, self.first), F.lit("." * self.filler), F.substring(text, self.low + 1, self.high - self.low))

    def whole(self, c: Column) -> Column:
        """The column of the sequence that a column of the joined regions stands for."""
        return F.when(c >= self.first + self.filler, c + self.low - self.first - self.filler).otherwise(c)


def padded(text: Column, length: Column) -> Column:
    """Dots put at the end of what is shorter."""
    return F.when(F.length(text) < length, F.rpad(text, length, F.lit("."))).otherwise(text)


def within(pairs: DataFrame, r: Regions) -> DataFrame:
    """Pairs with both ends in the regions and none in the column after the first."""
    i, j = F.col("i"), F.col("j")
    return pairs.where(r.holds(i) & r.holds(j) & (i != r.first) & (j != r.first))


def leaving(pairs: DataFrame, r: Regions) -> DataFrame:
    """Pairs that go from a region to the columns between them."""
    i, j = F.col("i"), F.col("j")
    return pairs.where((i.between(0, r.first) & ~r.holds(j)) | (j.between(r.low, r.high) & ~r.holds(i)))


def gold_pairs(pairs: DataFrame, r: Regions) -> DataFrame:
    """Pairs of a joined structure, in the sequence's columns."""
    return pairs.withColumn("i", r.whole(F.col("i"))).withColumn("j", r.whole(F.col("j")))


def gold_free(free: DataFrame, r: Regions) -> DataFrame:
    """Free columns of a joined structure, filler left out, in the sequence's columns."""
    return free.where(~F.col("col").between(r.first, r.first + r.filler - 1)).withColumn("col", r.whole(F.col("col")))


def spine(length: int, r: Regions) -> list[int]:
    """Columns that count as free unless they are paired."""
    return [*range(r.first), *range(r.low, max(length, r.low))]


__all__ = ["Regions", "gold_free", "gold_pairs", "leaving", "padded", "pair_code", "spine", "within"]
