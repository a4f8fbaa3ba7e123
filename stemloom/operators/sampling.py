"""Seeded samples of sequences, and copies of results that stand for several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the least length of sequences of some families
LEAST_LENGTH = {"SRP": 200, "16S": 1200}


def long_enough(rows: DataFrame, family: Column, least: dict[str, int] | None = None) -> DataFrame:
    """Rows whose text has the least length of their family, 1 for families not listed."""
    bound = F.lit(1)
    for name, n in (LEAST_LENGTH if least is None else least).items():
        bound = F.when(family == name, n).otherwise(bound)
    return rows.where(F.length("text") >= bound)


def sampled_sets(rows: DataFrame, k: int, count: int, seed: int = 0, by: str = "fam", key: str = "seq") -> DataFrame:
    """The columns of ``rows`` and replicate: ``count`` sets of k rows of each family, each without replacement.

    Rows are ranked by a digest of seed, replicate and key, so the same seed gives the same sets anywhere; a task keeps k of
    each set before the shuffle. Families of fewer than k rows raise an error.
    """
    size = rows.groupBy(by).agg(F.count("*").alias("_n"))
    fine = size.select(by, F.when(F.col("_n") < k, F.raise_error(F.lit(f"a family has fewer than {k} sequences"))).otherwise(F.lit(True)).alias("_fine"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy(by, "replicate").orderBy(digest, key)
    kept = drawn.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")
    return kept.join(fine.where("_fine"), by).drop("_fine")


def repeated(values: DataFrame, by: str, times: int) -> DataFrame:
    """The same rows with ``copy``: the one result of a family that has one only counts ``times`` times."""
    n = F.count("*").over(Window.partitionBy(by))
    return values.withColumn("_n", n).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_n") == 1, times).otherwise(1)))).drop("_n")
