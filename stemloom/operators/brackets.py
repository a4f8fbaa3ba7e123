"""Bracket strings as a table function: the pairs of a structure in the order in which they close.

``bracket_pairs`` is a Python table function for lateral joins; ``register`` makes
it known to SQL, as in ``SELECT p.* FROM s, LATERAL bracket_pairs(s.structure) p``.
A structure with a bracket that closes nothing gives one row of nulls; brackets
that stay open are no pairs; a null or empty text gives no rows; other characters
than the eight brackets are passed over. Memory is that of what is open and of
the pairs of one structure.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# fixed values: the four kinds of brackets
OPENS, CLOSES = "([{<", ")]}>"
PAIRS = "nth int, kind int, i int, j int"


class BracketPairs:
    def eval(self, structure: str) -> Iterator[tuple]:
        waiting: list[list[int]] = [[] for _ in OPENS]
        pairs = []
        for at, c in enumerate(structure or ""):
            kind = OPENS.find(c)
            if kind >= 0:
                waiting[kind].append(at)
            elif (kind := CLOSES.find(c)) >= 0:
                if not waiting[kind]:
                    yield None, None, None, None
                    return
                pairs.append((len(pairs), kind, waiting[kind].pop(), at))
        yield from pairs


bracket_pairs = udtf(BracketPairs, returnType=PAIRS)


def register(spark: SparkSession, name: str = "bracket_pairs") -> None:
    spark.udtf.register(name, bracket_pairs)


def closing_pairs(structures: DataFrame, structure: str = "structure") -> DataFrame:
    """The other columns of ``structures`` with (nth, kind, i, j) of each pair: a lateral join with the table function."""
    rest = [c for c in structures.columns if c != structure]
    return structures.lateralJoin(bracket_pairs(F.col(structure).outer())).select(*rest, "nth", "kind", "i", "j")
