"""Greatest matchings of predicted pairs to gold pairs whose ends may be off by one, over tables.

The graph has an edge for each predicted and gold pair that are equal or differ
by one at one end (``probabilities.slip_edges``). Its components are found with
joins, by labels that shrink and point on, and cut from their lineage now and
then; inside a component, a matching is grown by whole layers of shortest
augmenting paths. A component lies along one helix, so it is small however many
structures there are and however wide they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.functions.matching import greatest_matching
from stemloom.operators.probabilities import free_columns, slip_edges
from stemloom.sources.shared import cut

SMALL = 1e-10
#: Rounds between two lineage cuts.
ROUNDS = 4


def components(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, a, part: the least node of the component of each node of (keys, a, b), where nodes are comparable and edges go both ways.

    Each round a node takes the least label of its neighbours and then that label's own label, so chains shrink faster than
    step by step; rounds end when no label changes.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = both.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("part"))
    n = 0
    while True:
        n += 1
        around = both.join(labels.select(*keys, F.col("a").alias("b"), F.col("part").alias("near")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("near").alias("near"))
        lower = labels.join(around, [*keys, "a"]).select(*keys, "a", F.least("part", "near").alias("lower"), F.col("part").alias("was"))
        onward = lower.select(*keys, F.col("a").alias("lower"), F.col("lower").alias("onward"))
        new = lower.join(onward, [*keys, "lower"], "left").select(*keys, "a", F.least("lower", F.coalesce("onward", "lower")).alias("part"), "was")
        if n % ROUNDS == 0 or n == 1:
            new = cut(new)
            if new.where("part < was").isEmpty():
                return new.drop("was")
        labels = new.drop("was")


def matched_slips(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(fam, i, j, gi, gj): a greatest matching of the predicted pairs to gold pairs of their own, equal or with one end off by one.

    Repeated pairs count once. Which of several greatest matchings is taken is fixed by the order of the pairs.
    """
    edges = slip_edges(predicted.select("fam", "i", "j").distinct(), gold.select("fam", "i", "j").distinct())
    node = lambda side, i, j: F.struct(F.lit(side).alias("side"), F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"))
    graph = cut(edges.select("fam", "i", "j", "gi", "gj", node(0, "i", "j").alias("a"), node(1, "gi", "gj").alias("b")))
    parts = components(graph, "fam")
    own = graph.join(parts, ["fam", "a"]).select("fam", "part", *[F.col(c).cast("int").alias(c) for c in ("i", "j", "gi", "gj")])
    kind = own.schema["fam"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("i", "j", "gi", "gj")), strict=True))
        found = [(*a, *b) for a, b in greatest_matching((r[:2], r[2:]) for r in rows).items()]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.table({"fam": pa.array([t.column("fam")[0].as_py()] * len(found), t.schema.field("fam").type)} | {c: pa.array(x, pa.int32()) for c, x in zip(("i", "j", "gi", "gj"), columns, strict=True)})

    return own.groupBy("fam", "part").applyInArrow(run, f"fam {kind}, i int, j int, gi int, gj int")


def compared(predicted: DataFrame, gold: DataFrame, spine: DataFrame) -> DataFrame:
    """fam, hit, predicted, gold, prec, sens, f1, sd of two structures as pairs, hits being those of ``matched_slips``.

    A hit stands where its gold pair is: a column is free in the prediction if it is in no hit's gold pair and in no predicted
    pair that is no hit. ``sd`` is the columns less twice the hits and less those free in both.
    """
    p, g = (x.select("fam", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct() for x in (predicted, gold))
    match = cut(matched_slips(p, g))
    count = lambda df, name: df.groupBy("fam").agg(F.count("*").cast("int").alias(name))
    placed = p.join(match.select("fam", "i", "j"), ["fam", "i", "j"], "left_anti").unionByName(match.select("fam", F.col("gi").alias("i"), F.col("gj").alias("j")))
    free = count(free_columns(placed, spine, "fam").join(free_columns(g, spine, "fam"), ["fam", "col"], "left_semi"), "free")
    whole = count(spine.select("fam", "col").distinct(), "width")
    for df, name in ((match, "hit"), (p, "predicted"), (g, "gold")):
        whole = whole.join(count(df, name), "fam", "left")
    whole = whole.join(free, "fam", "left").fillna(0)
    prec, sens = F.col("hit") / (F.col("predicted") + SMALL), F.col("hit") / (F.col("gold") + SMALL)
    return whole.select("fam", "hit", "predicted", "gold", prec.alias("prec"), sens.alias("sens"), (2 * prec * sens / (prec + sens + SMALL)).alias("f1"), (F.col("width") - 2 * F.col("hit") - F.col("free")).alias("sd"))
