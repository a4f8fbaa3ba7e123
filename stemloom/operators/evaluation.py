"""Predicted structures of files against known ones: tables of metrics by file and by family.

Files are paired by name: the prediction of ``name`` is ``name.txt``. Everything is a
join on the name; only the comparison of two structures is a function of a row.
Inputs without a prediction are left out, or an error with ``strict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import structures as st
from stemloom.operators import columns as C
from stemloom.operators import probabilities as B
from stemloom.operators import regions as R
from stemloom.operators import sampling
from stemloom.sources import files
from stemloom.sources.alignments import cells_of

METRICS = "precision double, sensitivity double, f1 double, distance int"
#: Families that are not judged.
LEFT_OUT = ("23S",)


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumn("file", files.base_name())


def _inputs(spark: SparkSession, path: str) -> DataFrame:
    return _named(files.lines_of(spark, path, "*.{fasta,txt}"))


def _predictions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the predictions under the names of their inputs."""
    return _named(files.lines_of(spark, path, "*.txt")).withColumn("file", F.regexp_replace("file", r"\.txt$", ""))


def _joined(inputs: DataFrame, found: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return inputs.join(found, "file")
    there = found.withColumn("_there", F.lit(True))
    missing = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no prediction of "), F.col("file")))).otherwise(F.lit(True))
    return inputs.join(there, "file", "left").where(missing).drop("_there")


def _measured(rows: DataFrame, length: Column, gold: Column, predicted: Column, slip: bool) -> DataFrame:
    """``rows`` with the metrics of gold and predicted structures, each a struct of pairs (i, j) and free columns."""
    whole = rows.withColumns({"_length": length, "_gold": gold, "_predicted": predicted})
    keep = [c for c in rows.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + METRICS

    def both(x: dict) -> tuple[list[tuple[int, int]], list[int]]:
        return [(p["i"], p["j"]) for p in x["pairs"]], x["free"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [st.scores(n, both(g), both(p), slip) for n, g, p in zip(b.column("_length").to_pylist(), b.column("_gold").to_pylist(), b.column("_predicted").to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, (*[pa.float64()] * 3, pa.int32()), strict=True))], names=[*keep, "precision", "sensitivity", "f1", "distance"])

    return whole.mapInArrow(run, fields)


def _as_struct(text: Column) -> Column:
    """A bracket string as pairs and free columns, by one small function a text."""

    @F.pandas_udf("struct<pairs: array<struct<i: int, j: int>>, free: array<int>>")
    def parse(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [st.parsed(t) for t in texts]
        return pd.DataFrame({"pairs": [[{"i": i, "j": j} for i, j in p] for p, _ in found], "free": [f for _, f in found]})

    return parse(text)


def summary(metrics: DataFrame, family: str = "family") -> DataFrame:
    """A row a family, in percent: mean precision and sensitivity, and least, mean and greatest F1 and distance."""
    return metrics.groupBy(family).agg(
        *[(100 * F.avg(c)).alias(c) for c in ("precision", "sensitivity")],
        (100 * F.min("f1")).alias("f1_least"), (100 * F.avg("f1")).alias("f1"), (100 * F.max("f1")).alias("f1_most"),
        F.min("distance").alias("distance_least"), F.avg("distance").alias("distance"), F.max("distance").alias("distance_most"),
    )


def overall(summaries: DataFrame) -> DataFrame:
    """Means of the families' means."""
    return summaries.agg(F.avg("f1").alias("f1"), F.avg("distance").alias("distance"))


def reference_rows(lines: DataFrame, mark: str) -> DataFrame:
    """(file, text): the line after the first header that begins with ``mark``; the second line of files whose first has it anywhere."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("at")
    rows = lines.select("file", "at", "line", F.lead("line").over(w).alias("following"), F.first("line").over(w).contains(mark).alias("head"))
    hit = rows.where(F.col("line").startswith(">" + mark) | F.col("head"))
    return hit.groupBy("file").agg(F.trim(F.min_by("following", "at")).alias("text"))


def region_metrics(spark: SparkSession, data: str, predicted: str, gold: str, mark: str = "Wuhan", last: bool = False, pad: bool = False, strict: bool = True, slip: bool = False, r: R.Regions = R.Regions()) -> DataFrame:
    """file, family, ordinal and metrics of consensus structures on the reference row of each alignment, in two joined regions; ``gold`` is the joined bracket string.

    Pairs that the row's bases can't form, or that don't lie in the regions, count as unpaired. ``pad`` fills short
    predictions with dots; otherwise unequal lengths are an error.
    """
    rows = reference_rows(_inputs(spark, data), mark)
    found = _joined(rows, files.structure(_predictions(spark, predicted), last), strict)
    text = R.padded(F.col("structure"), F.length("text")) if pad else F.col("structure")
    same = F.when(F.length("structure") == F.length("text"), F.col("structure")).otherwise(F.raise_error(F.concat(F.lit("prediction and row differ in length: "), F.col("file"))))
    found = found.select("file", F.upper("text").alias("text"), text.alias("structure")).select("file", "text", same.alias("structure"))

    @F.pandas_udf("string")
    def on_regions(structure, row):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for s, t in zip(structure, row, strict=True):
            place = [-1]
            for c in t:
                place.append(place[-1] + (c != "-"))
            marks = ["."] * (place[-1] + 1)
            inside = lambda k: k <= r.first or r.low <= k <= r.high
            for i, j in st.parsed(s)[0]:
                a, b = place[i + 1], place[j + 1]
                if t[i] + t[j] in st.CANONICAL and inside(a) and inside(b) and r.first not in (a, b):
                    marks[a], marks[b] = s[i], s[j]
            out.append("".join(marks))
        return pd.Series(out)

    joined = found.select("file", r.joined(on_regions("structure", "text")).alias("structure"))
    measured = _measured(joined, F.lit(len(gold)), _as_struct(F.lit(gold)), _as_struct(F.col("structure")), slip)
    return _with_family(measured)


def _with_family(rows: DataFrame) -> DataFrame:
    part = lambda k: F.split_part(F.col("file"), F.lit("_"), F.lit(k))
    return rows.withColumn("family", F.concat(part(1), F.lit("_"), part(2))).withColumn("ordinal", part(2).try_cast("int"))


def region_summary(metrics: DataFrame, leave_first: bool = False, times: int = 10) -> DataFrame:
    """``summary`` by family in order of number; the one result of family k_1 counts ``times`` times, or is left out."""
    kept = metrics.where("family <> 'k_1'") if leave_first else sampling.repeated(metrics, "family", times)
    return summary(kept).orderBy(F.split_part("family", F.lit("_"), F.lit(2)).try_cast("int"))


def region_defects(spark: SparkSession, data: str, predicted: str, gold: str, zero_based: bool = False, r: R.Regions = R.Regions()) -> DataFrame:
    """file, family, ordinal, defect: the ensemble defect of pair probabilities in the two regions, on each alignment's first row.

    As many lines are skipped as the family's number says. ``gold`` is the joined bracket string.
    """
    rows = _inputs(spark, data).where("at = 1").select(F.col("file"), F.upper(F.trim("line")).alias("text"))
    lines = _with_family(_predictions(spark, predicted))
    probs = files.probabilities(lines.where(F.col("at") >= F.col("ordinal")), zero_based=zero_based)
    msa = rows.select(F.col("file").alias("fam"), F.lit(0).alias("seq"), "text")
    cells = cells_of(msa, "fam")
    found = R.within(B.on_rows(probs.withColumnRenamed("file", "fam"), cells, C.ungapped_positions(cells)).select("fam", "i", "j", "prob"), r)
    pairs, free = st.parsed(gold)
    known = R.gold_pairs(spark.createDataFrame(pairs or [(-1, -1)], "i int, j int"), r)
    loose = R.gold_free(spark.createDataFrame([(c,) for c in free] or [(-1,)], "col int"), r)
    own = rows.select("file").join(_predictions(spark, predicted).select("file").distinct(), "file", "left_semi").withColumnRenamed("file", "fam")
    paired = found.join(F.broadcast(known), ["i", "j"]).groupBy("fam").agg(F.sum("prob").alias("paired"))  # the pairs of one structure
    ends = B.both_ends(found).join(F.broadcast(loose), F.col("pos") == F.col("col")).groupBy("fam").agg(F.sum("prob").alias("used"))
    whole = own.join(paired, "fam", "left").join(ends, "fam", "left").fillna(0.0)
    n_free = sum(1 for c in free if not r.first <= c < r.first + r.filler)
    defect = F.lit(len(gold) - r.filler) - 2 * F.col("paired") - (n_free - F.col("used"))
    return _with_family(whole.select(F.col("fam").alias("file"), F.bround(defect, 2).alias("defect")))


def structure_metrics(spark: SparkSession, data: str, predicted: str, gold: str, consensus: bool = False, slip: bool = False, last: bool = False, strict: bool = False) -> DataFrame:
    """file, family, seq, name and metrics of each sequence of each file against its connection table ``gold/name``.

    ``consensus``: a prediction is one structure of the alignment, projected on each row; else it holds one structure a
    sequence, in order, from the end with ``last``. Sequences without a table are an error.
    """
    inputs = _inputs(spark, data).withColumn("family", F.split_part("file", F.lit("."), F.lit(1))).where(~F.col("family").isin(*LEFT_OUT))
    rows = files.fasta_records(inputs.select("file", "at", "line")).withColumnRenamed("msa", "file")
    lines = _predictions(spark, predicted)
    if consensus:
        rows = _joined(rows, files.structure(lines, last, openers="(.<[{"), strict)

        @F.pandas_udf("string")
        def on_row(structure, text):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series([st.projected(s, t) for s, t in zip(structure, text, strict=True)])

        rows = rows.withColumn("structure", on_row("structure", "text"))
    else:
        from pyspark.sql import Window

        order = F.col("at").desc() if last else F.col("at")
        own = lines.where(F.substring("line", 1, 1).isin(*"(.<[{")).select("file", F.trim("line").alias("structure"), (F.row_number().over(Window.partitionBy("file").orderBy(order)) - 1).cast("int").alias("seq"))
        rows = rows.join(own, ["file", "seq"])
    tables = files.lines_of(spark, gold)
    ends = files.connections(tables)
    pair = F.when(F.col("j") >= 0, F.struct("i", "j"))
    known = ends.groupBy("file").agg(F.struct(F.collect_list(pair).alias("pairs"), F.collect_list(F.when(F.col("j") < 0, F.col("i"))).alias("free")).alias("gold")).withColumnRenamed("file", "path")
    # a header names its table by a path below the folder of tables
    root = gold.rstrip("/")
    known = known.withColumn("name", F.regexp_replace(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})"), "^/+", ""))
    met = rows.withColumn("name", F.regexp_replace("name", r"^(\./|/)+", "")).join(known.select("name", "gold"), "name", "left")
    there = F.when(F.col("gold").isNull(), F.raise_error(F.concat(F.lit("no connection table "), F.col("name")))).otherwise(F.col("gold"))
    length = 2 * F.size("gold.pairs") + F.size("gold.free")
    fits = F.when(F.length("structure") == length, F.col("structure")).otherwise(F.raise_error(F.concat(F.lit("structure and table differ in length: "), F.col("name"))))
    base = met.withColumn("gold", there).withColumn("structure", fits).withColumn("family", F.split_part("file", F.lit("."), F.lit(1)))
    measured = _measured(base.select("file", "family", "seq", "name", "structure", "gold"), length, F.col("gold"), _as_struct(F.col("structure")), slip)
    return measured.drop("gold", "structure")


def alignment_summary(spark: SparkSession, data: str) -> DataFrame:
    """family, identity, length of the alignments of a folder; a family is a name's first part."""
    rows = files.alignment_rows(_inputs(spark, data)).select(F.col("msa").alias("fam"), "seq", "text")
    return C.mean_identity(rows, F.split_part("fam", F.lit("."), F.lit(1)))


def sequence_sets(spark: SparkSession, data: str, k: int, count: int, family: str, seed: int = 0) -> DataFrame:
    """(replicate, name, text): ``count`` sets of k sequences of the .seq files of a folder, each long enough for its family."""
    found = files.first_rna(files.lines_of(spark, data, "*.seq")).where("text <> ''").withColumn("family", F.lit(family))
    rows = sampling.long_enough(found, F.col("family"))
    named = rows.withColumn("name", F.concat(F.regexp_replace("file", r"\.seq$", ""), F.lit(".ct")))
    return sampling.sampled_sets(named, k, count, seed, by="family", key="name").select("replicate", "name", "text")


__all__ = ["alignment_summary", "overall", "reference_rows", "region_defects", "region_metrics", "region_summary", "sequence_sets", "structure_metrics", "summary"]
