"""Writers of folding results as text files, one directory a call, and reports for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probability_lines(probabilities: DataFrame) -> DataFrame:
    """(msa, value): one text an alignment, its lines ``i j p`` counted from 1 for pairs at least four columns apart, in order, and an empty line."""
    listed = probabilities.where("prob > 0 and j >= i + 4").groupBy("msa").agg(F.sort_array(F.collect_list(F.struct("i", "j", "prob"))).alias("rows"))
    lines = F.transform("rows", lambda r: F.format_string("%d %d %.4e", r.i + 1, r.j + 1, r.prob))
    return listed.select("msa", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def write_probabilities(probabilities: DataFrame, path: str, mode: str = "append") -> None:
    """A folder for each alignment; the pairs of one alignment are at most beam times columns."""
    probability_lines(probabilities).write.mode(mode).partitionBy("msa").text(path)


def report(folded: DataFrame) -> Column:
    """A line for people of each row of ``fold``."""
    return F.format_string("Minimum Free Energy: %.2f kcal/mol\n\nMFE Structure: \n%s (%.2f = %.2f + %.2f)", folded.mfe, folded.structure, folded.mfe, folded.energy, folded.covariation)


def write_structures(found: DataFrame, column: str, path: str, header: str | None = None, mode: str = "overwrite") -> None:
    """One structure an alignment, under a header line if there is one; ``{gamma}`` and ``{pmcc}`` in it are replaced by the row's."""
    text = F.col(column)
    if header is not None:
        title = F.replace(F.lit(header), F.lit("{gamma}"), F.format_string("%.2f", F.col("gamma"))) if "{gamma}" in header else F.lit(header)
        if "{pmcc}" in header:
            title = F.replace(title, F.lit("{pmcc}"), F.when(F.col("pmcc").isNull(), "").otherwise(F.format_string("(pmcc = %.4f) ", F.col("pmcc"))))
        text = F.concat(title, F.lit("\n"), text)
    found.select("msa", text.alias("value")).write.mode(mode).partitionBy("msa").text(path)


def write_fasta(msa: DataFrame, path: str, gaps: bool = True, mode: str = "overwrite") -> None:
    """(msa, seq, name, text) as one file of two lines a sequence in each alignment's folder, in order of seq."""
    text = F.upper(F.col("text")) if gaps else F.upper(F.replace(F.col("text"), F.lit("-"), F.lit("")))
    lines = msa.select("msa", "seq", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), text).alias("value"))
    lines.repartition("msa").sortWithinPartitions("msa", "seq").select("msa", "value").write.mode(mode).partitionBy("msa").text(path)
