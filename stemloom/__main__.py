"""Command line: ``python -m stemloom fold`` for alignments, and the tools that judge, sample and lay out files.

``fold`` reads alignments from files, folders or, without paths, the standard
input; its flags are those that users of consensus folding know.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stemloom.operators import evaluation as ev
from stemloom.operators.folding import Model, explored, fold, listed_pairs, listed_samples, observed
from stemloom.sources import files, sinks


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemloom")
    tools = p.add_subparsers(dest="tool", required=True)
    f = tools.add_parser("fold", help="consensus structures of alignments")
    f.add_argument("paths", nargs="*", help="files or folders; the standard input without any")
    f.add_argument("-v", "--verbose", action="store_true", help="parameters, seconds and numbers of states")
    f.add_argument("-b", "--beam", type=int, default=100, help="0 for an exact search")
    f.add_argument("-e", "--energy-model", type=int, choices=[1, 2], default=2, help="1: the set of --parameters; 2: the built-in one")
    f.add_argument("--parameters", help="energy file of the 2.0 text format")
    f.add_argument("--small-loops", help="CSV of loop, t1, t2, a, b, c, d, energy with a header: 1x1, 1x2 and 2x2 internal loops")
    f.add_argument("--substitutions", help="CSV of max_bin, min_bin, k, l, value with a header")
    f.add_argument("-p", "--partition", action="store_true")
    f.add_argument("-s", "--sample", type=int, default=0)
    f.add_argument("--seed", type=int, default=0)
    f.add_argument("-c", "--cutoff", type=int, default=-40)
    f.add_argument("-y", "--beta", type=float, default=1.2)
    f.add_argument("-z", "--delta", type=float, default=0.1)
    f.add_argument("-g", "--gamma", type=float, default=2)
    f.add_argument("-t", "--threshknot-threshold", type=float, default=0.3)
    for short, name in (("-B", "bpp"), ("-M", "mea"), ("-T", "threshknot"), ("-C", "centroid")):
        f.add_argument(short, f"--{name}-file", default="", help="folder for one file an alignment")
    f.add_argument("-m", "--multi-approx", action="store_true")
    f.add_argument("-o", "--non-lazy", action="store_true", help="visit all states on the way back")
    for name in ("regions", "defects", "structures"):
        t = tools.add_parser(name)
        t.add_argument("-d", "--data-path", required=True)
        t.add_argument("-p", "--pred-path", required=True)
        t.add_argument("-g", "--gold", required=True, help="a file with the joined structure" if name != "structures" else "folder of connection tables")
        t.add_argument("--skip-seq", action="store_true")
        t.add_argument("--backsearch", action="store_true")
        t.add_argument("--slip", "--allow-slip", action="store_true")
        t.add_argument("--adjust-length", action="store_true")
        t.add_argument("--ignore-k1", action="store_true")
        t.add_argument("--zero-based-idx", action="store_true")
        t.add_argument("--cnsns", action="store_true")
    t = tools.add_parser("identity")
    t.add_argument("-d", "--data-path", required=True)
    t = tools.add_parser("sample")
    for flag in ("-i", "-o", "-f"):
        t.add_argument(flag, required=True)
    t.add_argument("-k", type=int, default=30)
    t.add_argument("-c", type=int, default=10)
    t.add_argument("--seed", type=int, default=0)
    t = tools.add_parser("truth")
    for flag in ("--input", "--database", "--output"):
        t.add_argument(flag, required=True)
    return p


def folding(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.energy_model == 1 and not a.parameters:
        raise SystemExit("energy model 1 needs --parameters")
    tables = None
    if a.substitutions:
        from stemloom.operators.folding import substitution_tables

        tables = substitution_tables(spark.read.csv(a.substitutions, header=True, schema="max_bin int, min_bin int, k int, l int, value double"))
    loops = None
    if a.small_loops:
        rows = spark.read.csv(a.small_loops, header=True, schema="loop string, t1 int, t2 int, a int, b int, c int, d int, energy int").dropDuplicates(["loop", "t1", "t2", "a", "b", "c", "d"])
        loops = tuple(tuple(r) for r in rows.collect())  # at most about 50,000, by its keys
    m = Model(a.beam, a.cutoff, a.beta, a.delta, a.gamma, a.threshknot_threshold, a.multi_approx, not a.non_lazy, parameters=Path(a.parameters).read_text() if a.parameters else None, loops=loops, tables=tables)
    if a.paths:
        msa = files.read_msa(spark, a.paths).withColumn("msa", files.base_name("msa"))
    else:  # one alignment that is typed in: its text goes to the executors as a row
        typed = spark.createDataFrame([("standard input", sys.stdin.read())], "file string, value string")
        msa = files.alignment_rows(files.split_lines(typed))
    began, watched = time.time(), Observation("sweep") if a.verbose else None
    in_order = files.natural("msa")
    if a.verbose:
        print(" ".join(f"{k}={v}" for k, v in vars(a).items() if k != "paths"))
    if a.sample:
        found = explored(msa, m, structures=False, probabilities=False, count=a.sample, seed=a.seed, watched=watched).persist()
        show(listed_samples(found).orderBy(in_order, "sample"), "structure")
    elif a.partition:
        found = explored(msa, m, probabilities=bool(a.bpp_file), watched=watched).persist()
        title = F.when(F.col("pmcc").isNull(), F.format_string("(gamma = %.2f)", F.col("gamma"))).otherwise(F.format_string("(pmcc = %.4f, gamma = %.2f)", F.col("pmcc"), F.col("gamma")))
        show(found.orderBy(in_order), F.format_string("Free Energy of Ensemble: %.2f kcal/mol\n\nThreshKnot Structure:\n%s\n\nCentroid Structure %s:\n%s\n\nMEA Structure (gamma = %.2f):\n%s", F.col("printed"), F.col("threshknot"), title, F.col("centroid"), F.col("gamma"), F.col("mea")))
        if a.bpp_file:
            sinks.write_probabilities(listed_pairs(found), a.bpp_file)
        for path, column, header, mode in ((a.mea_file, "mea", "MEA Structure (gamma = {gamma}):", "append"), (a.threshknot_file, "threshknot", None, "overwrite"), (a.centroid_file, "centroid", "Centroid Structure {pmcc}(gamma = {gamma}):", "overwrite")):
            if path:
                sinks.write_structures(found, column, path, header, mode)
    else:
        found = fold(msa, m, watched).persist()
        show(found.orderBy(in_order), sinks.report(found))
    if watched:
        found.count()  # of what is held; the metrics are those of the run that filled it
        print(f"{time.time() - began:.2f} seconds")
        for chart, reached, kept, edges in observed(watched):
            print(f"{chart}: {reached} states reached, {kept} kept, {edges} edges")
    found.unpersist()


def show(df: DataFrame, text) -> None:
    """Lines of a report, as they come from the executors."""
    for r in df.select("msa", F.expr(text).alias("text") if isinstance(text, str) else text.alias("text")).toLocalIterator():
        print(r.msa, r.text, sep="\n")


def table(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print("\t".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stemloom").getOrCreate()
    if a.tool == "fold":
        folding(spark, a)
    elif a.tool == "regions":
        found = ev.region_metrics(spark, a.data_path, a.pred_path, Path(a.gold).read_text().strip(), last=a.backsearch, pad=a.adjust_length, strict=not a.skip_seq, slip=a.slip)
        whole = ev.region_summary(found, a.ignore_k1)
        table(whole)
        table(ev.overall(whole))
    elif a.tool == "defects":
        found = ev.region_defects(spark, a.data_path, a.pred_path, Path(a.gold).read_text().strip(), a.zero_based_idx)
        table(found.groupBy("family", "ordinal").agg(F.avg("defect").alias("defect")).orderBy("ordinal"))
    elif a.tool == "structures":
        whole = ev.summary(ev.structure_metrics(spark, a.data_path, a.pred_path, a.gold, a.cnsns, a.slip, a.backsearch, not a.skip_seq)).orderBy("family")
        table(whole)
        table(ev.overall(whole))
    elif a.tool == "identity":
        table(ev.alignment_summary(spark, a.data_path).orderBy("family"))
    elif a.tool == "sample":
        found = ev.sequence_sets(spark, a.i, a.k, a.c, a.f, a.seed)
        sinks.write_fasta(found.select(F.col("replicate").alias("msa"), F.col("name").alias("seq"), "name", "text"), a.o)
    else:
        found = files.ground_truth(files.lines_of(spark, a.input, "*.fasta"), files.lines_of(spark, a.database, "*.fasta"))
        sinks.write_fasta(found.select(files.base_name().alias("msa"), F.col("at").alias("seq"), F.expr("substring(header, 2)").alias("name"), "text"), a.output)


if __name__ == "__main__":
    main()
