"""Queries that read, pair, judge and write files of the formats of ``sources.files``, over lines derived from documents.

A document's alignment row is laid out as the lines of a file of each format, so
every line of every file is read; the SQL says what comes back without a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators import columns as C
from stemloom.operators import loops, probabilities, regions
from stemloom.operators import sampling
from stemloom.sources import files, sinks
from stemloom.sources.alignments import WIDTH, cells_of, document_msa, nation_msa

SMALL = regions.Regions(first=10, low=20, high=31, filler=4)


def laid_out(msa: DataFrame, *lines) -> DataFrame:
    """(file, at, line) of a file for each row of an alignment."""
    name = F.concat(F.lit("src"), F.col("fam"), F.lit("/d"), F.col("seq"))
    return msa.select(name.alias("file"), F.posexplode(F.array(*lines)).alias("at", "line"))


def wrapped(msa: DataFrame) -> DataFrame:
    part = lambda a, b: F.lower(F.substring("text", a, b))
    return laid_out(msa, F.lit(";a note"), F.concat(F.lit(">src"), F.col("fam"), F.lit("/d"), F.col("seq"), F.lit(".ct")), part(1, 12), part(13, 12), F.lit(""), part(25, 8))


def msa_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.alignment_rows(wrapped(document_msa(spark, sf_dir)))


def fasta_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.fasta_records(wrapped(document_msa(spark, sf_dir)))


def seq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = F.replace(F.col("text"), F.lit("-"), F.lit(""))
    rows = files.first_rna(laid_out(document_msa(spark, sf_dir), F.lit("; entry"), F.lit("name x"), F.concat(bases, F.lit("11")), F.lit("ACGU1")))
    return sampling.long_enough(rows, F.split_part("file", F.lit("/"), F.lit(1)), {"src0": 31, "src1": 30})


def structure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = laid_out(document_msa(spark, sf_dir), F.lit("energy -1.0"), F.lit(""), F.translate("text", "ACGU-", ".()(."), F.concat(F.translate("text", "ACGU-", "(.)(."), F.lit(" (-0.5)")), F.lit("end"))
    first, last = files.structure(lines), files.structure(lines, last=True)
    return first.withColumnRenamed("structure", "first").join(last.withColumnRenamed("structure", "last"), "file")


def sample_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.structures(laid_out(document_msa(spark, sf_dir), F.lit("Sampled"), F.translate("text", "ACGU-", ".()(."), F.translate("text", "ACGU-", "(.)(.")))


def sequence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = laid_out(document_msa(spark, sf_dir), F.concat(F.lit(">a"), F.col("seq")), F.col("text"), F.concat(F.lit(">b"), F.col("seq")), F.reverse("text"), F.lit("end"))
    first, last = files.sequence(lines), files.sequence(lines, last=True)
    return first.join(last.select("file", F.col("header").alias("last_header"), F.col("text").alias("last_text")), "file")


def _uneven(bpp: DataFrame) -> DataFrame:
    """Probabilities that are not half-way between two printed ones: Java prints the greater of these, C the even one."""
    return bpp.withColumn("prob", F.col("prob") * 0.987654321)


def _probability_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of probabilities for each alignment, with a title line first."""
    from stemloom.plans.catalogue import Inputs

    bpp = _uneven(Inputs(spark, sf_dir).bpp)
    text = sinks.probability_lines(bpp.withColumnRenamed("fam", "msa"))
    return text.select(F.concat(F.lit("src"), F.col("msa")).alias("file"), F.posexplode(F.split(F.concat(F.lit("Pairs\n"), F.col("value")), "\n")).alias("at", "line"))


def bpp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemloom.plans.catalogue import Inputs

    return sinks.probability_lines(_uneven(Inputs(spark, sf_dir).bpp).withColumnRenamed("fam", "msa"))


def bpp_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.probabilities(_probability_lines(spark, sf_dir), least=0.05, single_spaces=True)


def bpp_file_scan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.probabilities(_probability_lines(spark, sf_dir), zero_based=True)


def bpp_reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probabilities of each alignment on its row of the least number, in the regions, past the first five lines."""
    found = files.probabilities(_probability_lines(spark, sf_dir), skip=5).select(F.expr("CAST(substring(file, 4) AS INT)").alias("fam"), "i", "j", "prob")
    msa = document_msa(spark, sf_dir)
    reference = msa.groupBy("fam").agg(F.min_by(F.struct("seq", "text"), "seq").alias("r")).select("fam", "r.*")
    cells = cells_of(reference, "fam")
    return regions.within(probabilities.on_rows(found, cells, C.ungapped_positions(cells)), SMALL)


def ct_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemloom.plans.catalogue import Inputs

    x = Inputs(spark, sf_dir)
    ends = x.brackets.select("fam", "seq", F.explode(F.array(F.struct(F.col("i").alias("col"), F.col("j").alias("pair")), F.struct(F.col("j").alias("col"), F.col("i").alias("pair")))).alias("e")).select("fam", "seq", "e.*")
    rows = x.cells.join(ends, ["fam", "seq", "col"], "left")
    at = F.col("col") + 1
    line = F.format_string("%d %s %d %d %d %d", at, F.substring(F.lit("ACGUN-"), F.col("code") + 1, F.lit(1)), at - 1, at + 1, F.coalesce(F.col("pair") + 1, F.lit(0)), at)
    name = F.concat(F.lit("src"), F.col("fam"), F.lit("/d"), F.col("seq"))
    title = x.msa.select(name.alias("file"), F.lit(0).alias("at"), F.concat(F.lit(f"{WIDTH} dG = 0 "), F.col("seq")).alias("line"))
    return files.connections(rows.select(name.alias("file"), at.alias("at"), line.alias("line")).unionByName(title))


def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    msa = document_msa(spark, sf_dir)
    lines = laid_out(msa, F.concat(F.lit(">src"), F.col("fam"), F.lit("/d"), F.col("seq"), F.lit(".ct")), F.col("text"))
    asked = files.header_queries(lines.where(F.col("file").rlike("d[0-9]*00$")))
    return files.looked_up(asked, lines)


def ground_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    msa = document_msa(spark, sf_dir)
    header = F.concat(F.lit(">x/d"), F.col("seq"), F.lit("z.ct"))
    asked = laid_out(msa.where(F.col("seq").cast("string").endswith("00")), header, F.lit("ACGU"))
    entry = F.concat(F.lit(">src"), F.col("fam"), F.lit("/d"), F.col("seq"), F.lit("z"))
    return files.ground_truth(asked, laid_out(msa, entry, F.col("text"))).select("file", "header", "text")


def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("k_"), F.col("fam"), F.lit("_"), F.col("seq"), F.lit(".aln.fasta"))
    msa = document_msa(spark, sf_dir)
    return files.paired_names(msa.select(name.alias("name")), msa.where("seq % 3 <> 0").select(F.concat(name, F.lit(".txt")).alias("name")))


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    text = F.format_string('[{"input_dir": "./%s", "output_dir": ["v1", "v2"], "k": 30, "count": [10, %d], "dataset_name": "x", "family_name": "%s", "subfamily_name": "s", "align": 2}]', F.col("r_name"), F.col("r_regionkey"), F.col("r_name"))
    return files.run_settings(r.select(text.alias("value")))


def gaps_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.without_gaps(laid_out(document_msa(spark, sf_dir), F.concat(F.lit(">a-"), F.col("seq")), F.col("text")))


def find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.replaced(laid_out(document_msa(spark, sf_dir), F.concat(F.lit(">a-"), F.col("seq")), F.col("text")), "GC", "x")


def sample_k_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_sets(document_msa(spark, sf_dir), 3, 2, seed=7).select("fam", "replicate", "seq")


def family_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.repeated(C.mean_length(document_msa(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6)), "fam", 10)


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from stemloom.plans.catalogue import Inputs

    x = Inputs(spark, sf_dir)
    return x.gold, probabilities.drawn(x.gold, x.spine, "fam")


def joined_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("structure")
    return _drawn(spark, sf_dir)[1].select("fam", SMALL.joined(text).alias("joined"), regions.padded(F.substring(text, 1, 20), F.lit(WIDTH)).alias("padded"))


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _drawn(spark, sf_dir)[0]
    inside = regions.within(gold, SMALL).withColumn("kind", F.lit("within"))
    return inside.unionByName(regions.leaving(gold, SMALL).withColumn("kind", F.lit("leaving")))


def gold_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions.Regions(first=6, low=100, high=130, filler=4)
    gold, text = _drawn(spark, sf_dir)
    free = text.select("fam", F.posexplode(F.split("structure", "")).alias("col", "c")).where("c = '.'").select("fam", "col")
    return regions.gold_pairs(gold, r).unionByName(regions.gold_free(free, r).select("fam", F.col("col").alias("i"), F.lit(-1).alias("j")))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_of(nation_msa(spark, sf_dir), "fam")
    col = C.occupancy(cells).select("fam", "col")
    pairs = col.select("fam", F.col("col").alias("i"), F.explode(F.sequence(F.col("col") + 4, F.lit(WIDTH + 3))).alias("j")).where(F.col("j") < WIDTH)
    return loops.sites(cells, pairs)


def hairpin_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("fam", "seq", "i", "j", loops.hairpin_energy().cast("int").alias("energy"))


def stem_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("fam", "seq", "i", "j", loops.stem_energy(F.lit(WIDTH)).cast("int").alias("outer_stem"), loops.stem_energy(F.lit(WIDTH), inside=True).cast("int").alias("inner_stem"))


def hairpin_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.summed(_sites(spark, sf_dir).withColumn("energy", loops.hairpin_energy()), "energy")


QUERIES = {
    f.__name__: f
    for f in (msa_scan, fasta_unwrap, seq_scan, structure_scan, sample_scan, sequence_scan, bpp_lines, bpp_file_scan, bpp_file_scan_whole, bpp_reference_scan, ct_scan, header_lookup, ground_truth_rows, paired_files, run_configs, gaps_removed, find_replace, sample_k_per_family, family_replicates, joined_regions, region_pairs, gold_shift, hairpin_energies, stem_energies, hairpin_sums)
}
