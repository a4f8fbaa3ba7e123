"""Readers of alignment, structure, probability and pair files, as functions of a table of lines.

``lines`` is (file, at, line), counted from 0. ``lines_of`` reads it from paths, a
file being one row there, so that lines keep their order; each format is then a
projection, a filter or a minimum by file, which Catalyst plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemloom.sources.alignments import normalised

#: Texts looked up in one pass over the lines.
LOOKED_UP = 100_000


def lines_of(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Files of paths or directories, subdirectories included; ``pattern`` is a glob of file names."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return split_lines(reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def split_lines(whole: DataFrame) -> DataFrame:
    """(file, at, line) of (file, value); the end of the last line begins no other."""
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("at", "line"))


def natural(name: str | Column) -> Column:
    """A key by which names sort with their numbers as numbers, of any length: k_2 before k_10 before k_10_2. Equal numbers with more zeros before them come later."""
    text = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    key = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.struct(F.lit(0).alias("text"), F.length(digits(x)).alias("digits"), digits(x).alias("run"))).otherwise(F.struct(F.lit(1).alias("text"), F.lit(0).alias("digits"), x.alias("run"))))
    return F.struct(key.alias("runs"), F.length(text).alias("length"), text.alias("name"))


def base_name(file: str | Column = "file") -> Column:
    return F.substring_index(file, "/", -1)


def alignment_rows(lines: DataFrame) -> DataFrame:
    """(msa, seq, text): every line that is neither empty nor headed by > or ; is a row of its file's alignment."""
    body = lines.where((F.length("line") > 0) & ~F.substring("line", 1, 1).isin(">", ";"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return body.select(F.col("file").alias("msa"), place.alias("seq"), normalised("line").alias("text"))


def fasta_records(lines: DataFrame) -> DataFrame:
    """(msa, seq, name, text): the lines after each > header joined and in upper case; lines before the first header are no record's."""
    header = F.col("line").startswith(">")
    w = Window.partitionBy("file").orderBy("at")
    marked = lines.withColumn("seq", (F.sum(header.cast("int")).over(w) - 1).cast("int")).where("seq >= 0")
    parts = F.sort_array(F.collect_list(F.when(~header, F.struct("at", F.upper(F.trim("line")).alias("part")))))  # a sequence
    name = F.max(F.when(header, F.trim(F.expr("substring(line, 2)"))))
    return marked.groupBy(F.col("file").alias("msa"), "seq").agg(name.alias("name"), F.array_join(F.transform(parts, lambda x: x.part), "").alias("text")).select("msa", "seq", "name", "text")


def read_msa(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return alignment_rows(lines_of(spark, paths))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return fasta_records(lines_of(spark, paths))


def _first(rows: DataFrame, last: bool, *columns: str) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return rows.groupBy("file").agg(*[pick(c, "at").alias(c) for c in columns])


def first_rna(lines: DataFrame) -> DataFrame:
    """(file, text): the first line of A, U, C and G only, with any number of 1 at its end, without these."""
    text = F.trim("line")
    return _first(lines.where(text.rlike("^[AUCG]*1*$")).select("file", "at", F.regexp_replace(text, "1+$", "").alias("text")), False, "text")


def structure(lines: DataFrame, last: bool = False, openers: str = ".(") -> DataFrame:
    """(file, structure): the first word of the first, or last, line that begins with one of ``openers``."""
    text = F.trim("line")
    found = lines.where(F.substring(text, 1, 1).isin(*openers)).select("file", "at", F.substring_index(text, " ", 1).alias("structure"))
    return _first(found, last, "structure")


def structures(lines: DataFrame) -> DataFrame:
    """(file, at, structure): every line that begins with a dot or an opening bracket."""
    return lines.where(F.substring("line", 1, 1).isin(".", "(")).select("file", "at", F.trim("line").alias("structure"))


def sequence(lines: DataFrame, last: bool = False) -> DataFrame:
    """(file, header, text): the first, or last, line that begins with a base or a gap, and the line before it."""
    before = F.coalesce(F.lag("line").over(Window.partitionBy("file").orderBy("at")), F.lit(""))
    rows = lines.select("file", "at", F.trim("line").alias("text"), F.trim(before).alias("header"))
    return _first(rows.where(F.substring("text", 1, 1).isin("A", "U", "C", "G", "-")), last, "header", "text")


def probabilities(lines: DataFrame, least: float | None = None, zero_based: bool = False, skip: int = 0, single_spaces: bool = False) -> DataFrame:
    """(file, i, j, prob), from 0, of lines of three fields; the first ``skip`` lines, lines of structures and others are passed over.

    With ``single_spaces`` fields are parted by one space each and the first is shorter than 100 letters.
    """
    part = F.split(F.col("line"), " ") if single_spaces else F.split(F.trim(F.col("line")), r"\s+")
    rows = lines.where((F.col("at") >= skip) & ~F.substring("line", 1, 1).isin(".", "(")).select("file", part.alias("x")).where(F.size("x") == 3)
    if single_spaces:
        rows = rows.where(F.length(F.element_at("x", 1)) < 100)
    value = lambda k, kind: F.trim(F.element_at("x", k)).try_cast(kind)
    shift = 0 if zero_based else 1
    out = rows.select("file", (value(1, "int") - shift).alias("i"), (value(2, "int") - shift).alias("j"), value(3, "double").alias("prob")).where("i is not null and j is not null and prob is not null")
    return out if least is None else out.where(F.col("prob") >= least)


def connections(lines: DataFrame) -> DataFrame:
    """(file, i, j) of connection tables: each pair once, from 0, and free columns with j = -1. The first line is a title; lines of fewer than six fields are passed over."""
    rows = lines.where("at > 0").select("file", F.split(F.trim("line"), r"\s+").alias("x")).where(F.size("x") >= 6)
    ends = rows.select("file", (F.element_at("x", 1).cast("int") - 1).alias("i"), (F.element_at("x", 5).cast("int") - 1).alias("j"))
    return ends.where("j = -1 or i < j")


def run_settings(texts: DataFrame, column: str = "value") -> DataFrame:
    """A row for each pair of count and output_dir of each run in JSON arrays of runs."""
    schema = "array<struct<input_dir string, output_dir array<string>, k int, count array<int>, dataset_name string, family_name string, subfamily_name string, align int>>"
    runs = texts.select(F.explode(F.from_json(column, schema)).alias("r")).select("r.*")
    zipped = runs.withColumn("z", F.explode(F.arrays_zip("count", "output_dir"))).where("z.count is not null and z.output_dir is not null")
    return zipped.select("input_dir", "k", "dataset_name", "family_name", "subfamily_name", "align", F.col("z.count").alias("count"), F.col("z.output_dir").alias("output_dir"))


def paired_names(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(name, family, ordinal, found): each input file name, whether ``name.txt`` is among the outputs, and what its parts say.

    The family is the name's first two parts by _, the ordinal the second as a number.
    """
    there = outputs.select(F.regexp_replace("name", r"\.txt$", "").alias("name")).distinct().withColumn("found", F.lit(True))
    part = lambda k: F.split_part(F.col("name"), F.lit("_"), F.lit(k))
    return inputs.select("name").join(there, "name", "left").select("name", F.concat(part(1), F.lit("_"), part(2)).alias("family"), part(2).try_cast("int").alias("ordinal"), F.coalesce("found", F.lit(False)).alias("found"))


def replaced(lines: DataFrame, old: str, new: str) -> DataFrame:
    return lines.withColumn("line", F.replace(F.col("line"), F.lit(old), F.lit(new)))


def without_gaps(lines: DataFrame) -> DataFrame:
    """Lines without -, but for headers."""
    return lines.withColumn("line", F.when(F.col("line").startswith(">"), F.col("line")).otherwise(F.replace(F.col("line"), F.lit("-"), F.lit(""))))


def looked_up(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """(query, file, line, following): for each text, the first line by file and number that holds it and has one after it, and that line.

    Lines are searched for all texts at once, in one pass; LOOKED_UP texts at a time where there are more.
    """
    import ahocorasick

    follow = F.lead("line").over(Window.partitionBy("file").orderBy("at"))
    rows = lines.select("file", "at", "line", follow.alias("following")).where("following is not null")
    asked = queries.select("query").where("query is not null and query <> ''").distinct()
    blocks = max(1, -(-asked.count() // LOOKED_UP))
    out = None
    for k in range(blocks):
        texts = [r.query for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).toLocalIterator()]

        def run(batches: Iterator[pa.RecordBatch], texts: list[str] = texts) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for t in texts:
                found.add_word(t, t)
            found.make_automaton()
            for b in batches:
                at, names = [], []
                for n, line in enumerate(b.column("line").to_pylist() if texts else []):
                    for t in {t for _, t in found.iter(line)}:
                        at.append(n)
                        names.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(b.column(c).take(pa.array(at, pa.int64())) for c in ("file", "at", "line", "following"))], names=["query", "file", "at", "line", "following"])

        hits = rows.mapInArrow(run, "query string, file string, at int, line string, following string")
        first = hits.groupBy("query").agg(F.min(F.struct("file", "at", F.trim("line").alias("line"), F.trim("following").alias("following"))).alias("m")).select("query", "m.file", "m.line", "m.following")
        out = first if out is None else out.unionByName(first)
    return out


def header_queries(lines: DataFrame) -> DataFrame:
    """(file, at, line, query): headers, and the last part of each one's path without its extension."""
    name = F.substring_index(F.trim("line"), "/", -1)
    return lines.where(F.col("line").startswith(">")).select("file", "at", F.trim("line").alias("line"), F.regexp_replace(name, r"\.[^.]*$", "").alias("query"))


def ground_truth(lines: DataFrame, database: DataFrame, leave: str = "23S") -> DataFrame:
    """(file, at, header, text): the headers of all files but those whose names begin with ``leave``, each with the row of the database entry that names it; an error where none does."""
    asked = header_queries(lines.where(~base_name().startswith(leave)))
    hits = looked_up(asked, database).select("query", F.col("following").alias("text"))
    missing = F.raise_error(F.concat(F.lit("no entry of the database holds "), F.col("query")))
    return asked.join(hits, "query", "left").select("file", "at", F.col("line").alias("header"), F.coalesce("text", missing).alias("text"))
