"""Alignments folded as their files arrive.

A file is one row of the stream; each micro-batch is folded like any table and
written under its own number, so a batch that is run again after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemloom.operators.folding import Model, fold
from stemloom.sources.files import alignment_rows, split_lines


def arriving(spark: SparkSession, folder: str, files_at_once: int = 1_000) -> DataFrame:
    """(file, value) of a folder's files, each once."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def fold_arrivals(stream: DataFrame, path: str, checkpoint: str, m: Model = Model(), **trigger: object) -> StreamingQuery:
    """Best structures of the alignments of ``arriving`` as Parquet below ``path``, a folder a batch; all that is there, then an end, unless a trigger is given."""

    def batch(files: DataFrame, number: int) -> None:
        fold(alignment_rows(split_lines(files)), m).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
