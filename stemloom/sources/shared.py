"""The one folder that driver and executors share, and lineage cuts in it.

``spark.checkpoint.dir`` names the folder. Where it is unset, a session on one
machine gets a folder of its own, as in tests; a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without their lineage; a lost executor takes nothing with it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: as ``cut``, and with a size that the planner knows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
