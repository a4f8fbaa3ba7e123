"""Tables, shared folders, lineage cuts and fits in tasks, as they work on a cluster.

``spark.checkpoint.dir`` names the one folder that driver and executors share.
It is read from the session. Where it is unset, a session on one machine gets a
folder of its own, as in tests; a cluster without it is an error.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of the texts that a model is fitted on, about: where a sample's rows would have more, it has fewer rows.
BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there, without their lineage.

    A lost executor takes nothing with it: the files stay, and each later task reads them anew.
    """
    ctx = df.sparkSession.sparkContext
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def chosen(sized: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Of distinct (h, size, …), those of least hash, and how many of these to use: ``most``, or as many as BYTES hold.

    No row is left out for its own length, and none is ranked: a row is taken if its hash lies below the share that is wanted.
    """
    sized = cut(sized)  # a few numbers a row
    found = sized.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    wanted = max(1, min(most, int(found.n * BYTES / max(1, found.bytes or 0))))
    place = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    return sized.where(place * found.n < wanted + 6 * wanted**0.5), wanted


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample, in one task: the driver gets the model, of plain values and arrays, and no texts."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows), protocol=5)], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else fit(schema.empty_table())
