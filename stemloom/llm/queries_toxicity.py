"""op1: toxicity of every document, learnt from the labels outside the held-out third."""

from pyspark.sql import functions as F

from stemloom.llm.store import table
from stemloom.llm.toxicity import score, train


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL = {}
