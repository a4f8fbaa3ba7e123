"""op5: the quality of every document, learnt from the votes of heuristic labellers on all of them."""

from pyspark.sql import functions as F

from stemloom.llm.store import table
from stemloom.llm.weak_labels import score, train


def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs)).withColumn("predicted", F.col("kept").cast("int"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL = {}
