"""op9: the language of every document, learnt outside the held-out fifth."""

from pyspark.sql import functions as F

from stemloom.llm.language import identify, train
from stemloom.llm.store import table


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    found = identify(docs, train(docs, remainder != 0))
    return found.select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op9_language_id": op9_language_id}
SQL = {}
