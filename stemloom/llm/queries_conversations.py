"""op12: all conversations, damaged by a checksum of their keys, and repaired."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.conversations import audited
from stemloom.llm.store import table


def damaged(conversations: DataFrame) -> DataFrame:
    """Of twenty rows one goes, one is emptied, one loses its marks, one comes twice and one is a user's; a null is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    filled = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    return filled.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return audited(damaged(conversations), conversations)


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL = {}
