"""op10: byte strings of 400 or more that repeat, over all documents."""

from stemloom.llm.store import table
from stemloom.llm.suffix_dedup import remove_repeats


def op10_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
SQL = {}
