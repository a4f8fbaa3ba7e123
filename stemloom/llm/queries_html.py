"""op4: the main text of every page."""

from stemloom.llm.html_crf import extract, train
from stemloom.llm.store import table


def op4_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


QUERIES = {"op4_html_extraction": op4_html_extraction}
SQL = {}
