"""A training corpus from raw documents in five stages, each one operator.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, secrets are blotted out, and what is left is
packed into sequences. Each stage takes the columns of documents and, but for
the last, returns them; it works on all that its predecessor kept.

Stages stand alone: each reads the table its predecessor wrote. Null and empty
texts, repeated rows and empty tables are taken as the operators define.
"""

import public_tokenizers

from stemloom.llm.decontamination import clean
from stemloom.llm.minhash import one_of_each
from stemloom.llm.packing import pack
from stemloom.llm.secrets import redacted, scan
from stemloom.llm.store import cut, table
from stemloom.llm.toxicity import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark, docs, sf_dir):
    """Documents that the factorization machine, trained on the labelled ones among them, doesn't call toxic."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine, keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; rows without doc_id stay unless they are copies."""
    return one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a window of ten words of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """All documents, secrets in them replaced by their kind, ``n_chars`` to match."""
    return redacted(docs, scan(docs))


def packing(spark, docs, sf_dir):
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: SQL can't express the first stage's model or the last one's tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for documents; each stage's result is written to the shared folder once and read from there by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
