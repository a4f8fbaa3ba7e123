"""op3: all documents in sequences of 2048 tokens."""

from stemloom.llm.packing import pack
from stemloom.llm.store import table


def op3_packing(spark, sf_dir, tokenizer=None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, with_ids=False).drop("loss_tokens")


QUERIES = {"op3_packing": op3_packing}
SQL = {}
