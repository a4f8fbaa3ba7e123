"""op13: all documents' token ids, written to files of frames and read back."""

import uuid

from stemloom.llm.store import shared_folder, table
from stemloom.llm.token_files import read, write


def op13_token_files(spark, sf_dir, tokenizer=None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder, tokenizer), with_ids=False)


QUERIES = {"op13_token_files": op13_token_files}
SQL = {}
