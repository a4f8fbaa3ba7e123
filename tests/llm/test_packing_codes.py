"""The encoder's ids are those of the tokenizer, and each pre-token is looked up once."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stemloom.llm import packing

TEXTS = ["", "the cat, the Cat and a  zyxwvut-42\n", "the cat", "漢字 and <|x|> as they are", "Über façade über 3.14 zyxwvut"]


def test_each_pre_token_is_looked_up_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    own = packing.Encoder(path)
    seen = []

    class Watched(type(own.code)):
        def __getitem__(self, x):
            seen.append(x)
            return super().__getitem__(x)

        def __contains__(self, x):
            seen.append(x)
            return super().__contains__(x)

    own.code = Watched()
    for _ in range(2):
        seen.clear()
        for text, ids in zip(TEXTS, own.batch(TEXTS), strict=True):
            assert ids.dtype == np.uint32 and ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(seen) == sum(len(own.find(t.lower())) for t in TEXTS if "<|" not in t)
