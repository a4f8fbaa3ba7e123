"""op10 on texts made against its sampling and its merging of blocks."""

import numpy as np

from stemloom.llm import suffix_dedup

L = 400
#: Steps of the bytes beside a core, nearest first: the sums of blocks with and without them were equal modulo 2^64.
BEFORE = (0, -3, 1, -2, -2, 2, -1, 0, 0, 1, 0, 3)
AFTER = (2, 0, -3, 3, -2, 2, 0, 1, 2, -1, 0, 1)


def letters(seed, n, low=97, high=123):
    return np.random.default_rng(seed).integers(low, high, n).astype(np.uint8)


def text(data):
    return data.tobytes().decode()


def test_a_passage_has_its_suffix_in_texts_of_any_size():
    passage = letters(0, L)
    # hashes of these two have 39 leading bits in common, not 40
    passage[100:132] = np.frombuffer(b"vkhfjnnkhowbxrwvsmsvgsennhujjuzh", np.uint8)
    passage[250:282] = np.frombuffer(b"fupasqezrinrlxblzawbkzrommjmhmhd", np.uint8)
    alone = suffix_dedup.sampled_suffixes(passage, np.array([0, L]), L)[1]
    whole = np.concatenate([np.full(1 << 24, 122, np.uint8), passage])
    _, place, lo, hi = suffix_dedup.sampled_suffixes(whole, np.array([0, len(whole)]), L)
    at = 1 << 24
    assert (place[(lo <= at) & (at <= hi)] - at).tolist() == alone.tolist()


def test_blocks_of_equal_sums_are_told_apart(spark):
    span = L - suffix_dedup.BLOCK + 1
    texts = []
    for seed in range(4):
        a = letters(seed, 463, 102, 120)
        core = int(suffix_dedup.sampled_suffixes(a, np.array([0, len(a)]), L)[1][0]) % suffix_dedup.BLOCK
        core += suffix_dedup.BLOCK * (core < len(BEFORE))
        b = a.astype(np.int64)
        b[core - len(BEFORE) : core] += np.array(BEFORE[::-1])
        b[core + span : core + span + len(AFTER)] += np.array(AFTER)
        texts += [text(a), text(b.astype(np.uint8))]
    assert not any(a[i : i + L] in b for a, b in zip(texts[::2], texts[1::2], strict=True) for i in range(64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs, with_text=False).collect()] == [0] * len(texts)
