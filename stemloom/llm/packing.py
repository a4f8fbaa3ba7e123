"""Packing of tokenised examples into fixed-length sequences by vector bin packing.

A bin has three limits: tokens, segments and loss-bearing tokens. The next piece
of a bin is the waiting one that fits and has the largest dot product with the
bin's free space, both as shares of the limits. Each task packs its own rows
with at most ``POOL`` remainders waiting, so its memory is bounded and nothing
is shuffled; a task that is run again packs the same rows the same way.

A text may be cut (``cut``): full sequences are taken off long ones first, a
piece that doesn't fit is cut to the free space, and a task's last bin is cut at
powers of two, where sequences need no padding. Without cutting, an example that
exceeds a limit by itself is an error.

Tokens before the loss are those of the optional ``prompt`` column; they fill a
bin's tokens but not its loss.

Defined results: a null or empty text has the end token only; repeated rows and
doc_ids are packed each; an empty table gives no rows; nothing is dropped or
capped; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remainders that wait for a bin in one task.
POOL = 512
#: Pre-tokens whose ids a worker keeps; then it starts anew.
KNOWN = 400_000
#: Texts with other characters, or with a special token's brackets, go to the tokenizer as they are.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


def split_of(spec: str) -> str | None:
    """The pattern of pre-tokens in a tokenizer file, where it says that these are all that matters; None of a file of another kind, whose texts are encoded whole."""
    file = json.loads(spec)
    steps = lambda part, key: [x for x in ((file.get(part) or {}).get(key) or [])]
    normal, split = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"]:
        return None
    first = split[0]
    return first["pattern"].get("Regex") if first["behavior"] == "Removed" and first["invert"] and not split[1]["add_prefix_space"] else None


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of PLAIN characters in lower case, with letters and numbers written as ranges; None if it asks for more."""
    held = {x for c in map(chr, (*range(9, 0x7F), *range(0xA1, 0x250))) if PLAIN.fullmatch(c) for x in c.lower()}

    def ranges(kind: str) -> str:
        out: list[list[int]] = []
        for c in sorted(ord(x) for x in held if unicodedata.category(x).startswith(kind)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)

    own = pattern.replace(r"\p{L}", ranges("L")).replace(r"\p{N}", ranges("N"))
    return None if r"\p" in own else re.compile(own)


class Codes(dict):
    """Pre-tokens to numbers in the order of their first lookup; ``new`` are those not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, x: str) -> int:
        self.new.append(x)
        self[x] = n = len(self)
        return n


class Encoder:
    """The ids of whole texts, exactly as the tokenizer file gives them.

    BPE works within pre-tokens, so a text's ids are those of its pre-tokens one after another; ids of
    pre-tokens are kept, and unknown ones are encoded many at a time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        pattern = split_of(self.whole.to_str())
        plain = plain_pattern(pattern) if pattern else None
        self.find = plain.findall if plain else None
        self.forget()

    def forget(self) -> None:
        self.code = Codes()
        self.ids, self.starts, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        new, self.code.new = self.code.new, []
        ids, size = [self.ids], []
        for lo in range(0, len(new), 2000):
            e = self.whole.encode(" ".join(new[lo : lo + 2000]), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            size.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(new[lo : lo + 2000])))
        self.size = np.concatenate([self.size, *size])
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate(([0], np.cumsum(self.size)[:-1]))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > KNOWN:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        split = []
        for i, t in enumerate(texts):
            if self.find and PLAIN.fullmatch(t) and "<|" not in t:
                found = self.find(unicodedata.normalize("NFC", t).lower())
                split.append((i, np.fromiter(map(self.code.__getitem__, found), np.int64, len(found))))
            else:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
        if self.code.new:
            self.learn()
        for i, code in split:
            size = self.size[code]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[code] - ends + size, size)
            out[i] = self.ids[at]
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process, whatever tasks it runs."""
    held = sys.modules.setdefault("_stemloom_worker", types.ModuleType("_stemloom_worker")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Packer:
    """Gives (key, start, length, sequence, offset) of each piece as its bin closes."""

    def __init__(self, limits: tuple[int, int, int], first: int, cut: bool) -> None:
        self.limits, self.next, self.cut = np.array(limits, float), first, cut
        self.key, self.start = [0] * POOL, [0] * POOL
        self.need = np.zeros((POOL, 3))
        self.n = 0

    def add(self, key: int, tokens: int, free: int) -> Iterator[tuple[int, int, int, int, int]]:
        """An example of so many tokens, the first ``free`` of them without loss."""
        start, most, segments, loss = 0, *map(int, self.limits)
        while self.cut and min(most, loss) <= tokens - start and (free <= start or most <= loss):
            size = most if tokens - start >= most and most <= loss else min(most, loss)
            yield key, start, size, self.next, 0
            self.next += 1
            start += size
        if start == tokens:
            return
        need = (tokens - start, 1, tokens - max(start, free))
        if not self.cut and (need > self.limits).any():
            raise ValueError(f"an example of {tokens} tokens exceeds the limits {self.limits.tolist()}")
        if self.n == POOL:
            yield from self.close()
        self.key[self.n], self.start[self.n], self.need[self.n] = key, start, need
        self.n += 1

    def take(self, i: int) -> None:
        self.n -= 1
        self.key[i], self.start[i], self.need[i] = self.key[self.n], self.start[self.n], self.need[self.n]

    def fill(self) -> tuple[list[tuple[int, int, int]], int]:
        room, pieces, used = self.limits.copy(), [], 0
        while self.n:
            need = self.need[: self.n]
            fits = (need <= room).all(1)
            gain = (need / self.limits) @ (room / self.limits)
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, -1)))
                size = int(need[i, 0])
                pieces.append((self.key[i], self.start[i], size))
                room -= need[i]
                self.take(i)
            elif self.cut and room.min() >= 1:
                i = int(np.argmax(gain))
                bare = int(need[i, 0] - need[i, 2])
                size = int(min(room[0], bare + room[2], need[i, 0] - 1))
                pieces.append((self.key[i], self.start[i], size))
                spent = max(0, size - bare)
                room -= (size, 1, spent)
                self.start[i] += size
                self.need[i] -= (size, 0, spent)
            else:
                break
            used += size
        return pieces, used

    def close(self) -> Iterator[tuple[int, int, int, int, int]]:
        pieces, used = self.fill()
        if not self.cut or used == self.limits[0] or self.n:
            at = 0
            for key, start, size in pieces:
                yield key, start, size, self.next, at
                at += size
            self.next += 1
            return
        powers = [1 << b for b in reversed(range(used.bit_length())) if used >> b & 1]  # the last bin
        at, left = 0, powers.pop(0)
        for key, start, size in pieces:
            while size:
                step = min(size, left)
                yield key, start, step, self.next, at
                start, size, at, left = start + step, size - step, at + step, left - step
                if not left:
                    self.next, at, left = self.next + 1, 0, powers.pop(0) if powers else 0

    def end(self) -> Iterator[tuple[int, int, int, int, int]]:
        while self.n:
            yield from self.close()


def pack(docs: DataFrame, tokenizer: str, tokens: int = 2048, segments: int = 256, loss_tokens: int = 2048, end_id: int = 1, cut: bool = True, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked for, the ids of each piece."""
    prompt = F.col("prompt").cast("string") if "prompt" in docs.columns else F.lit(None).cast("string")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer((tokens, segments, loss_tokens), TaskContext.get().partitionId() << 40, cut)
        waiting: dict[int, list] = {}
        made: list[tuple] = []

        def note(pieces: Iterator[tuple[int, int, int, int, int]]) -> None:
            for key, start, size, sequence, offset in pieces:
                own = waiting[key]
                ids = own[1][start : start + size]
                made.append((own[0], start, size, zlib.crc32(ids.astype("<u4").tobytes()), len(own[1]), sequence, offset, size - max(0, min(own[2] - start, size)), *([ids.astype(np.int32)] if with_ids else [])))
                own[3] -= size
                if not own[3]:
                    del waiting[key]

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in fields.split(", ")]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

        number = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = encode.batch([x or "" for x in part.column(1).to_pylist()])
                prompts = encode.batch([x or "" for x in part.column(2).to_pylist()])
                for doc_id, ids, before in zip(part.column(0).to_pylist(), texts, prompts, strict=True):
                    whole = np.concatenate([before, ids, np.array([end_id], np.uint32)])
                    number += 1
                    waiting[number] = [doc_id, whole, len(before), len(whole)]
                    note(packer.add(number, len(whole), len(before)))
                yield out()
        note(packer.end())
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), prompt.alias("prompt")).mapInArrow(run, fields)
