"""Fill-in-the-middle examples, cut by a table-driven automaton over bytes.

One automaton reads UTF-8 bytes and knows, in one scan, which bytes go on with a
character, where a unit (a code point) begins and where a sentinel ends; each
transition emits what it saw, and the emissions are counted by text and by lane.
A second pass takes the counts to the lane that holds a cut and looks there.

The automaton is run over many lanes of a buffer at once: all lanes but the
first guess that they begin in the first state, and those that guessed wrong
are run again from where the lane before them ended.

A text is cut into prefix, middle and suffix by numbers drawn from its id, so a
task that is run again cuts alike. Texts that hold a sentinel stay plain, as do
a share of the others; of the rest a share has its suffix first.

Defined results: a null or empty text is plain, with no units; texts are taken
whole, whatever their length; repeated rows and doc_ids are transformed each, and
alike; a null doc_id draws as an empty one; bytes that are no UTF-8 are units of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import Chunk, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a transition emits: a unit begins, a sentinel ends, a text ends.
UNIT, SENTINEL, END = 1, 2, 4
#: The symbol between texts, besides the 256 bytes.
BETWEEN = 256
#: Bytes that a lane reads, and cuts that are located at once.
LANE, CUTS = 512, 1024
FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Automaton(NamedTuple):
    """``next`` and ``emit``: [state, symbol]."""

    next: np.ndarray
    emit: np.ndarray


def automaton(sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """States are the beginnings of sentinels, then one for each number of bytes that a character still lacks."""
    words = [s.encode("ascii") for s in sentinels]
    heads = sorted({w[:k] for w in words for k in range(len(w))} | {b""}, key=lambda h: (len(h), h))
    state = {h: k for k, h in enumerate(heads)}
    lacking = {k: len(heads) - 1 + k for k in (1, 2, 3)} | {0: 0}
    following = np.zeros((len(heads) + 3, BETWEEN + 1), np.uint8)
    emit = np.full_like(following, UNIT)
    for head in heads:
        for byte in range(256):
            seen = head + bytes([byte])
            if any(seen.endswith(w) for w in words):
                emit[state[head], byte] |= SENTINEL
            else:
                following[state[head], byte] = next(state[seen[k:]] for k in range(len(seen) + 1) if seen[k:] in state)
        for lead, more in ((range(0xC2, 0xE0), 1), (range(0xE0, 0xF0), 2), (range(0xF0, 0xF5), 3)):
            following[state[head], list(lead)] = lacking[more]
    for more in (1, 2, 3):
        following[lacking[more]], emit[lacking[more]] = following[0], emit[0]
        following[lacking[more], 0x80:0xC0], emit[lacking[more], 0x80:0xC0] = lacking[more - 1], 0
    following[:, BETWEEN], emit[:, BETWEEN] = 0, END
    return Automaton(following, emit)


class Scan:
    """What the automaton emits over texts that lie one after another, and counts of it."""

    def __init__(self, machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> None:
        rows = len(offsets) - 1
        size = len(data) + rows
        lanes = -(-size // LANE)
        symbols = np.full(lanes * LANE, BETWEEN, np.uint16)
        #: Where each text begins among the symbols, and where the last one ends.
        self.begins = offsets + np.arange(rows + 1)
        held = np.ones(size, bool)
        held[self.begins[1:] - 1] = False
        symbols[:size][held] = data
        self.emitted = self._run(machine, symbols.reshape(lanes, LANE))
        own = self.emitted.reshape(-1)[:size]
        count = lambda bit: np.add.reduceat((own & bit) > 0, self.begins[:-1], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.units, self.sentinels = count(UNIT), count(SENTINEL)
        #: Ends of units, which are their beginnings and the ends of texts, before each lane.
        self.bounds = np.concatenate(([0], np.cumsum((self.emitted & (UNIT | END) > 0).sum(1))))
        self.first = np.concatenate(([0], np.cumsum(self.units + 1)[:-1])) if rows else np.zeros(0, np.int64)

    @staticmethod
    def _run(machine: Automaton, lanes: np.ndarray) -> np.ndarray:
        width = BETWEEN + 1
        following, emit = machine.next.ravel(), machine.emit.ravel()
        out = np.empty(lanes.shape, np.uint8)
        enters, leaves = np.zeros(len(lanes), np.uint8), np.zeros(len(lanes), np.uint8)
        todo = np.arange(len(lanes))
        while len(todo):
            symbols, state = np.ascontiguousarray(lanes[todo].T), enters[todo].astype(np.intp)
            made = np.empty(symbols.shape, np.uint8)
            for k in range(len(symbols)):
                at = state * width + symbols[k]
                made[k] = emit[at]
                state = following[at].astype(np.intp)
            out[todo] = made.T
            leaves[todo] = state
            todo = np.flatnonzero(enters[1:] != leaves[:-1]) + 1
            enters[todo] = leaves[todo - 1]
        return out

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Where that unit of each text begins, counted in bytes from the text's begin; one past the last is the text's end."""
        wanted = self.first + unit
        lane = np.searchsorted(self.bounds, wanted, side="right") - 1
        out = np.empty(len(wanted), np.int64)
        for lo in range(0, len(wanted), CUTS):
            part = slice(lo, lo + CUTS)
            upto = np.cumsum(self.emitted[lane[part]] & (UNIT | END) > 0, axis=1)
            out[part] = lane[part] * LANE + np.argmax(upto > (wanted[part] - self.bounds[lane[part]])[:, None], axis=1)
        return out - self.begins[:-1]

    def ends(self, row: int) -> np.ndarray:
        """Bytes after which a sentinel of the text ends."""
        own = self.emitted.reshape(-1)[self.begins[row] : self.begins[row + 1]]
        return np.flatnonzero(own & SENTINEL) + 1


def drawn(doc_id: Column, version: int = 1) -> list[Column]:
    """Four numbers below 2^32 from an id."""
    digest = F.sha2(F.concat(F.lit(f"{version}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _texts(c: Chunk) -> Iterator[bytes]:
    whole = c.data.tobytes()
    return (whole[a:b] for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True))


def fill_in_middle(docs: DataFrame, plain: int = 10, suffix_first: int = 20, version: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each text.

    ``plain`` of 100 texts stay as they are, ``suffix_first`` of 100 others have the form spm, the rest psm.
    """
    h = drawn(F.col("doc_id"), version)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 >= 100 - plain).alias("plain"), (h[3] % 100 < suffix_first).alias("spm"))
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for c in chunks(batch):
                part = batch.slice(c.lo, c.hi - c.lo)
                own = {k: part.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "plain", "spm")}
                scan = Scan(machine, c.data, c.offsets)
                a, b = (own[k] % (scan.units + 1) for k in ("h1", "h2"))
                a, b = np.minimum(a, b), np.maximum(a, b)
                plain = own["plain"].astype(bool) | (scan.units == 0) | (scan.sentinels > 0)
                form = np.where(plain, "plain", np.where(own["spm"].astype(bool), "spm", "psm")).tolist()
                out = []
                for text, kind, x, y in zip(_texts(c), form, scan.places(a).tolist(), scan.places(b).tolist(), strict=True):
                    if kind == "psm":
                        text = p + text[:x] + s + text[y:] + m + text[x:y]
                    elif kind == "spm":
                        text = s + text[y:] + p + text[:x] + m + text[x:y]
                    out.append(text)
                sizes = (pa.array(v, pa.int64(), mask=plain) for v in (a, b - a))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scan.units), pa.array(form), *sizes, pa.array(out, pa.string())], names=names)

    return wanted.mapInArrow(run, FIELDS)


def restored(examples: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The examples with the column ``restored``: the text that an output and its form were made from.

    The same automaton finds the sentinels; an output that doesn't have its form's three raises an error.
    """
    rest = [c for c in examples.columns if c != "restored"]
    kinds = ", ".join(f"`{c}` {examples.schema[c].dataType.simpleString()}" for c in rest)
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

    def whole(text: bytes, kind: str, ends: np.ndarray) -> bytes:
        if kind == "plain":
            return text
        marks = [x.encode() for x in order[kind]]
        if [text[e - len(k) : e] for e, k in zip(ends, marks, strict=False)] != marks or len(ends) != 3 or ends[0] != len(marks[0]):
            raise ValueError(f"no output of the form {kind}")
        first, second = text[ends[0] : ends[1] - len(marks[1])], text[ends[1] : ends[2] - len(marks[2])]
        return (first + text[ends[2] :] + second) if kind == "psm" else (second + text[ends[2] :] + first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for c in chunks(batch, output):
                part = batch.slice(c.lo, c.hi - c.lo)
                scan = Scan(machine, c.data, c.offsets)
                found = [whole(t, k, scan.ends(r)) for r, (t, k) in enumerate(zip(_texts(c), part.column(form).to_pylist(), strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "restored"])

    return examples.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, restored string")
