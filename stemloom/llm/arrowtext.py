"""Vectorised text kernels shared by the Arrow-batch operators.

A text column of an Arrow batch is read as its UTF-8 buffer and offsets and
worked on with whole-array NumPy operations, a bounded slice of rows at a time,
so a Python worker's memory depends on ``CHUNK_BYTES`` and the longest single
text, never on the partition.

Nulls are read as empty texts; callers that must tell them apart keep the mask
that :func:`chunks` yields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once by one Python worker.
CHUNK_BYTES = 1 << 20
U64 = np.uint64
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD1342543DE82EF95


class Chunk(NamedTuple):
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Slices of rows with at most ``limit`` bytes of text, or one row where that is longer."""
    col = batch.column(batch.schema.get_field_index(column))
    null = np.asarray(col.is_null())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, off, dat = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        yield Chunk(lo, hi, data[a:b], offsets[lo : hi + 1] - a, null[lo:hi])
        lo = hi


def byte_table(ranges: list[tuple[int, int]], invert: bool = False) -> np.ndarray:
    """256 booleans, true for the byte ranges given (both ends included)."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return ~t if invert else t


#: Bytes that are no white space ``[\\x20\\x09-\\x0D]``.
NON_SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)], invert=True)
#: Bytes of letters and digits, every byte of a non-ASCII character included.
ALNUM = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of the table's bytes; runs end where a row ends."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cut = offsets[1:-1]
        before[cut[cut < len(inside)]] = False
        after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs and near ones unrelated outputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the last, largest tables are kept."""
    n = 1 << bits
    if base in _POWERS and len(_POWERS[base][0]) >= n:
        return _POWERS[base]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    _POWERS[base] = out[0], out[1]
    return _POWERS[base]


class RollingHash:
    """Prefix sums from which the hash of any byte range takes two look-ups."""

    def __init__(self, data: np.ndarray, base: int = BASE_A) -> None:
        bits = max(20, int(len(data)).bit_length())
        self.power, self.inverse = _powers(base, bits)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.power[: len(data)] * (data.astype(U64) + U64(1)), out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[starts:ends]; ranges of other lengths with equal sums are told apart."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw ^ ((ends - starts).astype(U64) * U64(BASE_B)))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each of data[starts:ends], ascending ranges that don't overlap.

    Equal keys mean equal bytes but for one chance in 2^64 a pair, whoever wrote the text: unlike sums of powers, which
    texts can be made for. Each different range of a chunk is digested once.
    """
    if not len(starts):
        return np.zeros(0, U64)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    held = np.ascontiguousarray(data[np.cumsum(change[:-1]) > 0])
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    known = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    each = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in known.dictionary.to_pylist())
    return np.frombuffer(each, U64)[known.indices.to_numpy()]


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the first word's index of each."""
    if len(words) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    h = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        h = (h * U64(BASE_A)) ^ mix(words[k : len(words) - n + 1 + k] + U64(k + 1))
    return mix(h[first]), first


def lengths(rows: np.ndarray, n: int) -> np.ndarray:
    """How many entries each of n rows has."""
    return np.bincount(rows, minlength=n)[:n]


def with_columns(batch: pa.RecordBatch, lo: int, hi: int, keep: list[str]) -> dict[str, pa.Array]:
    part = batch.slice(lo, hi - lo)
    return {c: part.column(part.schema.get_field_index(c)) for c in keep}
