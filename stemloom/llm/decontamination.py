"""Benchmark decontamination by winnowing.

Texts are word sequences. Of every ``window - gram + 1`` consecutive grams of
``gram`` words the one with the least hash is kept as a fingerprint, so any
shared span of ``window`` words shares a fingerprint at the same place. Document
fingerprints are looked up among the benchmark's; a hit is extended to the
windows around it, which are compared with the benchmark's windows.

The benchmark is a query set and goes to the tasks in blocks of at most
``block_chars`` characters, equal items once, whose number follows the
benchmark's size; a block is broadcast, and documents are read once for each
block. With one block (any usual benchmark) nothing is shuffled.

Defined results: null and empty texts have no words, no hits and no items; an
item without words occurs nowhere; an item of fewer than ``window`` words is one
window of its own length; items are known by their ids, so one that is repeated
counts once; null item ids are left out of the list and the count but their
windows hit; empty tables give no rows, or no hits;
repeated documents are judged alike; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import ALNUM, LOWER, chunks, digests, grams, runs
from stemloom.llm.store import cut

U64 = np.uint64
#: Characters that an item counts besides its own.
EACH = 20


class Block(NamedTuple):
    """A block of benchmark items: fingerprints, and for each window length the window hashes with their items."""

    fingerprints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]
    ids: list[str | None]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, rows = runs(low, offsets, ALNUM)
    return digests(low, starts, ends), rows


def winnow(gram: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Indices of the least of every ``width`` consecutive grams of a row, each once; ties go to the first."""
    if len(gram) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(gram, width)
    whole = rows[: len(view)] == rows[width - 1 :]
    at = np.flatnonzero(whole)
    return np.unique(at + np.argmin(view[whole], axis=1))


def fingerprint_block(items: pa.RecordBatch, window: int, gram: int) -> Block:
    prints, found = [], {}
    ids = items.column("item_id").to_pylist()
    for c in chunks(items):
        words, rows = word_hashes(c.data, c.offsets)
        g, first = grams(words, rows, gram)
        prints.append(g[winnow(g, rows[first], window - gram + 1)])
        size = np.bincount(rows, minlength=c.hi - c.lo)
        for n in {window, *size[(size > 0) & (size < window)].tolist()}:
            h, at = grams(words, rows, n)
            r = rows[at]
            use = size[r] >= window if n == window else size[r] == n
            found.setdefault(n, []).append((h[use], r[use] + c.lo))
    windows = {}
    for n, parts in found.items():
        h, r = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((r, h))
        windows[n] = h[order], r[order]
    return Block(np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64), {n: w for n, w in windows.items() if len(w[0])}, [None if i is None else str(i) for i in ids])


def members(x: np.ndarray, within: np.ndarray) -> np.ndarray:
    if not len(within):
        return np.zeros(len(x), bool)
    at = np.searchsorted(within, x)
    at[at == len(within)] = 0
    return within[at] == x


def matches(words: np.ndarray, rows: np.ndarray, block: Block, window: int, gram: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which words are hit, and (row, item) of each matching window."""
    hit = np.zeros(len(words) + 1, np.int64)
    found = []
    for n, (hashes, owner) in block.windows.items():
        if n == window:
            g, first = grams(words, rows, gram)
            at = winnow(g, rows[first], window - gram + 1)
            at = first[at[members(g[at], block.fingerprints)]]
            if not len(at):
                continue
            around = np.unique((at[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
            around = around[(around >= 0) & (around + n <= len(words))]
            around = around[rows[around] == rows[around + n - 1]]
            h = np.zeros(len(around), U64)
            view = words[around[:, None] + np.arange(n)[None, :]].ravel() if len(around) else words[:0]
            h, _ = grams(view, np.repeat(np.arange(len(around)), n), n)
        else:
            h, around = grams(words, rows, n)
        same = members(h, hashes)
        around, h = around[same], h[same]
        np.add.at(hit, around, 1)
        np.add.at(hit, around + n, -1)
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        each = hi - lo
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum()) if len(each) else lo
        found.append((np.repeat(rows[around], each), owner[where]))
    return np.cumsum(hit[:-1]) > 0, found


def benchmark_blocks(benchmark: DataFrame, window: int, gram: int, block_chars: int) -> Iterator[Block]:
    """The distinct items in blocks of at most ``block_chars`` characters, but for an item of more than half of that, which may exceed it.

    An item's block follows from how many characters come before it. These are counted by range first, so no task and no
    driver counts the items of all; a block's rows are few enough for the driver whatever the benchmark's size.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text") + EACH), F.lit(0)).alias("n"), F.coalesce(F.max(F.length("text") + EACH), F.lit(0)).alias("most")).first()
    if chars["n"] <= block_chars:
        parts = [items]
    else:
        # ranges of a hash, of about half a block each; a range is cut where it exceeds one
        ranges = -(-2 * int(chars["n"]) // block_chars)
        dealt = cut(items.withColumns({"range": F.pmod(F.xxhash64("item_id", "text"), F.lit(ranges)), "size": F.length("text") + EACH}))
        upto = F.sum("size").over(Window.partitionBy("range").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
        room = block_chars - min(int(chars["most"]), block_chars // 2)  # an item that begins in a block's room ends in the block, if it is no longer than half of one
        placed = cut(dealt.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / room)))
        parts = [placed.where((F.col("range") == r["range"]) & (F.col("block") == r["block"])).select("item_id", "text") for r in placed.select("range", "block").distinct().orderBy("range", "block").toLocalIterator()]
    for part in parts:
        t = part.toArrow().combine_chunks()
        rows = t.to_batches() or [pa.RecordBatch.from_pydict({"item_id": pa.array([], t.schema.field(0).type), "text": pa.array([], pa.string())})]
        yield fingerprint_block(rows[0], window, gram)


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), contaminated for each document."""
    spark = docs.sparkSession
    parts, scans, blocks, fields = [], [], 0, "doc_id long, n_words long, hits array<int>, items array<string>, row long"
    # with several blocks a row must have the same number in each scan, whatever its lineage gives the second time
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    for block in benchmark_blocks(benchmark, window, gram, block_chars):
        shared = spark.sparkContext.broadcast(tuple(block))  # at most block_chars characters' windows
        blocks += 1
        if blocks == 2:
            numbered = cut(numbered)
            parts = [numbered.mapInArrow(scans[0], fields)]

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Block(*shared.value)
            for batch in batches:
                for c in chunks(batch):
                    n = c.hi - c.lo
                    words, rows = word_hashes(c.data, c.offsets)
                    hit, found = matches(words, rows, own, window, gram)
                    pairs = np.unique(np.concatenate([np.stack(p, 1) for p in found]), axis=0) if found else np.zeros((0, 2), np.int64)
                    items: list[list[str]] = [[] for _ in range(n)]
                    for r, i in pairs.tolist():
                        items[r].append(own.ids[i])
                    begins = np.searchsorted(rows, np.arange(n))
                    places: list[list[int]] = [[] for _ in range(n)]
                    for w in np.flatnonzero(hit).tolist():
                        places[rows[w]].append(w - int(begins[rows[w]]))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0).slice(c.lo, n), "n_words": pa.array(np.bincount(rows, minlength=n)[:n], pa.int64()),
                        "hits": pa.array(places, pa.list_(pa.int32())), "items": pa.array([sorted({i for i in x if i is not None}) for x in items], pa.list_(pa.string())),
                    })

        scans.append(_keep_row(scan))
        parts.append(numbered.mapInArrow(scans[-1], fields))
    if len(parts) == 1:
        merged = parts[0]
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merged = every.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("hits").cast("long")
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    out = docs
    for block in benchmark_blocks(benchmark, window, gram, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(block))  # at most block_chars characters' windows

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Block(*shared.value)
            for batch in batches:
                for c in chunks(batch):
                    words, rows = word_hashes(c.data, c.offsets)
                    hit, _ = matches(words, rows, own, window, gram)
                    good = np.ones(c.hi - c.lo, bool)
                    good[rows[np.flatnonzero(hit)]] = False
                    yield batch.slice(c.lo, c.hi - c.lo).filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out


def _keep_row(scan):
    """Carries the row number, which tells repeated doc_ids apart, past a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in scan(iter([batch])):
                row = batch.column(2).slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, row], names=[*out.schema.names, "row"])

    return run
