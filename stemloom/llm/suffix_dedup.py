"""Removal of long repeated byte strings by a sparse, range-partitioned suffix order.

A string of ``length`` bytes is repeated if it starts anywhere else too. Sorting
all suffixes would write several hundred bytes for each byte of text, so the
order is built over sampled suffixes only: those at the least hash of an
``ANCHOR``-byte gram in some ``length``-byte window. Every window has one such
suffix in it, chosen by its content alone, so equal windows have equal ones at
the same place, and only windows around suffixes that begin alike can be equal.

1. Sampled suffixes are dealt into buckets by splitters, taken from a sample of
   documents, over their leading words of eight bytes and their own place, so
   that one common beginning is split among as many buckets as it fills. A bucket
   is sorted word by word, neighbours are compared, and the single rows at bucket
   ends are compared across the boundaries.
2. Around each suffix that has an equal, the windows are taken in blocks of
   ``BLOCK`` whose common core is hashed (128 bits) and whose differing bytes are
   kept; blocks of equal cores meet, and each window is compared with its equals by
   those bytes. Blocks that are equal as a whole repeat each other in all their
   windows; of a common core only one of each kind waits for the others, and each
   task merges its own before they meet. A core
   with more than ``HOT`` different blocks is compared window by window in an
   aggregation with partial sums instead.
3. Each text drops the bytes that its repeated windows cover.

Strings are judged on the input, not on what is left; none crosses a document.

Defined results: null is the empty text; texts shorter than ``length`` lose
nothing; repeated rows repeat each other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import BASE_B, RollingHash, chunks, mix
from stemloom.llm.store import cut

U64 = np.uint64
ANCHOR = 32
BLOCK = 64
#: Low bits of a gram's hash that give way to its place, enough for any text of a column: the same whatever the text's size,
#: so that equal windows rank their grams alike.
PLACE = np.uint64(31)
#: Documents from which the splitters are taken, about, at least, and for how many buckets there is one; suffixes read from
#: them at most, at least, and for each bucket.
SAMPLE, BUCKETS = 1_000, 3
SAMPLED, EACH = 200_000, 10
#: Blocks of one core that wait in a task before equal ones are merged; different ones that are compared there.
MERGE = 20_000
HOT = 100_000
SIGN = U64(1 << 63)
WORDS = ("k0", "k1", "k2", "k3")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of every w consecutive entries, in a constant number of passes."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U64)
    padded[: len(x)] = x
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the chunk, first and last window start) of each sampled suffix."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = RollingHash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    gram = h.span(at, at + ANCHOR)
    least = sliding_min((gram >> PLACE << PLACE) | at.astype(U64), length - ANCHOR + 1)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[: len(least)]
    inside = np.arange(len(least)) + length <= offsets[1:][row]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none
    anchor = (least[start] & ((U64(1) << PLACE) - U64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[start[first]], anchor[first], start[first], start[last]


def leading(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The suffixes' first four words of eight bytes, in the order of the bytes."""
    raw = np.ascontiguousarray(data[place[:, None] + np.arange(ANCHOR)]) if len(place) else np.zeros((0, ANCHOR), np.uint8)
    return (raw.view(">u8").astype(U64) ^ SIGN).view(np.int64)


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row, part): equal rows share their address, and are each read.

    The address is the doc_id and a hash of the text; where there is no doc_id, two hashes.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    return whole.withColumns({"row": F.coalesce("doc_id", F.xxhash64(F.lit("none"), "text")), "part": F.xxhash64("text")})


def suffixes(texts: DataFrame, length: int, splitters: list[tuple[int, ...]] | None) -> DataFrame:
    """The sampled suffixes with their buckets; without splitters, the bucket is the size of the text."""
    heads = np.array([s[0] for s in splitters or []], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for c in chunks(batch):
                r, place, lo, hi = sampled_suffixes(c.data, c.offsets, length)
                key = leading(c.data, place)
                own, part = rows[c.lo + r], parts[c.lo + r]
                begin = c.offsets[r]
                bucket = np.searchsorted(heads, key[:, 0], "left") if splitters is not None else np.diff(c.offsets)[r]
                for i in np.flatnonzero(bucket != np.searchsorted(heads, key[:, 0], "right")) if splitters else ():
                    bucket[i] = bisect_left(splitters, (*key[i].tolist(), int(own[i]), int(part[i]), int(place[i] - begin[i])))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int32)), "row": pa.array(own), "part": pa.array(part)} | {k: pa.array(np.ascontiguousarray(key[:, i])) for i, k in enumerate(WORDS)} | {k: pa.array((v - begin).astype(np.int32)) for k, v in (("place", place), ("lo", lo), ("hi", hi))})

    return texts.mapInArrow(run, "bucket int, row long, part long, k0 long, k1 long, k2 long, k3 long, place int, lo int, hi int")


def splitters_of(texts: DataFrame, length: int, parts: int) -> list[tuple[int, ...]]:
    """At most parts - 1 keys that part a sample of the suffixes evenly; repeated beginnings are told apart by place.

    The sample grows with the number of buckets; where it has fewer suffixes than there are buckets, each of its suffixes
    parts two. A document is taken with a chance that grows with its bytes, as a long one alone may fill buckets, and its suffixes count
    by the reverse of that chance.
    """
    size = F.octet_length("text")
    each = (texts.agg(F.sum(size).alias("n")).first()["n"] or 0) / max(SAMPLE, parts // BUCKETS)
    chance = F.shiftrightunsigned(F.xxhash64("row", "part"), 1) / F.lit(float(1 << 63))
    some = suffixes(texts.where(chance * each <= size), length, None)
    got = some.select(*WORDS, "row", "part", "place", F.greatest(F.lit(1.0), each / F.col("bucket")).alias("weight")).orderBy(F.xxhash64("row", "part", "place")).limit(max(SAMPLED, EACH * parts)).toPandas().sort_values([*WORDS, "row", "part", "place"])
    if not len(got):
        return []
    upto = got.pop("weight").to_numpy().cumsum()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return sorted(set(map(tuple, got.to_numpy(np.int64)[np.minimum(at, len(got) - 1)].tolist())))


def repeated_suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(row, part, place, lo, hi) of the sampled suffixes whose leading words come again."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = splitters_of(texts, length, parts)
    dealt = suffixes(texts, length, splitters).repartitionById(len(splitters) + 1, F.col("bucket"))
    names = [*WORDS, "row", "part", "place", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with an equal neighbour; and, marked as edges, the first and last row of the bucket."""

        def out(rows: np.ndarray, twin: np.ndarray, edge: bool) -> pa.RecordBatch:
            kinds = [np.int64] * 6 + [np.int32] * 3
            return pa.RecordBatch.from_arrays([*[pa.array(rows[:, i].astype(k)) for i, k in enumerate(kinds)], pa.array(twin), pa.array(np.full(len(rows), edge))], names=[*names, "twin", "edge"])

        held, before, first = None, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy().astype(np.int64) for k in names], 1)
            whole = rows if held is None else np.vstack([held, rows])
            same = (whole[1:, :4] == whole[:-1, :4]).all(1)
            twin = np.zeros(len(whole), bool)
            twin[0] = before
            twin[1:] |= same
            twin[:-1] |= same
            if first is None:
                first = whole[:1]
            done = twin[:-1]
            yield out(whole[:-1][done], np.ones(int(done.sum()), bool), False)
            held, before = whole[-1:], bool(twin[-1])
        if held is not None:
            if before:
                yield out(held, np.ones(1, bool), False)
            yield out(np.vstack([first, held]) if (first != held).any() else held, np.zeros(1 + int((first != held).any()), bool), True)

    schema = "k0 long, k1 long, k2 long, k3 long, row long, part long, place int, lo int, hi int, twin boolean, edge boolean"
    compared = cut(dealt.select(*names, "bucket").sortWithinPartitions(*WORDS).select(*names).mapInArrow(run, schema))
    edges = compared.where("edge")
    across = edges.groupBy(*WORDS).agg(F.count("*").alias("n")).where("n > 1")
    ends = edges.join(across, list(WORDS), "left_semi").select("row", "part", "place", "lo", "hi")
    return compared.where("not edge").select("row", "part", "place", "lo", "hi").union(ends)


def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    return flat, t.column("left").to_numpy(), t.column("right").to_numpy()


NAMES = ("row", "part", "core", "mask", "key")


def results(t: pa.Table, mask: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    keys = pa.nulls(len(mask), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c) for c in NAMES[:3]] + [pa.array(mask.view(np.int64)), keys], names=NAMES)


def merged(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """Of blocks, those with an equal one, with the mask of all their windows; and one of each kind."""
    near, left, right = unpack(t)
    fixed = [np.ascontiguousarray(t.column(k).to_numpy()).view(np.uint8).reshape(t.num_rows, -1) for k in ("h1", "h2", "left", "right")]
    whole = np.ascontiguousarray(np.hstack([*fixed, near]))
    at = pa.FixedSizeBinaryArray.from_buffers(pa.binary(whole.shape[1]), len(whole), [None, pa.py_buffer(whole)]).dictionary_encode().indices.to_numpy()
    _, first, n = np.unique(at, return_index=True, return_counts=True)
    low, high = BLOCK - 1 - right, left
    mask = np.zeros(len(at), U64)
    for s in range(BLOCK):
        mask |= ((low <= s) & (s <= high)).astype(U64) << U64(s)
    good = (n[at] > 1) & (mask != 0)
    return results(t.filter(pa.array(good)), mask[good]), t.take(pa.array(np.sort(first)))


def cores(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(h1, h2, near, left, right, row, part, core, mask): each block of windows around the repeated suffixes.

    ``near`` has the bytes before the core, nearest first, then those after it. Blocks that a task has twice are known to be
    repeated: they have their mask and no ``near``, and one of each kind goes on to meet those of other tasks, so that a
    core that many texts share reaches its task about once from each task here.
    """
    listed = places.groupBy("row", "part").agg(F.collect_list(F.struct("place", "lo", "hi")).alias("places"))  # a text's own suffixes
    joined = texts.join(listed, ["row", "part"]).select("doc_id", "text", "row", "part", "places")
    span = length - BLOCK + 1
    names = ["h1", "h2", "near", "left", "right", "row", "part", "core", "mask"]

    def met(waiting: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch], int]:
        """Results of the waiting blocks that are equal, and one of each kind, which wait on."""
        done, rest = merged(pa.Table.from_batches(waiting))
        out = []
        if done.num_rows:
            spread = mix(done.column(0).to_numpy().view(U64) ^ mix(done.column(2).to_numpy().astype(U64) ^ done.column(1).to_numpy().view(U64))).view(np.int64)
            none = pa.nulls(done.num_rows, pa.int32())
            out = [pa.RecordBatch.from_arrays([pa.array(spread), pa.array(spread), pa.nulls(done.num_rows, pa.binary()), none, none, *(done.column(k) for k in range(4))], names=names)]
        return out, rest.combine_chunks().to_batches(), rest.num_rows

    def blocks(data: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, row: int, part: int) -> pa.RecordBatch | None:
        a, b = (place - hi) // BLOCK, (place - lo) // BLOCK
        each = b - a + 1
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(a, each)
        core = np.unique(np.repeat(place.astype(np.int64), each) - step * BLOCK)
        core = core[(core >= 0) & (core + span <= len(data))]
        if not len(core):
            return None
        raw = data.tobytes()
        both = np.frombuffer(b"".join(hashlib.blake2b(raw[x : x + span], digest_size=16).digest() for x in core.tolist()), U64).reshape(-1, 2)
        h1, h2 = (np.ascontiguousarray(both[:, k]) for k in (0, 1))
        padded = np.concatenate([np.zeros(BLOCK, np.uint8), data, np.zeros(BLOCK, np.uint8)])
        k = np.arange(BLOCK - 1)
        near = np.hstack([padded[core[:, None] + BLOCK - 1 - k], padded[core[:, None] + BLOCK + span + k]])
        beside = pa.FixedSizeBinaryArray.from_buffers(pa.binary(near.shape[1]), len(core), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
        ends = [pa.array(np.minimum(x, BLOCK - 1).astype(np.int32)) for x in (core, len(data) - core - span)]
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), beside, *ends, pa.array(np.full(len(core), row, np.int64)), pa.array(np.full(len(core), part, np.int64)), pa.array(core.astype(np.int32)), pa.nulls(len(core), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        fresh = held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
                p = batch.column(4)[i].values
                made = blocks(data, *(p.field(k).to_numpy() for k in range(3)), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                if made is None:
                    continue
                waiting.append(made)
                fresh += made.num_rows
                if fresh < MERGE:
                    continue
                out, waiting, kinds = met(waiting)
                yield from out
                fresh, held = 0, kinds
                if held > MERGE:  # mostly blocks of one kind each: no use in waiting
                    yield from waiting
                    waiting, held = [], 0
        if waiting:
            out, waiting, _ = met(waiting)
            yield from out
            yield from waiting

    return joined.mapInArrow(run, "h1 long, h2 long, near binary, left int, right int, row long, part long, core int, mask long")


def window_keys(near: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shift: which blocks have that window, and hashes that are equal for equal windows."""
    m = BLOCK - 1
    before, after = [np.zeros(len(near), U64)], [np.zeros(len(near), U64)]
    for k in range(m):
        before.append(mix(before[-1] * U64(BASE_B) + near[:, k].astype(U64) + U64(1)))
        after.append(mix(after[-1] * U64(0xA0761D6478BD642F) + near[:, m + k].astype(U64) + U64(1)))
    for t in range(BLOCK):
        there = (left >= t) & (right >= m - t)
        yield t, there, mix(before[t] + mix(after[m - t] ^ group))


def repeated_windows(blocks: DataFrame) -> DataFrame:
    """(row, part, core, mask, key): the shifts of a block's repeated windows; or one window of a hot core, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            h = np.stack([t.column(k).to_numpy() for k in ("h1", "h2")], 1)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]).any(1)
            group = np.cumsum(new)
            more = np.bincount(group)[group] > 1
            t, group = t.filter(pa.array(more)), group[more]
            if not t.num_rows:
                return
            near, left, right = unpack(t)
            mask = np.zeros(len(near), U64)
            for s, there, key in window_keys(near, left, right, mix(group.astype(U64))):
                at = np.flatnonzero(there)
                order = np.argsort(key[at], kind="stable")
                k = key[at][order]
                twin = np.zeros(len(k), bool)
                same = k[1:] == k[:-1]
                twin[1:] |= same
                twin[:-1] |= same
                mask[at[order[twin]]] |= U64(1) << U64(s)
            good = mask != 0
            yield results(t.filter(pa.array(good)), mask[good])

        def exploded(t: pa.Table) -> Iterator[pa.RecordBatch]:
            near, left, right = unpack(t)
            group = mix(t.column("h1").to_numpy().view(U64) ^ mix(t.column("h2").to_numpy().view(U64)))
            for s, there, key in window_keys(near, left, right, group):
                yield results(t.filter(pa.array(there)), np.full(int(there.sum()), U64(1) << U64(s)), key[there].view(np.int64))

        waiting: list[pa.RecordBatch] = []
        hot, kinds = None, 0
        for batch in batches:
            known = batch.filter(batch.column(8).is_valid())
            if known.num_rows:
                yield results(pa.Table.from_batches([known]), known.column(8).to_numpy().view(U64))
                batch = batch.filter(batch.column(8).is_null())
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hot is not None:
                n = int(np.argmin(np.append((h1 == hot[0]) & (h2 == hot[1]), False)))
                if n:
                    yield from exploded(pa.Table.from_batches([batch.slice(0, n)]))
                    batch, h1, h2 = batch.slice(n), h1[n:], h2[n:]
                if not batch.num_rows:
                    continue
                hot = None
            waiting.append(batch)
            last = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            if len(last):
                n = int(last[-1]) + 1
                waiting[-1] = batch.slice(0, n)
                yield from resolved(pa.Table.from_batches(waiting))
                waiting, kinds = [batch.slice(n)], 0
            elif len(waiting) > 1 and (waiting[0].column(0)[0].as_py(), waiting[0].column(1)[0].as_py()) != (int(h1[0]), int(h2[0])):
                yield from resolved(pa.Table.from_batches(waiting[:-1]))
                waiting, kinds = [batch], 0
            if sum(b.num_rows for b in waiting) > MERGE + kinds:
                done, rest = merged(pa.Table.from_batches(waiting))
                yield done
                waiting, kinds = rest.combine_chunks().to_batches(), rest.num_rows
            if kinds > HOT:
                kinds = 0
                hot = int(h1[-1]), int(h2[-1])
                yield from exploded(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield from resolved(pa.Table.from_batches(waiting))

    dealt = blocks.repartition("h1").sortWithinPartitions("h1", "h2")
    return dealt.mapInArrow(run, "row long, part long, core int, mask long, key long")


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of each document."""
    if length < 2 * BLOCK + ANCHOR:
        raise ValueError(f"length must be {2 * BLOCK + ANCHOR} or more")
    texts = addressed(docs)
    found = repeated_windows(cores(texts, repeated_suffixes(texts, length), length))
    single = found.where("key is not null")
    again = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    masks = found.where("key is null").select("row", "part", "core", "mask").union(single.join(again, "key").select("row", "part", "core", "mask"))
    listed = masks.groupBy("row", "part").agg(F.collect_list(F.struct("core", "mask")).alias("masks"))  # a text's own windows
    joined = texts.join(listed, ["row", "part"], "left").select("doc_id", "text", "row", "masks")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            made: list[tuple] = []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
                removed = spans = 0
                kept = data
                if batch.column(3)[i].is_valid:
                    m = batch.column(3)[i].values
                    core, mask = m.field(0).to_numpy().astype(np.int64), np.ascontiguousarray(m.field(1).to_numpy()).view(U64)
                    change = np.zeros(len(data) + 1, np.int64)
                    for t in range(BLOCK):
                        start = core[(mask >> U64(t)) & U64(1) == 1] - t
                        np.add.at(change, start, 1)
                        np.add.at(change, start + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    kept = data[~gone]
                raw = kept.tobytes()
                made.append((batch.column(0)[i].as_py(), len(data), removed, spans, hashlib.sha256(raw).hexdigest(), *([raw] if with_text else [])))
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return joined.mapInArrow(run, fields)
