"""Near-duplicate groups by b-bit MinHash.

A document is the set of its distinct word shingles. Sets that are equal are
merged first, by a 128-bit digest, so a group of copies of any size is one row
from there on. ``PERMUTATIONS`` minima give band keys, which propose candidates,
and their low ``BITS`` bits, packed into longs, from which a pair's similarity
is estimated by bit counts and corrected for chance collisions. Pairs whose
estimate lies within six standard deviations of the threshold or above go on;
every link is confirmed on the full shingle sets of the texts.

The widest bands are taken for which a pair at the threshold is missed with a
probability of at most ``MISS``.

No bucket is gathered or expanded into all pairs. First each member of a bucket
is compared with the bucket's least and greatest member; confirmed links are
merged into components. Buckets that then hold one component are done. In the
others, up to ``SMALL`` members are compared by estimate and confirmed pair by
pair. The members of larger ones are brought together once for all bands, by
the bucket's least member, dealt into blocks of ``BLOCK`` rows, and each two
blocks are one task that counts common shingles of all its pairs at once by a
matrix product and gives links between components only, no more than it has
rows. Where most of a large family lies just below the threshold, this work
grows with the square of that family, as proof that no link is lost.

Defined results: null and empty texts, and texts without words, have no
shingles and stay alone; fewer words than a shingle make one shingle of them
all; rows are told apart by a hash of doc_id and text, so a group keeps one: of
the least doc_id that isn't null, and of the least hash where that is not one
text; repeated rows are copies, all of which ``kept`` marks alike; a row of null
doc_id counts like any other, links its near copies, is kept where its group has
no doc_id, and has that group's null as component_id; repeated doc_ids are taken
by their texts and give a row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import LOWER, NON_SPACE, chunks, digests, grams, mix, runs
from stemloom.llm.components import components
from stemloom.llm.store import cut

U64 = np.uint64
PERMUTATIONS = 128
BITS = 4
MISS = 1e-6
#: Rows of the table by which texts are preselected before they are shuffled: its bound.
SLOTS = 1 << 20
LOW = 0x1111111111111111
#: Members of a bucket that are compared pair by pair; rows of a block of a larger family; shingles counted at once.
SMALL = 16
BLOCK = 256
COLUMNS = 4096
#: Pairs whose texts are compared at once.
ROWS = 64


def band_rows(threshold: float) -> int:
    """Minima per band: as many as keep the miss probability at the threshold within MISS."""
    fit = [r for r in range(1, PERMUTATIONS + 1) if (1 - threshold**r) ** (PERMUTATIONS // r) <= MISS]
    return max(fit, default=1)


def least_matches(threshold: float) -> int:
    """Equal low-bit groups that a pair at the threshold has at least, but for six standard deviations."""
    p = threshold + (1 - threshold) / 2**BITS
    return int(PERMUTATIONS * p - 6 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def shingles(data: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, and their rows, sorted by row."""
    low = LOWER[data]
    starts, ends, rows = runs(low, offsets, NON_SPACE)
    words = digests(low, starts, ends)
    size = np.bincount(rows, minlength=len(offsets) - 1)
    h, first = grams(words, rows, words_each)
    hs, rs = [h], [rows[first]]
    for n in range(1, words_each):
        h, first = grams(words, rows, n)
        use = size[rows[first]] == n
        hs.append(h[use])
        rs.append(rows[first][use])
    h, r = np.concatenate(hs), np.concatenate(rs)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def sketches(h: np.ndarray, r: np.ndarray, n: int, rows_each: int) -> dict[str, np.ndarray]:
    """Sizes, digests, band keys and packed low bits of n sets."""
    size = np.bincount(r, minlength=n)
    full = np.flatnonzero(size)
    starts = np.concatenate(([0], np.cumsum(size)))[:-1][full]
    minima = np.zeros((PERMUTATIONS, len(full)), np.uint32)
    rng = np.random.Generator(np.random.Philox(20_240_517))
    odd = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    salt = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
    x = (h >> U64(32)).astype(np.uint32)
    if len(full):
        for k in range(PERMUTATIONS):
            y = (x ^ salt[k]) * odd[k]
            y ^= y >> np.uint32(15)
            minima[k] = np.minimum.reduceat(y, starts)
    bands = PERMUTATIONS // rows_each
    keys = np.zeros((n, bands), U64)
    for b in range(bands):
        k = np.full(len(full), b + 1, U64)
        for m in minima[b * rows_each : (b + 1) * rows_each]:
            k = mix(k * U64(0x9E3779B97F4A7C15) + m.astype(U64))
        keys[full, b] = k
    each = 64 // BITS
    packed = np.zeros((n, PERMUTATIONS // each), U64)
    for k in range(PERMUTATIONS):
        packed[full, k // each] |= (minima[k] & np.uint32(2**BITS - 1)).astype(U64) << U64(BITS * (k % each))
    digest = np.zeros((2, n), U64)
    if len(full):
        digest[0, full] = np.add.reduceat(mix(h), starts)
        digest[1, full] = np.add.reduceat(mix(h ^ U64(0xD1342543DE82EF95)), starts)
    return {"size": size, "keys": keys, "packed": packed, "d1": digest[0], "d2": digest[1]}


def row_key() -> Column:
    """A row's own key, which is never null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame, words_each: int, threshold: float) -> DataFrame:
    rows_each = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                n = c.hi - c.lo
                s = sketches(*shingles(c.data, c.offsets, words_each), n, rows_each)
                lists = {k: pa.FixedSizeListArray.from_arrays(pa.array(s[k].ravel().view(np.int64)), s[k].shape[1]).cast(pa.list_(pa.int64())) for k in ("keys", "packed")}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(c.lo, n), "row": batch.column(2).slice(c.lo, n), "n_shingles": pa.array(s["size"], pa.int64()), "d1": pa.array(s["d1"].view(np.int64)), "d2": pa.array(s["d2"].view(np.int64))} | lists)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key()).mapInArrow(run, "doc_id long, row long, n_shingles long, d1 long, d2 long, keys array<long>, packed array<long>")


def alike(a: str, b: str, threshold: float) -> Column:
    """Whether two packed signatures have enough equal low-bit groups."""
    differ = F.lit(0)
    for k in range(PERMUTATIONS * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(LOW)))
    return differ <= PERMUTATIONS - least_matches(threshold)


def confirm(docs: DataFrame, pairs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    texts = preselected(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")))
    both = pairs.join(texts.withColumnsRenamed({"id": "u", "text": "a"}), "u").join(texts.withColumnsRenamed({"id": "v", "text": "b"}), "v").select("u", "v", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                h, r, size = [], [], np.zeros(n, np.int64)
                for column in ("a", "b"):
                    for c in chunks(batch, column):
                        x, row = shingles(c.data, c.offsets, words_each)
                        h.append(x)
                        r.append(row + c.lo)
                        size += np.bincount(row + c.lo, minlength=n)
                h, r = np.concatenate(h), np.concatenate(r)
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                same = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
                keep = pa.array(100 * same >= percent * (size - same))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    return both.mapInArrow(compare, "u long, v long")


def preselected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text), by row keys, of documents among which are all of ``ids``; the table that selects them has at most SLOTS rows."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = ids.select(slot.alias("slot")).distinct()
    texts = docs.select(row_key().alias("id"), F.col("text").cast("string"))
    return texts.join(F.broadcast(slots), slot == F.col("slot"), "left_semi").dropDuplicates(["id"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    number = np.full(len(value), -1)
    number[times > 1] = np.arange(int((times > 1).sum()))
    column = number[at]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[a:b], column[a:b] - lo] = 1
        out += there @ there.T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray, labels: list[int]) -> list[int]:
    """Indices of pairs that join components, none of them superfluous."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x] = parent.get(parent[x], parent[x])
        return x

    used = []
    for k, (i, j) in enumerate(pairs.tolist()):
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append(k)
    return used


def compare_families(docs: DataFrame, members: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Links (u, v) between components among the members (hub, rep, c) of each hub."""
    sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("hub", "blocks")
    texts = preselected(docs, members.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    dealt = members.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(texts, "rep")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", "text")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own = t.column("own").to_numpy()
        reps, labels = t.column("rep").to_pylist(), t.column("c").to_pylist()
        sets = []
        for x in t.column("text"):
            data = np.frombuffer((x.as_py() or "").encode(), np.uint8)
            sets.append(shingles(data, np.array([0, len(data)]), words_each)[0])
        same, size, label = common(sets), np.array([len(x) for x in sets]), np.array(labels)
        linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
        linked &= label[:, None] != label[None, :]
        if i != j:
            linked &= own[:, None] != own[None, :]
        pairs = np.argwhere(np.triu(linked, 1))
        pairs = pairs[spanning(pairs, labels)]
        ids = np.array(reps, np.int64)
        u, v = ids[pairs[:, 0]], ids[pairs[:, 1]]
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    return dealt.groupBy("hub", "i", "j").applyInArrow(compare, "u long, v long")


def grouped(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """doc_id, row (its key), n_shingles, component_id and kept for each document."""
    threshold = percent / 100
    signed = cut(signatures(docs, words_each, threshold))
    some = signed.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    reps = some.groupBy("d1", "d2").agg(F.min(order).alias("head"), F.min_by(F.struct("keys", "packed"), order).alias("s"))
    reps = cut(reps.withColumn("rep", F.col("head.row")))
    bands = reps.select("rep", F.explode("s.keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1")
    shared = cut(bands.join(buckets, "key").select("key", "rep", "lo", "hi"))
    packed = reps.select("rep", "s.packed")
    stars = shared.select(F.col("rep").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v").distinct()
    stars = stars.join(packed.select(F.col("rep").alias("u"), F.col("packed").alias("pu")), "u").join(packed.select(F.col("rep").alias("v"), F.col("packed").alias("pv")), "v").where(alike("pu", "pv", threshold))
    stars = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = components(confirm(docs, cut(stars), words_each, percent))

    # what is left: buckets that hold more than one component
    labelled = shared.join(first.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").select("key", "rep", "lo", F.coalesce("c", "rep").alias("c"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key", "n")
    members = cut(labelled.join(mixed, "key"))
    few = members.where(F.col("n") <= SMALL).join(packed, "rep")
    side = lambda x, k: few.select(F.col("key").alias(k), F.col("rep").alias(x), F.col("c").alias(f"c{x}"), F.col("packed").alias(f"p{x}"))
    rest = side("u", "k1").join(side("v", "k2"), (F.col("k1") == F.col("k2")) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & alike("pu", "pv", threshold)).select("u", "v").distinct()
    large = members.where(F.col("n") > SMALL).select(F.col("lo").alias("hub"), "rep", "c").distinct()
    more = cut(confirm(docs, cut(rest), words_each, percent).unionByName(compare_families(docs, large, words_each, percent)))
    links = components(first.unionByName(more)) if more.take(1) else first

    headed = reps.select("d1", "d2", "rep", "head").join(links.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").select("d1", "d2", "head", F.coalesce("c", "rep").alias("c"))
    least = headed.groupBy("c").agg(F.min("head").alias("least"))
    rep_of = headed.select("d1", "d2", "c").join(least, "c").select("d1", "d2", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"))
    known = some.select("doc_id", "row", "n_shingles", "d1", "d2").join(rep_of, ["d1", "d2"]).select("doc_id", "row", "n_shingles", "component_id", (F.col("row") == F.col("first")).alias("kept"))
    alone = signed.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept for each document."""
    return grouped(docs, words_each, percent).drop("row")


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that are first in their group; rows repeated with their doc_id stay once.

    Rows without doc_id and words have nothing by which they could be copies: all of them stay.
    """
    kept = grouped(docs, words_each, percent).where("kept").select(F.col("row").alias("__kept_row")).distinct()
    some = F.col("doc_id").isNotNull() | F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = docs.where(some).join(kept, row_key() == F.col("__kept_row"), "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.where(~some)).select(*docs.columns)
