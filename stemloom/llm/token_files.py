"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of doc_id, as frames that can each be
decompressed alone::

    frame ...         zstandard, with its own checksum; holds whole documents
    index             skippable frame: for each frame the first and last doc_id,
                      documents, documents without id, ids
    seek table        skippable frame: for each frame its compressed and plain
                      size and the low 32 bits of the plain bytes' XXH64; then
                      the number of frames, a descriptor and a magic number

The seek table is that of the public seekable format, so that its readers find
the frames, and plain zstandard readers see the frames alone. All numbers are
little-endian. A frame's plain bytes are::

    documents (u32), for each: 1 if it has an id (u8); ids; id counts (both 64
    bit); then the token ids (u32) of one document after another

Spark deals documents over tasks by ranges of doc_id; each task sorts its range
and writes one file, a frame at a time. A file is made under a name of its own
and counts only if its row is in the manifest, so a task that is run again leaves
no document twice. A reader takes the seek table and the index first, and then
decompresses only the frames that hold what is asked for; each is checked.

Defined results: a null or empty text has the end id only; repeated doc_ids and
rows are written each, in the order of the table; a null doc_id comes before all
others; a document is never split over frames, and one longer than a frame has a
frame of its own; an empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.packing import encoder
from stemloom.llm.store import cut

#: Ids after which a frame is closed: a quarter of a megabyte.
FRAME = 1 << 16
LEVEL = 3
# fixed values of the public seekable format, and the skippable frame of the index
SEEK_FRAME, SEEK_END, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_FRAME = 0x184D2A50
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
INDEX = np.dtype([("first", "<i8"), ("last", "<i8"), ("documents", "<u8"), ("nameless", "<u8"), ("ids", "<u8")])
TAIL = np.dtype([("frames", "<u4"), ("descriptor", "u1"), ("magic", "<u4")])
HEAD = np.dtype([("magic", "<u4"), ("size", "<u4")])
MANIFEST = "part long, path string, documents long, ids long, bytes long"
#: Bytes of files that one task reads.
READ = 64 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    kind, colon, rest = uri.partition(":")
    if not colon or "/" in kind:
        return fs.LocalFileSystem(), uri
    if kind == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """One file; ids of documents come in ascending order."""

    def __init__(self, out: pa.NativeFile, frame: int = FRAME, level: int = LEVEL) -> None:
        import zstandard

        self.out, self.limit = out, frame
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seek: list[tuple] = []
        self.index: list[tuple] = []
        self.held: list[tuple[int | None, np.ndarray]] = []
        self.waiting = self.documents = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.waiting + len(ids) > self.limit:
            self.flush()
        self.held.append((doc_id, ids))
        self.waiting += len(ids)

    def flush(self) -> None:
        names = [n for n, _ in self.held]
        known = [n for n in names if n is not None]
        parts = [np.array([len(names)], "<u4"), np.array([n is not None for n in names], "u1"), np.array([n or 0 for n in names], "<i8"), np.array([len(x) for _, x in self.held], "<u8")]
        plain = b"".join(p.tobytes() for p in parts) + b"".join(x.astype("<u4").tobytes() for _, x in self.held)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.seek.append((len(packed), len(plain), checksum(plain)))
        self.index.append((min(known, default=0), max(known, default=-1), len(names), len(names) - len(known), self.waiting))
        self.documents, self.ids = self.documents + len(names), self.ids + self.waiting
        self.held, self.waiting = [], 0

    def close(self) -> int:
        """The file's bytes, once it is whole."""
        if self.held:
            self.flush()
        index, seek = np.array(self.index, INDEX).tobytes(), np.array(self.seek, SEEK).tobytes()
        tail = np.array([(len(self.seek), CHECKSUMS, SEEK_END)], TAIL).tobytes()
        for magic, body in ((INDEX_FRAME, index), (SEEK_FRAME, seek + tail)):
            self.out.write(np.array([(magic, len(body))], HEAD).tobytes() + body)
        size = self.out.tell()
        self.out.close()
        return size


class Document(NamedTuple):
    doc_id: int | None
    before: int  # ids of the frame's earlier documents
    ids: np.ndarray


class Reader:
    """One file: its seek table and index are read when it is opened, a frame when it is asked for."""

    def __init__(self, path: str) -> None:
        system, at = place(path)
        self.path, self.file = path, system.open_input_file(at)
        size = self.file.size()
        tail = self._array(TAIL, size - TAIL.itemsize, 1)[0]
        if tail["magic"] != SEEK_END or tail["descriptor"] != CHECKSUMS:
            raise ValueError(f"{path}: no seek table at the end")
        n = int(tail["frames"])
        seek_at = size - TAIL.itemsize - n * SEEK.itemsize
        index_at = seek_at - HEAD.itemsize - n * INDEX.itemsize
        self.seek, self.index = self._array(SEEK, seek_at, n), self._array(INDEX, index_at, n)
        self.starts = np.concatenate(([0], np.cumsum(self.seek["packed"].astype(np.int64))))
        heads = [self._array(HEAD, x - HEAD.itemsize, 1)[0]["magic"] for x in (index_at, seek_at)]
        if heads != [INDEX_FRAME, SEEK_FRAME] or self.starts[-1] != index_at - HEAD.itemsize:
            raise ValueError(f"{path}: index and seek table don't fit the file")

    def _array(self, kind: np.dtype, at: int, n: int) -> np.ndarray:
        if at < 0:
            raise ValueError(f"{self.path}: too short for a file of frames")
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at), kind)

    def frame(self, k: int) -> list[Document]:
        import zstandard

        s = self.seek[k]
        plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(s["packed"]), int(self.starts[k])))
        if len(plain) != s["plain"] or checksum(plain) != s["checksum"]:
            raise ValueError(f"{self.path}: frame {k} differs from its checksum")
        n = int(np.frombuffer(plain, "<u4", 1)[0])
        named, at = np.frombuffer(plain, "u1", n, 4), 4 + n
        names, sizes = np.frombuffer(plain, "<i8", n, at), np.frombuffer(plain, "<u8", n, at + 8 * n).astype(np.int64)
        ids = np.frombuffer(plain, "<u4", offset=at + 16 * n)
        ends = np.cumsum(sizes)
        return [Document(int(name) if known else None, int(end - size), ids[end - size : end]) for known, name, size, end in zip(named, names, sizes, ends, strict=True)]

    def frames_of(self, doc_ids: Sequence[int | None]) -> np.ndarray:
        """The frames that may hold any of some documents."""
        known = np.array(sorted(x for x in doc_ids if x is not None), np.int64)
        least = np.searchsorted(known, self.index["first"])
        held = (least < len(known)) & (np.append(known, 0)[least] <= self.index["last"]) if len(known) else np.zeros(len(self.index), bool)
        return np.flatnonzero(held | ((self.index["nameless"] > 0) & (None in doc_ids)))

    def documents(self, doc_ids: Sequence[int | None]) -> Iterator[Document]:
        """Some documents of the file; other frames stay as they are."""
        wanted = set(doc_ids)
        for k in self.frames_of(doc_ids):
            yield from (d for d in self.frame(int(k)) if d.doc_id in wanted)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame: int = FRAME, level: int = LEVEL) -> DataFrame:
    """Writes the ids of all texts, each with ``end_id`` after it, to a shared folder and gives the manifest: a row for each file, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        encode = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                if writer is None:
                    system, at = place(path)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(system.open_output_stream(at, compression=None), frame, level)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode.batch([x or "" for x in some.column(1).to_pylist()]), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "documents": writer.documents, "ids": writer.ids, "bytes": size}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return cut(dealt.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, doc_ids: Sequence[int | None] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of the files' documents.

    ``doc_ids`` is a short list of those wanted: frames without them aren't decompressed. ``start`` counts the ids of all
    documents before one, in all files.
    """
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-size // READ))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.select("path", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("start"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                use = np.arange(len(file.index)) if doc_ids is None else file.frames_of(doc_ids)
                before = start + np.concatenate(([0], np.cumsum(file.index["ids"].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(use), pa.string()), pa.array(use.astype(np.int64)), pa.array(before[use])], names=["path", "frame", "start"])

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in fields.split(", ")]
    wanted = None if doc_ids is None else set(doc_ids)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for path, k, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None or file.path != path:
                    file = Reader(path)
                found = [d for d in file.frame(k) if wanted is None or d.doc_id in wanted]
                columns = [[d.doc_id for d in found], [start + d.before for d in found], [len(d.ids) for d in found], [zlib.crc32(d.ids.tobytes()) for d in found]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array([d.ids.astype(np.int64) for d in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    listed = files.repartition(tasks, "path").mapInArrow(frames, "path string, frame long, start long")
    return listed.repartition(tasks, "path", "frame").sortWithinPartitions("path", "frame").mapInArrow(documents, fields)
