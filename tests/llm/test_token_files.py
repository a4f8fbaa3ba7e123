"""op13: files of frames, read back by Spark, one document at a time and by a plain zstandard reader."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stemloom.llm.token_files import Reader, Writer, place, read, write

PATH = public_tokenizers.path("word_bpe_49k.json")


def plainly(rows):
    """(doc_id, start, n_tokens, crc) by encoding one text after another."""
    known, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("frame", [1, 50, 1 << 16])
def test_documents_come_back_in_order(spark, tmp_path, frame):
    rows = [(i, " ".join(f"word{i % 7} é{k}" for k in range(i % 40))) for i in range(300, 0, -1)]
    rows += [(-5, "before"), (None, "nameless"), (7, None), (2**40, ""), (12, "twice"), (12, "twice"), (500, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x"))
    manifest = write(docs.repartition(3), str(tmp_path), PATH, frame=frame)
    found = sorted((tuple(r) for r in read(manifest, with_ids=False).collect()), key=lambda r: r[1])
    want = plainly(rows)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert [(r[1], r[1] + r[2]) for r in found][:-1] == [(r[1], s[1]) for r, s in zip(found, found[1:])]
    once = {r for r in want if sum(x[0] == r[0] for x in want) == 1}
    assert once <= set(found)
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in want)
    asked = read(manifest, doc_ids=[12, None, -5, 77_777]).collect()
    assert sorted((str(r.doc_id), r.n_tokens, len(r.ids)) for r in asked) == sorted((str(r[0]), r[2], r[2]) for r in want if r[0] in (12, None, -5))
    assert len(glob.glob(f"{tmp_path}/*.zst")) == manifest.count()  # no task wrote twice


def test_only_asked_frames_are_read_and_each_is_checked(tmp_path):
    path = str(tmp_path / "x.zst")
    system, at = place("file://" + path)
    w = Writer(system.open_output_stream(at, compression=None), frame=10)
    for d in range(40):
        w.add(d, np.full(6, d, np.uint32))
    assert w.close() == len(open(path, "rb").read())
    file = Reader(path)
    assert len(file.index) == 40 and file.frames_of([3, 39]).tolist() == [3, 39] and not len(file.frames_of([40, -1]))
    with zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True) as plain:
        assert len(plain.read()) == int(file.seek["plain"].sum())
    data = bytearray(open(path, "rb").read())
    data[int(file.starts[7]) + 20] ^= 1
    open(path, "wb").write(data)
    broken = Reader(path)
    assert [d.ids.tolist() for d in broken.documents([6, 8])] == [[6] * 6, [8] * 6]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(7)
    open(path, "wb").write(data[:-3])
    with pytest.raises(ValueError, match="no seek table"):
        Reader(path)


def test_a_checksum_of_the_table_alone_is_enough(tmp_path):
    path = str(tmp_path / "x.zst")
    w = Writer(place(path)[0].open_output_stream(path, compression=None))
    w.add(1, np.arange(5, dtype=np.uint32))
    w.close()
    data = bytearray(open(path, "rb").read())
    data[-9 - 4] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="frame 0 differs"):
        Reader(path).frame(0)


def test_empty_table(spark, tmp_path):
    assert not read(write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), PATH)).count()
