"""op11 against a plain version, and its automaton on odd bytes."""

import hashlib
import random

import numpy as np
import pytest

from stemloom.llm import fill_middle
from stemloom.llm.fill_middle import Scan, automaton, fill_in_middle, restored

LETTERS = ["<", "P", "S", "M", ">", "a", " ", "é", "漢", "😀", "\n", "\x00"]


def plainly(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_random_texts_and_their_rebuilding(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(LETTERS, k=rng.choice([1, 2, 3, 40, 700])))) for i in range(1500)]
    rows += [(None, None), (None, "abc"), (7, None), (8, ""), (9, "x"), (9, "x"), (10, "<P"), (11, "<<P>"), (12, "a<"), (13, "P>b<S")]
    rows.append((14, "".join(rng.choices(LETTERS[5:], k=1_300_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle(docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted((plainly(*r) for r in rows), key=key)
    assert sorted(((r.doc_id, r.restored) for r in restored(made).collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_names(spark):
    assert not restored(fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count()
    odd = spark.createDataFrame([(1, "some text", 3, "y", "z")], "doc_id int, text string, n int, form string, `h1` string")
    assert [tuple(r) for r in fill_in_middle(odd).collect()] == [plainly(1, "some text")]


def test_an_output_without_its_sentinels_is_an_error(spark):
    with pytest.raises(Exception, match="no output of the form psm"):
        restored(spark.createDataFrame([("psm", "<P>a<M>b<S>c")], "form string, output string")).collect()


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lanes_and_bytes_that_are_no_text(monkeypatch, lane):
    monkeypatch.setattr(fill_middle, "LANE", lane)
    texts = [b"", b"\x80\x80a", "é<P>漢".encode(), b"\xf0\x9f<S>", b"<P", b">", "😀😀".encode()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    scan = Scan(automaton(), np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert scan.units.tolist() == [0, 3, 5, 4, 2, 1, 2]
    assert scan.sentinels.tolist() == [0, 0, 1, 1, 0, 0, 0]
    assert scan.places(scan.units).tolist() == [len(t) for t in texts]
    assert scan.places(np.minimum(1, scan.units)).tolist() == [0, 1, 2, 2, 1, 1, 4]
