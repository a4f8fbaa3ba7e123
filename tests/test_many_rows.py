"""Alignments of many rows: what is counted or left out on the way must not change a result."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from stemloom.functions import beam
from stemloom.functions.conservation import alignment, differing_bases, identity_bins, pairable, substitution
from stemloom.functions.energies import builtin
from stemloom.operators import columns as C
from stemloom.operators import loops
from stemloom.operators import pairs as P
from stemloom.plans.steps import rule_loops
from stemloom.sources.alignments import cells_of


def _rows(n: int, width: int = 32, letters: str = "ACGU-N") -> list[str]:
    stem = ("GGCAGCUAACGUCAGC" + "GCUGACGUUAGCUGCC")[:width]
    out = []
    for k in range(n):
        d = hashlib.md5(str(k).encode()).hexdigest()
        out.append("".join(letters[(int(x, 16) + c) % len(letters)] if x in "cdef" and d[c - 1] in "01234567" else s for c, (x, s) in enumerate(zip(d, stem))))
    return out


def test_loop_totals_are_the_sums_of_the_rows(spark):
    rows = [(f, k, t) for f in (1, 2) for k, t in enumerate(_rows(40 + f))] + [(1, 90, _rows(1)[0]), (3, 0, None)]
    msa = spark.createDataFrame(rows, "fam int, seq long, text string")
    near = P.enclosing(P.pairable(P.scored(P.pair_counts(msa.where("fam < 3"))), -400), C.cumulative_occupancy(cells_of(msa, "fam")), 6)
    for table in (None, rule_loops(spark)):
        want = sorted(map(tuple, loops.summed_loops(loops.loop_energies(cells_of(msa, "fam"), near, table)).collect()))
        got = loops.loop_totals(msa, near, table, rows=8)
        assert want and sorted(map(tuple, got.collect())) == want


def test_identity_range_is_that_of_all_pairs(spark):
    rows = [(f, k, t) for f, n in ((1, 120), (2, 30), (3, 1)) for k, t in enumerate(_rows(n))] + [(4, k, "ACGU") for k in range(3)] + [(5, 0, None), (5, 1, ""), (6, 0, "A漢"), (6, 1, "CĀ")]
    msa = spark.createDataFrame(rows, "fam int, seq long, text string")
    x = C.pair_identities(msa).select("fam", (100.0 * F.col("same") / F.greatest("width", F.lit(1))).alias("x"))
    want = {r.fam: r for r in x.groupBy("fam").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean")).collect()}
    for block in (2048, 7):
        got = {r.fam: r for r in C.identity_range(msa, block).collect()}
        assert got.keys() == want.keys() == {1, 2, 4, 5, 6}
        for k, r in want.items():
            assert (got[k].lo, got[k].hi) == (r.lo, r.hi) and abs(got[k].mean - r.mean) < 1e-9


def test_identity_range_of_many_rows(spark):
    """20,000 rows have 200 million pairs; those that can be the furthest are few."""
    texts = _rows(20_000)
    msa = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "fam int, seq long, text string")
    (row,) = C.identity_range(msa).collect()
    code = np.frombuffer("".join(sorted(set(texts))).encode(), np.uint8).reshape(-1, 32)
    least = min(int((code == x).sum(1).min()) for x in code[:: max(1, len(code) // 300)])
    assert row.hi == 100 and row.lo <= 100 * least / 32


def test_identities_of_one_alignment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, width = rng.integers(2, 20), rng.integers(1, 40)
        code = np.where(rng.random((n, width)) < rng.choice([0.01, 0.1, 1]), rng.integers(0, 6, (n, width)), rng.integers(0, 6, width))
        code, times = np.unique(code, axis=0, return_counts=True)
        share = [(x == y).mean() for k, x in enumerate(code) for y in code[k + 1 :]]
        low, high = min(share, default=1.0), 1.0 if (times > 1).any() else max(share, default=0.0)
        top, bottom = max(12, int(100 * high + 0.5) // 5), max(5, int(100 * low + 0.5) // 5)
        assert identity_bins(code, times) == (None if 100 * low + 0.5 > 100.45 else (top, min(bottom, top - 1)))


def test_a_sweep_counts_rows_that_look_alike(monkeypatch):
    texts = sorted(set(_rows(300)))
    a = alignment(texts, [k % 3 + 1 for k in range(len(texts))])
    pairs = pairable(a, differing_bases(), -400)
    for summed in (False, True):
        whole = beam.Sweep(a, pairs, builtin(), summed=summed)
        monkeypatch.setattr(beam, "MANY", 10)
        counted = beam.Sweep(a, pairs, builtin(), summed=summed)
        monkeypatch.undo()
        assert counted.counts and not whole.counts and counted.total == whole.total
        assert all((x.value == y.value).all() and (x.score == y.score).all() for x, y in zip(whole.batches, counted.batches, strict=True))


def test_substitution_of_many_rows_meets_few_pairs():
    """It met every row with every later one: minutes for 30,000 rows."""
    texts = sorted(set(_rows(30_000)))
    a = alignment(texts, [1] * len(texts))
    began = time.process_time()
    assert (substitution(a, None) == differing_bases()).all()
    assert time.process_time() - began < 10
