"""Relational operators against the folding kernel and brute force, on alignments of other widths than those of the queries."""

import itertools

import numpy as np
import pytest

from stemloom.functions.conservation import alignment, differing_bases, identity_bins, pairable
from stemloom.functions import structures as st
from stemloom.operators import columns as C
from stemloom.operators import pairs as P
from stemloom.operators import probabilities as B
from stemloom.operators import sampling
from stemloom.sources import files
from stemloom.sources.alignments import cells_of

RNG = np.random.default_rng(3)


def wide(rows=7, width=90):
    first = RNG.choice(list("ACGU"), width)
    return ["".join(np.where(RNG.random(width) < 0.25, RNG.choice(list("ACGU-N"), width), first)) for _ in range(rows)]


@pytest.fixture(scope="module")
def families(spark):
    groups = {"a": wide(), "b": wide(4, 33), "c": wide(1, 12), "d": ["ACGU"] * 3}
    rows = [(k, n, t) for k, g in groups.items() for n, t in enumerate(g)]
    return groups, spark.createDataFrame(rows, "fam string, seq int, text string").cache()


@pytest.mark.parametrize("block", [None, 16])
def test_scores_equal_the_kernel(families, block):
    groups, msa = families
    found = P.pairable(P.scored(P.pair_counts(msa, block))).collect()
    for k, rows in groups.items():
        kernel = pairable(alignment(rows, [1] * len(rows)), np.array(differing_bases()))
        expected = {divmod(int(x), kernel.length): s for x, s in zip(kernel.key, kernel.score, strict=True)}
        own = {(r.i, r.j): r.pscore for r in found if r.fam == k}
        assert set(own) == set(expected)
        assert all(abs(own[p] - expected[p]) < 1e-5 for p in own)


def test_identities_equal_the_kernel(families):
    groups, msa = families
    bins = {r.fam: (r.max_bin, r.min_bin) for r in C.identity_bins(msa).collect()}
    for k, rows in groups.items():
        a = alignment(rows, [1] * len(rows))
        assert bins.get(k) == identity_bins(a.code, a.weight)
    pairs = {(r.fam, r.a_seq, r.b_seq): (r.hamming, r.identity) for r in C.row_identity(msa).collect()}
    for k, rows in groups.items():
        for x, y in itertools.combinations(range(len(rows)), 2):
            cols = [(p, q) for p, q in zip(rows[x], rows[y], strict=True)]
            kept = [c for c in cols if c != ("-", "-")]
            assert pairs[k, x, y][0] == sum(p != q for p, q in cols)
            assert abs(pairs[k, x, y][1] - 100 * sum(p == q for p, q in kept) / len(kept)) < 1e-9
    small = {tuple(r) for r in C.pair_identities(msa, block=2).collect()}
    assert small == {tuple(r) for r in C.pair_identities(msa).collect()}


def test_enclosing_pairs_by_brute_force(families):
    groups, msa = families
    cells = cells_of(msa, "fam")
    upto, pairs = C.cumulative_occupancy(cells), P.pairable(P.scored(P.pair_counts(msa))).cache()
    found = {tuple(r) for r in P.enclosing(pairs, upto, 5).collect()}
    known = {}
    for r in pairs.collect():
        known.setdefault(r.fam, []).append((r.i, r.j))
    expected, openings = set(), set()
    for k, own in known.items():
        n, f = len(groups[k]), np.cumsum([sum(t[c] != "-" for t in groups[k]) for c in range(len(groups[k][0]))])
        for i, j in own:
            for p, q in own:
                if p < i and j < q and (f[i - 1] - f[p]) + (f[q - 1] - f[j]) <= 5 * n:
                    expected.add((k, i, j, p, q))
            for p in range(i):
                later = [q for x, q in own if x == p and q > j]
                if f[i - 1] - f[p] <= 5 * n and later:
                    openings.add((k, i, j, p, min(later)))
    assert found == expected
    assert {tuple(r) for r in P.multiloop_openings(pairs.select("fam", "i", "j"), pairs, upto, 5).collect()} == openings


def test_ranked_composition_keeps_the_best(families):
    _, msa = families
    w = P.gated(P.pair_counts(msa)).select("fam", "i", "j", (P.F.col("n") - P.F.col("f0")).alias("w")).cache()
    rows = w.collect()
    found = {(r.fam, r.j, r.place): r.total for r in P.ranked_composition(w, w, 4).collect()}
    best = {}
    for a in rows:
        for b in rows:
            if a.fam == b.fam and a.j + 1 == b.i:
                best.setdefault((a.fam, b.j), []).append(a.w + b.w)
    expected = {(*k, n + 1): x for k, v in best.items() for n, x in enumerate(sorted(v, reverse=True)[:4])}
    assert found == expected


def test_structures_as_tables(spark):
    texts = ["((.[[.))..]]", "<{(.)}>", "....", "(<[{)>]}"]
    table = spark.createDataFrame(list(enumerate(texts)), "fam int, structure string")
    found = {}
    for r in B.parsed(table, "fam").collect():
        found.setdefault(r.fam, set()).add((r.i, r.j))
    assert found == {k: set(st.parsed(t)[0]) for k, t in enumerate(texts) if t != "...."}
    pairs = spark.createDataFrame([(0, i, j) for i, j in st.parsed(texts[3])[0]], "fam int, i int, j int")
    layers = {(r.i, r.j): r.layer for r in B.layers(pairs).collect()}
    assert layers == {(0, 4): 0, (1, 5): 1, (2, 6): 2, (3, 7): 3}
    spine = spark.createDataFrame([(0, c) for c in range(8)], "fam int, col int")
    assert B.drawn(B.layers(pairs), spine, "fam", kind="layer").first().structure == "([{<)]}>"
    marks = P.F.explode(P.F.sequence(P.F.lit(0), P.F.lit(4)))
    assert B.drawn(pairs.limit(0), table.limit(1).select("fam", marks.alias("col")), "fam").first().structure == "....."


def test_lines_and_lookups(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one/two.ct\nACGU\n>three.ct\nGG--\n")
    (tmp_path / "y.fasta").write_text(">z two\nA-CGU\n")
    (tmp_path / "23S.fasta").write_text(">missing.ct\nACGU\n")
    lines = files.lines_of(spark, str(tmp_path), "*.fasta").withColumn("file", files.base_name())
    found = files.looked_up(spark.createDataFrame([("two",), ("none",), ("",), (None,)], "query string"), lines).collect()
    assert [tuple(r) for r in found] == [("two", "x.fasta", ">one/two.ct", "ACGU")]
    truth = files.ground_truth(lines.where("file in ('y.fasta', '23S.fasta')"), lines.union(spark.createDataFrame([("w", 0, "z two"), ("w", 1, "CC")], lines.schema)))
    assert [(r.header, r.text) for r in truth.collect()] == [(">z two", "A-CGU")] or truth.count() == 1
    with pytest.raises(Exception, match="no entry"):
        files.ground_truth(lines, lines.where("file = 'y.fasta'")).collect()
    assert files.looked_up(spark.createDataFrame([], "query string"), lines).count() == 0
    text = '[{"input_dir": "a", "k": 3, "count": [1, 2], "output_dir": ["x", "y"]}, {"input_dir": "b", "k": 4, "count": [5], "output_dir": ["z"]}]'
    assert [(r.input_dir, r.k, r["count"], r.output_dir) for r in files.run_settings(spark.createDataFrame([(text,)], "value string")).collect()] == [("a", 3, 1, "x"), ("a", 3, 2, "y"), ("b", 4, 5, "z")]


def test_samples(spark, families):
    _, msa = families
    drawn = sampling.sampled_sets(msa.where("fam in ('a', 'b')"), 3, 5, seed=1)
    by = {}
    for r in drawn.collect():
        by.setdefault((r.fam, r.replicate), set()).add(r.seq)
    assert len(by) == 10 and all(len(v) == 3 for v in by.values()) and len({frozenset(v) for k, v in by.items() if k[0] == "a"}) > 1
    assert {tuple(r) for r in drawn.repartition(3).collect()} == {tuple(r) for r in sampling.sampled_sets(msa.where("fam in ('a', 'b')"), 3, 5, seed=1).collect()}
    with pytest.raises(Exception, match="fewer than 3"):
        sampling.sampled_sets(msa, 3, 1).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "fam int, seq int, text string")
    counts = P.pair_counts(none)
    pairs = P.pairable(P.scored(counts))
    upto = C.cumulative_occupancy(cells_of(none, "fam"))
    for df in (counts, pairs, P.enclosing(pairs, upto), C.row_identity(none), C.mean_length(none), P.next_pairable(pairs), P.beam(pairs, 3), B.crossings(pairs), B.layers(pairs)):
        assert df.count() == 0
    with pytest.raises(Exception, match="equal lengths"):
        P.pair_counts(spark.createDataFrame([(1, 0, "AC"), (1, 1, "ACG")], none.schema).coalesce(1)).collect()
    with pytest.raises(Exception, match="letters other"):
        C.checked(spark.createDataFrame([(1, 0, "AX")], none.schema)).collect()
