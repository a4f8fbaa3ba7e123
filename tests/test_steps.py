"""Steps of a fold over tables against the array kernel, brute force and worked-out cases; their SQL is compared in test_relations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemloom.functions import structures as st
from stemloom.functions.conservation import alignment, pairable, substitution
from stemloom.functions.energies import BASE, TYPE, builtin
from stemloom.functions.matching import greatest_matching
from stemloom.operators import brackets, loops, slips, substitutions, tracebacks
from stemloom.operators import columns as C
from stemloom.operators import pairs as P
from stemloom.operators import probabilities as B
from stemloom.operators.folding import Model, counters, fold, observed
from stemloom.sources import files
from stemloom.sources.alignments import cells_of


def random_rows(seed, rows, width, gap=0.15):
    rng = random.Random(seed)
    first = [rng.choice("ACGU") for _ in range(width)]
    return ["".join(rng.choice("ACGU-") if rng.random() < gap * (1 + r % 3) else c for c in first) for r in range(rows)]


def msa_of(spark, groups):
    return spark.createDataFrame([(f, s, t) for f, rows in enumerate(groups) for s, t in enumerate(rows)], "fam int, seq int, text string")


def test_log_sum_is_one_state_in_one_shuffle(spark):
    rng = random.Random(1)
    rows = [(k % 7, rng.uniform(-900, 900)) for k in range(4000)] + [(8, None), (9, -math.inf), (10, -math.inf), (10, 3.0), (11, None), (11, 2.0), (None, 1.0), (12, math.inf)]
    found = P.log_sum(spark.createDataFrame(rows, "k int, v double").repartition(6), "v", "k")
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    for r in found.collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        if not own:
            assert r.lse is None
        elif max(own) in (math.inf, -math.inf):
            assert r.lse == max(own)
        else:
            assert abs(r.lse - max(own) - math.log(sum(math.exp(v - max(own)) for v in own))) < 1e-6


def test_log_sum_with_few_states_held(spark, monkeypatch):
    monkeypatch.setattr(P, "STATES", 1)
    r = P.log_sum(spark.range(2000).selectExpr("id % 3 as k", "cast(id as double) as v"), "v", "k").collect()
    assert len(r) == 3 and all(abs(x.lse - (1999 - (1999 - x.k) % 3) - math.log(1 / (1 - math.exp(-3)))) < 1e-9 for x in r)
    assert not P.log_sum(spark.createDataFrame([], "k int, v double"), "v", "k").count()


def test_counts_in_blocks_of_columns(spark, monkeypatch):
    msa = msa_of(spark, [random_rows(2, 5, 41), random_rows(3, 3, 7)])
    whole = sorted(map(tuple, P.pair_counts(msa).collect()))
    monkeypatch.setattr(P, "BLOCK", 6)
    assert sorted(map(tuple, P.pair_counts(msa).collect())) == whole and len(whole) == 41 * 20 + 21


def test_substitutions_by_identity_bins(spark):
    groups = [random_rows(s, 4, 60, gap) for s, gap in ((5, 0.02), (6, 0.1), (7, 0.3))] + [["ACGU" * 10] * 3, ["GGGAAACCCU"]]
    msa = msa_of(spark, groups)
    rng = random.Random(9)
    values = {(top, low): [[rng.uniform(-2, 4) if k and m else 0.0 for m in range(7)] for k in range(7)] for top in range(12, 21) for low in (1, 7, 12)}
    rows = [(top, low, k, m, v[k][m]) for (top, low), v in values.items() for k in range(7) for m in range(7)]
    tables = spark.createDataFrame(rows, "max_bin int, min_bin int, k int, l int, value double")
    used = {r.fam: r for r in substitutions.chosen(C.identity_bins(msa), tables).collect()}
    assert set(used) == {0, 1, 2} and any(r.used < r.min_bin for r in used.values())
    found = {(r.fam, r.i, r.j): r.pscore for r in substitutions.scored(P.pair_counts(msa), substitutions.matrices(msa, tables)).collect()}
    for f, rows in enumerate(groups):
        a = alignment(rows, [1] * len(rows))
        known = pairable(a, substitution(a, {k: np.array(v) for k, v in values.items()}), cutoff=-1e9)
        assert {(k // known.length, k % known.length): pytest.approx(s, abs=1e-5) for k, s in zip(known.key.tolist(), known.score.tolist(), strict=True)} == {(i, j): s for (g, i, j), s in found.items() if g == f}
    with pytest.raises(Exception, match="no substitution table"):
        substitutions.matrices(msa, tables.where("min_bin = 12 and max_bin = 12")).collect()


@pytest.mark.parametrize("listed", [False, True])
def test_loop_energies_equal_the_kernel(spark, listed):
    groups = [random_rows(11, 3, 46, 0.25)]
    msa = msa_of(spark, groups)
    cells = cells_of(msa, "fam")
    e = builtin()
    if listed:
        rng = random.Random(4)
        e = e.listing([("1x1", a, b, x, y, 0, 0, rng.randint(-99, 99)) for a, b, x, y in itertools.product(range(1, 8), range(1, 8), range(5), range(5))] + [("1x2", a, b, x, y, z, 0, rng.randint(-99, 99)) for a, b, x, y, z in itertools.product(range(1, 8), range(1, 8), range(5), range(5), range(5))] + [("2x2", a, b, x, y, 1, 2, rng.randint(-99, 99)) for a, b, x, y in itertools.product(range(1, 8), range(1, 8), range(5), range(5))])
    pairs = spark.createDataFrame([(0, i, j) for i in range(46) for j in range(i + 4, 46) if (i * 7 + j) % 3 == 0], "fam int, i int, j int")
    near = P.enclosing(pairs, C.cumulative_occupancy(cells), 34)
    found = loops.loop_energies(cells, near, e=e).collect()
    a = alignment(groups[0], [1] * 3)
    s, p, q, i, j = (np.array([r[c] for r in found]) for c in ("seq", "p", "q", "i", "j"))
    code, count, after, before = a.code, a.count, BASE[a.after], BASE[a.before]
    want = e.loops(count[s, i - 1] - count[s, p], count[s, q - 1] - count[s, j], TYPE[code[s, p], code[s, q]], TYPE[code[s, j], code[s, i]], after[s, p], before[s, q], before[s, i], after[s, j])
    assert len(found) > 10_000 and [r.energy for r in found] == want.tolist()
    assert {r.n1 + r.n2 for r in loops.loop_sites(cells, near).select("n1", "n2").distinct().collect()} >= set(range(34))


def test_special_hairpins_and_gaps(spark):
    msa = msa_of(spark, [["CA-ACGG-", "ACAGUACU", "GUUAC---"]])
    found = {(r.seq, r.kind, r.col): r.place for r in loops.special_loops(cells_of(msa, "fam")).collect()}
    assert len(found) == 3 * 3 * 8
    assert {k: v for k, v in found.items() if v >= 0} == {(0, "tri", 0): 0, (0, "tetra", 0): 0, (1, "hexa", 0): 0, (2, "tri", 0): 1}


def test_brackets_of_four_kinds(spark):
    rng = random.Random(12)

    def text(n):
        out = ["."] * n
        for kind in ("()", "[]", "{}", "<>"):
            free = [k for k in range(n) if out[k] == "."]
            opens = sorted(rng.sample(free, 2 * (len(free) // 6)))
            depth = 0
            for left, k in zip(range(len(opens), 0, -1), opens):
                up = depth == 0 or (depth < left and rng.random() < 0.5)
                out[k] = kind[0] if up else kind[1]
                depth += 1 if up else -1
        return "".join(out)

    texts = [text(rng.randint(0, 60)) for _ in range(200)] + [None, "", "()]", "x(y)z", "(("]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, structure string")
    found = {}
    for r in brackets.closing_pairs(df).orderBy("k", "nth").collect():
        found.setdefault(r.k, []).append(r)
    for k, t in enumerate(texts[:200]):
        assert [(r.i, r.j) for r in found.get(k, [])] == st.parsed(t)[0]
        assert all("([{<"[r.kind] == t[r.i] and ")]}>"[r.kind] == t[r.j] for r in found.get(k, []))
    assert 200 not in found and 201 not in found and 204 not in found
    assert [tuple(r)[1:] for r in found[202]] == [(None,) * 4] and [tuple(r)[1:] for r in found[203]] == [(0, 0, 1, 3)]
    brackets.register(spark)
    df.createOrReplaceTempView("bracketed")
    assert spark.sql("SELECT p.* FROM bracketed b, LATERAL bracket_pairs(b.structure) p").count() == sum(map(len, found.values()))


def test_tracebacks(spark):
    def plainly(back, lo, hi):
        if hi - lo < 4:
            return []
        i = back.get(hi)
        if i is not None and i >= lo:
            return [(i, hi), *plainly(back, i + 1, hi - 1), *plainly(back, lo, i - 1)]
        return plainly(back, lo, hi - 1)

    rng = random.Random(6)
    tables = {f: {j: rng.randint(0, j - 4) for j in range(5, 24) if rng.random() < 0.7} for f in range(4)}
    back = spark.createDataFrame([(f, j, i) for f, t in tables.items() for j, i in t.items()], "fam int, j int, i int")
    whole = spark.createDataFrame([(f, 0, 23) for f in tables] + [(9, 0, 3)], "fam int, lo int, hi int")
    found = tracebacks.traced(back, whole, 24)
    assert sorted((r.fam, r.i, r.j) for r in found.collect()) == sorted((f, *p) for f, t in tables.items() for p in plainly(t, 0, 23))


def test_greatest_matching_equals_all_matchings():
    rng = random.Random(3)
    for _ in range(300):
        edges = list({(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(0, 12))})
        found = greatest_matching(edges)
        assert set(found.items()) <= set(edges) and len(set(found.values())) == len(found)
        best = max(n for n in range(len(edges) + 1) if any(len({a for a, _ in c}) == n == len({b for _, b in c}) for c in itertools.combinations(edges, n))) if len(edges) < 10 else len(found)
        assert len(found) == best


def test_slips_over_tables(spark):
    rng = random.Random(8)
    width, texts = 40, []
    for f in range(12):
        gold, predicted = [], []
        for out in (gold, predicted):
            free = list(range(width))
            while len(free) > 8:
                i = free.pop(0)
                if rng.random() < 0.6:
                    out.append((i, free.pop(-rng.randint(1, 2))))
        texts.append((f, gold, predicted))
    frame = lambda k: spark.createDataFrame([(t[0], i, j) for t in texts for i, j in t[k]] + [(99, 1, 9)] * k, "fam int, i int, j int")
    spine = spark.range(width).select(F.explode(F.array(*map(F.lit, range(12)))).alias("fam"), F.col("id").cast("int").alias("col"))
    predicted, gold = frame(2), frame(1)
    match = slips.matched_slips(predicted, gold).collect()
    found = {r.fam: r for r in slips.compared(predicted, gold, spine).collect()}
    for f, g, p in texts:
        own = [(r.i, r.j, r.gi, r.gj) for r in match if r.fam == f]
        assert all(abs(i - x) + abs(j - y) <= 1 and (i, j) in p and (x, y) in g for i, j, x, y in own)
        assert len(own) == len(st.matching(p, g)) == len({r[:2] for r in own}) == len({r[2:] for r in own})
        prec, sens, f1, _ = st.scores(width, (g, []), (p, []), slip=True)
        assert (found[f].hit, found[f].prec, found[f].sens, found[f].f1) == (len(own), pytest.approx(prec), pytest.approx(sens), pytest.approx(f1))
    assert any(r.i != r.gi or r.j != r.gj for r in match)


def test_long_slip_chains_are_one_component(spark):
    n = 400
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(n)] + [(0, 1000, 1001), (1, 5, 4)], "fam int, a int, b int")
    parts = {(r.fam, r.a): r.part for r in slips.components(edges, "fam").collect()}
    assert {parts[0, k] for k in range(n + 1)} == {0} and parts[0, 1001] == 1000 and parts[1, 5] == 4


def test_gamma_grid(spark):
    rng = random.Random(2)
    bpp = [(f, i, j, rng.random() ** (3 * f + 1)) for f in range(3) for i in range(20) for j in range(i + 4, 20) if rng.random() < 0.1]
    spine = spark.range(20).select(F.explode(F.array(*map(F.lit, range(4)))).alias("fam"), F.col("id").cast("int").alias("col"))
    grid = B.expected_correlations(spark.createDataFrame(bpp, "fam int, i int, j int, prob double"), spine)
    rows = grid.collect()
    assert len(rows) == 4 * len(st.GAMMAS)
    best = {r.fam: r for r in B.best_gammas(grid).collect()}
    for f in range(3):
        p = np.array([x[3] for x in bpp if x[0] == f])
        wanted = (0.0, None)
        for g in st.GAMMAS:
            use = p > 1 / (g + 1)
            hit, mass, n = p[use].sum(), p.sum(), use.sum()
            rest = 20 * 9 - n - mass + hit
            square = n * mass * (rest + n - hit) * (rest + mass - hit)
            c = (hit * rest - (n - hit) * (mass - hit)) / math.sqrt(square) if square > 0 else 0.0
            assert next(r.correlation for r in rows if r.fam == f and r.gamma == g) == pytest.approx(c, abs=1e-9)
            wanted = (c, g) if round(c, 12) > round(wanted[0], 12) else wanted
        assert best[f].gamma == wanted[1]
    assert best[3].gamma is None and best[3].correlation is None


def test_names_in_natural_order(spark):
    names = ["k_10_2", "k_2", "k_10", "k_02", "a", "", "k", "k_2b", "k_2a10", "k_2a9", "k_" + "9" * 60, "k_1" + "0" * 60]
    found = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(files.natural("n")).collect()]
    assert found == ["", "a", "k", "k_2", "k_2a9", "k_2a10", "k_2b", "k_02", "k_10", "k_10_2", "k_" + "9" * 60, "k_1" + "0" * 60] or found.index("k_02") == found.index("k_2") + 1
    assert found.index("k_2") < found.index("k_10") < found.index("k_10_2") and found.index("k_2a9") < found.index("k_2a10") and found[-1] == "k_1" + "0" * 60


def test_counters_of_the_run_itself(spark):
    from pyspark.sql import Observation

    msa = spark.createDataFrame([(m, k, t) for m in range(3) for k, t in enumerate(random_rows(20 + m, 3, 40, 0.1))], "msa int, seq int, text string")
    watched = Observation("sweep")
    fold(msa, Model(beam=10), watched).collect()
    apart = counters(msa, Model(beam=10), False).groupBy("chart").agg(*[F.sum(c) for c in ("reached", "kept", "edges")]).orderBy("chart").collect()
    assert observed(watched) == [tuple(r) for r in apart]
