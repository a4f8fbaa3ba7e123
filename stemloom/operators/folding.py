"""Consensus structures of alignments: best structure, pair probabilities, ensemble structures and samples.

Input is (msa, seq, text), a row for each sequence. Equal rows of an alignment
are counted before the shuffle, and each alignment is folded in one task, by a
beam sweep whose work is linear in its columns: an alignment is the unit of the
model, as each state's score is a sum over all its rows. Alignments run in
parallel. Null texts count as rows of no columns; rows of unequal length raise
an error, an empty table gives no rows, and an alignment of no columns has an
empty structure of energy 0. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stemloom.functions import structures as st
from stemloom.functions.beam import CHARTS, KT, Sweep
from stemloom.functions.conservation import alignment, pairable, substitution
from stemloom.functions.energies import Energies, builtin, from_par


TASKS_PER_CORE = 4


@dataclass(frozen=True)
class Model:
    """``parameters``: text of an energy file, the built-in set if None. ``loops``: entries of the built-in set's small internal loops, see ``Energies.listing``. ``tables``: substitution matrices by identity bins, see ``substitution_tables``. ``lazy`` and ``floor``: see ``beam``. ``tasks``: how many the alignments are dealt over."""

    beam: int = 100
    cutoff: float = -40
    beta: float = 1.2
    delta: float = 0.1
    gamma: float = 2
    threshold: float = 0.3
    by_columns: bool = False
    lazy: bool = False
    floor: float | None = -20.0
    tasks: int | None = None
    parameters: str | None = None
    loops: tuple[tuple, ...] | None = None
    tables: dict[tuple[int, int], list[list[float]]] | None = None

    def energies(self) -> Energies:
        own = builtin() if self.parameters is None else from_par(self.parameters)
        return own if self.loops is None else own.listing(self.loops)


def substitution_tables(rows: DataFrame) -> dict[tuple[int, int], list[list[float]]]:
    """(max_bin, min_bin, k, l, value) to matrices of pair types; at most 20 x 20 bins of 7 x 7 values are read."""
    out: dict[tuple[int, int], list[list[float]]] = {}
    for r in rows.where("max_bin between 0 and 20 and min_bin between 0 and 20 and k between 0 and 6 and l between 0 and 6").groupBy("max_bin", "min_bin", "k", "l").agg(F.max("value").alias("value")).collect():
        out.setdefault((r.max_bin, r.min_bin), [[0.0] * 7 for _ in range(7)])[r.k][r.l] = float(r.value)
    return out


def _swept(table: pa.Table, m: Model, energies: Energies, summed: bool) -> tuple[Sweep, object]:
    rows = sorted(zip(table.column("text").to_pylist(), table.column("n").to_pylist(), strict=True))
    a = alignment([t for t, _ in rows], [n for _, n in rows])
    pairs = pairable(a, substitution(a, {k: np.array(v) for k, v in m.tables.items()} if m.tables else None), m.cutoff, m.beta, m.delta)
    return Sweep(a, pairs, energies, m.beam, summed, m.by_columns, m.floor), pairs


COUNTED = ("reached", "kept", "edges")


def _each(msa: DataFrame, m: Model, summed: bool, schema: str, rows: Callable[[object, Sweep, object], dict[str, list]], watched: Observation | None = None) -> DataFrame:
    """Alignments are few rows of much work, so their number of tasks is set here: by their bytes they would all be put into one.

    ``watched`` gets the sums of the sweeps' counters, named by chart and count, from the run that makes the rows.
    """
    spark = msa.sparkSession
    kind = msa.schema["msa"].dataType
    whole = f"msa {kind.simpleString()}, {schema}"
    if watched:
        whole += "".join(f", `{x}.{c}` long" for x in CHARTS for c in COUNTED)
    tasks = m.tasks or TASKS_PER_CORE * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = msa.select("msa", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("msa", "text").agg(F.count("*").alias("n")).repartition(tasks, "msa")
    shape = spark.createDataFrame([], whole).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    watched_too = watched is not None

    def run(table: pa.Table) -> pa.Table:
        key = table.column("msa")[0].as_py()
        sweep, pairs = _swept(table, m, m.energies(), summed)
        out = rows(key, sweep, pairs)
        n = len(next(iter(out.values())))
        if watched_too:
            out |= {f"{x}.{c}": [sweep.seen[x][k] for _ in range(n)] for x in CHARTS for k, c in enumerate(COUNTED)}
        return pa.Table.from_pydict({"msa": [key] * n} | out, arrow)

    found = counted.groupBy("msa").applyInArrow(run, whole)
    if watched is None:
        return found
    names = [f"{x}.{c}" for x in CHARTS for c in COUNTED]
    return found.observe(watched, *[F.sum(f"`{c}`").alias(c) for c in names]).drop(*[F.col(f"`{c}`") for c in names])


def observed(watched: Observation) -> list[tuple[str, int, int, int]]:
    """(chart, reached, kept, edges) summed over the alignments of a run that is done."""
    found = watched.get
    return [(x, *(int(found[f"{x}.{c}"] or 0) for c in COUNTED)) for x in CHARTS if found.get(f"{x}.reached")]


def fold(msa: DataFrame, m: Model = Model(), watched: Observation | None = None) -> DataFrame:
    """(msa, structure, mfe, energy, covariation) in kcal/mol; mfe is the sum of the two parts. ``watched``: see ``observed``."""

    def rows(key: object, s: Sweep, pairs) -> dict[str, list]:
        found = s.structure()
        i, j = (np.array([p[k] for p in found], int) for k in (0, 1))
        covariation = -float(pairs.of(i, j).sum()) / 100
        return {"structure": [st.brackets(s.length, found)], "mfe": [-s.total / 100], "energy": [-s.total / 100 - covariation], "covariation": [covariation]}

    return _each(msa, m, False, "structure string, mfe double, energy double, covariation double", rows, watched)


def counters(msa: DataFrame, m: Model = Model(), summed: bool = True) -> DataFrame:
    """(msa, chart, reached, kept, edges): states that a sweep reached and kept in each chart, and the edges kept with them."""

    def rows(key: object, s: Sweep, pairs) -> dict[str, list]:
        names = sorted(s.seen)
        return {"chart": names} | {c: [s.seen[x][n] for x in names] for n, c in enumerate(("reached", "kept", "edges"))}

    return _each(msa, m, summed, "chart string, reached long, kept long, edges long", rows)


ENSEMBLE = ("ensemble", "printed", "gamma", "pmcc", "threshknot", "centroid", "mea")


def explored(msa: DataFrame, m: Model = Model(), structures: bool = True, probabilities: bool = True, count: int = 0, seed: int = 0, watched: Observation | None = None) -> DataFrame:
    """All that one sweep of an alignment tells: the columns of ``ensemble``, ``pairs`` of (i, j, prob) and ``samples``; what isn't asked for is null.

    ``printed`` is the energy as tools of this kind print it, per row and in units of kT. gamma <= 0 takes the gamma of best expected correlation (pmcc), else pmcc is null.
    Centroid and mea use pairs with a probability over 1 / (gamma + 1); of all gammas tried, the least.
    """

    def rows(key: object, s: Sweep, pairs) -> dict[str, list]:
        out: dict[str, list] = {"ensemble": [-s.total * KT / 100], "printed": [-s.total / 100 / s.a.total]} | {c: [None] for c in (*ENSEMBLE[2:], "pairs", "samples")}
        if structures or probabilities:
            i, j, p = s.probabilities(m.lazy)
        if probabilities:
            out["pairs"] = [[{"i": x, "j": y, "prob": z} for x, y, z in zip(i.tolist(), j.tolist(), p.tolist(), strict=True)]]
        if structures:
            gamma, pmcc, least = m.gamma, None, m.gamma
            if gamma > 0:
                middle = st.centroid(s.length, i, j, p, gamma)
            else:
                gamma, pmcc, middle = st.best_gamma(s.length, i, j, p)
                least = min(st.GAMMAS)
            accurate = st.greatest_accuracy(s.length, i, j, p, gamma, 1 / (least + 1))
            best, kinds = st.mutual_best(i, j, p, m.threshold)
            draw = lambda ks: st.brackets(s.length, [(int(i[k]), int(j[k])) for k in ks])
            out |= {"gamma": [float(gamma)], "pmcc": [pmcc], "threshknot": [st.brackets(s.length, best, kinds)], "centroid": [draw(middle)], "mea": [draw(accurate)]}
        if count:
            texts = []
            for k in range(count):
                start = int.from_bytes(hashlib.blake2b(repr((seed, key, k)).encode(), digest_size=8).digest(), "little")
                texts.append(st.brackets(s.length, s.structure(np.random.Generator(np.random.Philox(key=start)))))
            out["samples"] = [texts]
        return out

    return _each(msa, m, True, "ensemble double, printed double, gamma double, pmcc double, threshknot string, centroid string, mea string, pairs array<struct<i: int, j: int, prob: double>>, samples array<string>", rows, watched)


def listed_pairs(found: DataFrame) -> DataFrame:
    """(msa, i, j, prob) of the pairs of ``explored``."""
    return found.select("msa", F.explode("pairs").alias("p")).select("msa", "p.*")


def listed_samples(found: DataFrame) -> DataFrame:
    """(msa, sample, structure) of the samples of ``explored``."""
    return found.select("msa", F.posexplode("samples").alias("sample", "structure"))


def pair_probabilities(msa: DataFrame, m: Model = Model()) -> DataFrame:
    """(msa, i, j, prob) of pairs of columns, from 0."""
    return listed_pairs(explored(msa, m, structures=False))


def ensemble(msa: DataFrame, m: Model = Model()) -> DataFrame:
    """Free energy of the ensemble and its structures: mutual-best pairs, centroid and greatest expected accuracy; see ``explored``."""
    return explored(msa, m, probabilities=False).select("msa", *ENSEMBLE)


def samples(msa: DataFrame, count: int, seed: int = 0, m: Model = Model()) -> DataFrame:
    """(msa, sample, structure): ``count`` structures an alignment, drawn by their weight; the same seed gives the same ones anywhere."""
    return listed_samples(explored(msa, m, structures=False, probabilities=False, count=count, seed=seed))


def evaluated(pairs: DataFrame, slip: bool = False) -> DataFrame:
    """The columns of (…, gold, predicted) with precision, sensitivity, f1 and distance of the two structures."""
    schema = pairs.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", precision double, sensitivity double, f1 double, distance int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [st.compared(g, p, slip) for g, p in zip(b.column("gold").to_pylist(), b.column("predicted").to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, (*[pa.float64()] * 3, pa.int32()), strict=True))], names=[*b.schema.names, "precision", "sensitivity", "f1", "distance"])

    return pairs.mapInArrow(run, fields)


def projections(msa: DataFrame, folded: DataFrame) -> DataFrame:
    """(msa, seq, structure): the structure of each alignment on each of its rows, without gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [st.projected(s, t) for s, t in zip(b.column("structure").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("msa"), b.column("seq"), pa.array(texts, pa.string())], names=["msa", "seq", "structure"])

    kinds = {f.name: f.dataType.simpleString() for f in msa.schema}
    joined = msa.select("msa", "seq", "text").join(folded.select("msa", "structure"), "msa")
    return joined.mapInArrow(run, f"msa {kinds['msa']}, seq {kinds['seq']}, structure string")


__all__ = ["Model", "counters", "ensemble", "explored", "listed_pairs", "listed_samples", "evaluated", "fold", "observed", "pair_probabilities", "projections", "samples", "substitution_tables"]
