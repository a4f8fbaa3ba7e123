"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words, hashed into
``BUCKETS`` buckets and weighted by ``log(1 + count)``. The machine adds to the
linear weights the pairwise interactions of all terms through ``FACTORS`` latent
factors, so it learns combinations that no single term shows: terms are screened
by themselves and, where that leaves errors, in pairs. It is fitted by
Adagrad in NumPy on a bounded sample of labelled rows (``sample`` rows, a
documented parameter) and scored over whole texts.

Defined results: null and empty texts have no terms and get the score of the
bias alone; rows without a label, or whose label is null, don't train; with no
labelled rows, or labels of one kind, every score is the smoothed label rate;
repeated rows score alike; an empty table gives no rows; the label, language,
source and doc_id are no inputs of a score; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import ALNUM, LOWER, RollingHash, chunks, mix, runs
from stemloom.llm.store import chosen, fitted as fitted_in_task

U64 = np.uint64
BUCKETS = 1 << 18
FACTORS = 4
#: Bytes of the word beginnings that are terms of their own.
BEGINNINGS = (5, 6, 7)
#: Terms, and texts, whose common occurrences are counted at once.
PAIRED = 256
#: A label is given from this score on.
CUTOFF = 0.7


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float
    shift: float


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the distinct terms, sorted by row."""
    low = LOWER[data]
    starts, ends, rows = runs(low, offsets, ALNUM)
    rolling = RollingHash(low)
    hashes, owner = [rolling.span(starts, ends)], [rows]
    for k in BEGINNINGS:
        long = ends - starts > k
        hashes.append(mix(rolling.span(starts[long], starts[long] + k) + U64(k)))
        owner.append(rows[long])
    bucket = (np.concatenate(hashes) >> U64(20)) % U64(BUCKETS)
    key = np.concatenate(owner).astype(U64) * U64(BUCKETS) + bucket
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key // U64(BUCKETS)).astype(np.int64), (key % U64(BUCKETS)).astype(np.int64), np.log1p(count).astype(np.float32)


def margins(row: np.ndarray, bucket: np.ndarray, x: np.ndarray, n: int, m: Machine) -> np.ndarray:
    """w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2), for each of n rows."""
    out = m.bias + np.bincount(row, m.linear[bucket] * x, minlength=n)[:n]
    for f in range(m.factors.shape[1]):
        vx = m.factors[bucket, f] * x
        out += 0.5 * (np.bincount(row, vx, minlength=n)[:n] ** 2 - np.bincount(row, vx * vx, minlength=n)[:n])
    return out


def sampled(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, row, bucket, weight) of a bounded slice of the texts after another."""
    for c in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})):
        yield c.lo, c.hi, *terms(c.data, c.offsets)


def screened(texts: list[str], y: np.ndarray, least: int = 4, z: float = 4.0) -> np.ndarray:
    """Buckets whose share of texts, or whose mean weight, differs between the labels by z standard errors.

    Words are an open vocabulary; without the screen the many terms of a few texts each would drown the rest.
    """
    n1, n0 = (y == 1).sum(), (y != 1).sum()
    df, total, square = np.zeros(BUCKETS), np.zeros((2, 2, BUCKETS)), np.zeros((2, BUCKETS))
    for lo, hi, row, b, x in sampled(texts):
        x = x.astype(float)
        pos = (y[lo:hi] == 1)[row]
        df += np.bincount(b, minlength=BUCKETS)
        for k, value in enumerate((np.ones(len(x)), x)):
            square[k] += np.bincount(b, value**2, minlength=BUCKETS)
            for side, own in enumerate((~pos, pos)):
                total[k, side] += np.bincount(b[own], value[own], minlength=BUCKETS)
    known = np.zeros(BUCKETS, bool)
    for k in range(2):
        s0, s1 = total[k]
        mean = (s1 + s0) / len(y)
        error = np.sqrt(np.maximum(square[k] / len(y) - mean**2, 1e-12) * (1 / n1 + 1 / n0))
        known |= (np.abs(s1 / n1 - s0 / n0) > z * error) & (df >= least)
    return known


def paired(texts: list[str], toxic: np.ndarray, p: np.ndarray, z: float = 6.0, least: float = 0.1) -> np.ndarray:
    """Buckets of pairs that say what an additive machine's rates ``p`` miss, by z standard errors and ``least``.

    Its mean error on texts with both, less those on texts with one only, plus that on texts with none, is 0 where
    terms add up, however they go together. Fewer than z^2 texts with both, or with one only, can't be told from chance.
    """
    miss, mean = (toxic - p).astype(np.float32), toxic.mean()
    vary = np.maximum(miss**2, p * (1 - p)).astype(np.float32)
    df = np.zeros((3, BUCKETS))
    for lo, hi, row, b, _ in sampled(texts):
        own = (toxic[lo:hi] == 1)[row]
        df += np.bincount(b, minlength=BUCKETS), np.bincount(b[own], minlength=BUCKETS), np.bincount(b, np.maximum(miss[lo:hi], 0)[row], minlength=BUCKETS)
    often = np.flatnonzero((df[0] >= 2 * z**2) & (df[1] >= z**2 * (mean + (mean * (1 - mean)) ** 0.5)) & (df[2] >= least * z**2))
    if len(often) < 2:
        return often[:0]
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(len(often))
    rows: list[np.ndarray] = []
    for lo, hi, row, b, _ in sampled(texts):
        use = place[b] >= 0
        row, b = row[use], place[b[use]]
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        rows += [b[cut[i] : cut[i + 1]].copy() for i in range(hi - lo)]
    weights = (np.ones(len(rows), np.float32), miss, vary)
    single = [np.zeros(len(often), np.float32) for _ in weights]
    for k, own in enumerate(rows):
        for total, weight in zip(single, weights, strict=True):
            total[own] += weight[k]
    found = np.zeros(len(often), bool)
    for first in range(0, len(often), PAIRED):
        span = slice(first, first + PAIRED)
        both = [np.zeros((len(often[span]), len(often)), np.float32) for _ in weights]
        for lo in range(0, len(rows), PAIRED):
            some = rows[lo : lo + PAIRED]
            there = np.zeros((len(some), len(often)), np.float32)
            there[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)] = 1
            for total, weight in zip(both, weights, strict=True):
                total += (there[:, span] * weight[lo : lo + PAIRED, None]).T @ there
        differ, error, enough = 0, 0, True
        for sign, cell in ((1, lambda b, o, w: b), (-1, lambda b, o, w: o[span][:, None] - b), (-1, lambda b, o, w: o[None, :] - b), (1, lambda b, o, w: w.sum() - o[span][:, None] - o[None, :] + b)):
            n, t, v = (cell(b, o, w) for b, o, w in zip(both, single, weights, strict=True))
            enough = enough & (n >= z**2)
            n = np.maximum(n, 1)
            differ = differ + sign * t / n
            error = error + np.maximum(v / n, vary.mean()) / n
        differ = enough & (np.abs(differ) > np.maximum(z * np.sqrt(error), least))
        found |= differ.any(0)
        found[span] |= differ.any(1)
    return often[found]


def fit(texts: list[str], labels: np.ndarray) -> Machine:
    """A machine on the screened terms; where pairs of other terms say what it misses, another one on these too."""
    y = np.asarray(labels, float)
    m = fitted(texts, y, np.zeros(0, np.int64))
    if len(set(y.tolist())) < 2:
        return m
    z = np.concatenate([margins(r, b, x, hi - lo, m) for lo, hi, r, b, x in sampled(texts)])
    pairs = paired(texts, y, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return fitted(texts, y, pairs) if len(pairs) else m


def fitted(texts: list[str], labels: np.ndarray, pairs: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, batch: int = 32, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(mean / (1 - mean)))
    m = Machine(bias, np.zeros(BUCKETS, np.float32), (rng.standard_normal((BUCKETS, FACTORS)) * 0.01).astype(np.float32), 1.0, 0.0)
    if len(set(y.tolist())) < 2:
        return m._replace(factors=np.zeros_like(m.factors))
    known = screened(texts, y)
    known[pairs] = True
    m.factors[~known] = 0
    m.factors[pairs] *= 10  # a product of two factors grows from its own size
    pace = np.full((BUCKETS, 1), 0.1, np.float32)
    pace[pairs] = 1
    rows = []
    for lo, hi, r, b, x in sampled(texts):  # a second time, so that only screened terms are ever held
        use = known[b]
        r, b, x = r[use], b[use].astype(np.int32), x[use]
        cut = np.searchsorted(r, np.arange(hi - lo + 1))
        rows += [(b[cut[i] : cut[i + 1]].copy(), x[cut[i] : cut[i + 1]].copy()) for i in range(hi - lo)]
    w, v, w0, g0 = m.linear, m.factors, bias, 1.0
    gw, gv = np.full(BUCKETS, 1.0, np.float32), np.full(v.shape, 1.0, np.float32)
    weight = np.where(y == 1, 0.5 / mean, 0.5 / (1 - mean)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            size = [len(rows[i][0]) for i in ids]
            r, b, x = np.repeat(np.arange(len(ids)), size), np.concatenate([rows[i][0] for i in ids]), np.concatenate([rows[i][1] for i in ids])
            vx = v[b] * x[:, None]
            s = np.stack([np.bincount(r, vx[:, f], minlength=len(ids)) for f in range(FACTORS)], 1)
            z = w0 + np.bincount(r, w[b] * x, minlength=len(ids)) + 0.5 * ((s**2).sum(1) - np.bincount(r, (vx * vx).sum(1), minlength=len(ids)))
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) * weight[ids]).astype(np.float32)
            u, at = np.unique(b, return_inverse=True)
            d = np.bincount(at, e[r] * x, minlength=len(u)).astype(np.float32) + decay * w[u]
            gw[u] += d * d
            w[u] -= rate * d / np.sqrt(gw[u])
            dv = (e[r] * x)[:, None] * (s[r].astype(np.float32) - vx)
            d = np.stack([np.bincount(at, dv[:, f], minlength=len(u)) for f in range(FACTORS)], 1).astype(np.float32) + 10 * decay * v[u]
            gv[u] += d * d
            v[u] -= pace[u] * rate * d / np.sqrt(gv[u])
            g0 += float(e.sum()) ** 2
            w0 -= rate * float(e.sum()) / g0**0.5
    return Machine(w0, w, v, 1.0, 0.0)


def calibrated(m: Machine, texts: list[str], labels: np.ndarray) -> Machine:
    """Slope and shift of the margins, by logistic regression on rows that the machine wasn't fitted on."""
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        return m
    z = np.concatenate([margins(*terms(c.data, c.offsets), c.hi - c.lo, m) for c in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}))])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = max(0.05, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return m._replace(slope=float(a), shift=float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8_000) -> Machine:
    """Fits on at most ``sample`` distinct labelled rows of any length, those of least hash, a fifth of them for the calibration; on fewer where their texts exceed ``store.BYTES``."""
    ids = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    sized = own.select("doc_id", "h", F.octet_length("text").alias("size")).join(ids, "doc_id").distinct()
    some, most = chosen(sized, sample)
    rows = own.join(F.broadcast(some.select("h", "y")), "h").select("h", F.xxhash64("doc_id").alias("order"), "text", "y").distinct()  # about as many as the sample

    def run(t: pa.Table) -> tuple:
        t = t.sort_by([("h", "ascending"), ("text", "ascending"), ("y", "ascending")]).slice(0, most)
        t = t.sort_by([("order", "ascending"), ("text", "ascending"), ("y", "ascending")])
        texts, y = t.column("text").to_pylist(), t.column("y").to_numpy().astype(float)
        held = np.arange(len(y)) % 5 == 4
        m = fit([t for t, k in zip(texts, held, strict=True) if not k], y[~held])
        return tuple(calibrated(m, [t for t, k in zip(texts, held, strict=True) if k], y[held]))

    return Machine(*fitted_in_task(rows, run))


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in batches:
            for c in chunks(batch):
                z = margins(*terms(c.data, c.offsets), c.hi - c.lo, m)
                p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30)))
                part = batch.slice(c.lo, c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(k)) for k in keep], pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, score double, predicted int")
