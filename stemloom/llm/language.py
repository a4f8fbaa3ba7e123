"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3-grams and 4-grams, hashed
into ``BUCKETS`` rows. Embeddings and softmax are trained together by stochastic
gradient descent in NumPy on a bounded sample (``per_language`` texts of each
language, a documented parameter); a fifth of it sets the temperature, and the
score from which a prediction is accepted. As mean and softmax weights are
linear, embeddings times weights are one table at scoring time.

Defined results: null texts and texts without a letter get ``und`` with score 0;
texts of fewer than three bytes have no subwords and get the bias alone; rows
without a language don't train; with no training rows everything is ``und``;
repeated rows are predicted alike; an empty table gives no rows; language,
source and doc_id are no inputs of a prediction; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import LOWER, Chunk, byte_table, chunks
from stemloom.llm.store import BYTES, cut, fitted

BUCKETS = 1 << 15
DIMENSIONS = 16
SIZES = (3, 4)
LETTER = byte_table([(0x41, 0x5A), (0x61, 0x7A)])
#: Letters in lower case, other bytes of ASCII as blanks.
FOLD = np.where(byte_table([(0x61, 0x7A), (0x80, 0xFF)])[LOWER], LOWER, 0x20).astype(np.uint32)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams that lie in one text, and how many each text has; the rest are BUCKETS."""
    f, out = FOLD[data], []
    last = np.repeat(offsets[1:], np.diff(offsets))
    for n in SIZES:
        h = np.full(len(f), n, np.uint32)
        for k in range(n):
            h[: len(f) - k] = (h[: len(f) - k] ^ f[k:]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        b = (h % np.uint32(BUCKETS)).astype(np.int64)
        b[np.arange(len(f)) + n > last] = BUCKETS
        out.append(b)
    size = np.diff(offsets)
    return np.stack(out), sum(np.maximum(size - n + 1, 0) for n in SIZES)


def logits(c: Chunk, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    b, size = subwords(c.data, c.offsets)
    out = np.zeros((c.hi - c.lo, table.shape[1]))
    full = np.flatnonzero(np.diff(c.offsets))
    if len(full):
        each = table[b[0]]
        for x in b[1:]:
            each += table[x]
        out[full] = np.add.reduceat(each, c.offsets[:-1][full], axis=0)
    return out / np.maximum(size, 1)[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], names: list[str], epochs: int = 8, rate: float = 2.0, batch: int = 16, seed: int = 5) -> Model:
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in names])
    rows = []
    for c in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})):
        b, _ = subwords(c.data, c.offsets)
        for i in range(c.hi - c.lo):
            u, n = np.unique(b[:, c.offsets[i] : c.offsets[i + 1]], return_counts=True)
            use = u < BUCKETS
            rows.append((u[use], (n[use] / max(1, n[use].sum())).astype(np.float32)))
    held = np.arange(len(y)) % 5 == 4
    own = np.flatnonzero(~held)
    e = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((DIMENSIONS, len(languages))) * 0.1).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    share = np.bincount(y[own], minlength=len(languages)) / max(1, len(own))
    weight = (1 / np.maximum(share, 1e-9) / len(languages))[y]
    for k in range(epochs):
        step = rate * (1 - k / epochs)
        order = rng.permutation(own)
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            u = np.stack([x @ e[b] for b, x in (rows[i] for i in ids)])
            d = softmax(u @ w + bias)
            d[np.arange(len(ids)), y[ids]] -= 1
            d = d * np.minimum(weight[ids], 10)[:, None]
            du = d @ w.T
            w -= (step * 0.1 * (u.T @ d)).astype(np.float32)
            bias -= (step * 0.02 * d.sum(0)).astype(np.float32)
            for i, g in zip(ids, du, strict=True):
                b, x = rows[i]
                e[b] -= (20 * step * x[:, None] * g[None, :]).astype(np.float32)
    table = np.vstack([e @ w, np.zeros((1, len(languages)), np.float32)])
    test = [rows[i] for i in np.flatnonzero(held)] or [rows[0]]
    want = y[held] if held.any() else y[:1]
    z = np.stack([x @ table[b] for b, x in test]) + bias
    loss = {t: -np.log(softmax(z / t)[np.arange(len(want)), want] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    t = float(min(loss, key=loss.get))
    p = softmax(z / t)
    wrong = p.max(1)[p.argmax(1) != want]
    return Model(languages, table, bias.astype(float), t, float(max(wrong, default=0.0)))


def train(docs: DataFrame, wanted, per_language: int = 600, languages: int = 1_000) -> Model:
    """Fits on about ``per_language`` texts of any length of each language among the rows ``wanted``; on fewer of a language where they exceed its part of ``store.BYTES``.

    The commonest ``languages`` are learnt. A language's rows are counted, and those whose hash lies below the share that is
    wanted are taken, so that no task ranks a language's rows; the least hashes of these are used, ``per_language`` at most.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & wanted).select(F.col("lang").cast("string").alias("y"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = cut(own.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "y").limit(languages))
    each = BYTES // max(1, sizes.count())
    sizes = sizes.withColumn("most", F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.col("n") * each / F.greatest("bytes", F.lit(1))))))
    place = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    some = own.join(F.broadcast(sizes), "y").where(place * F.col("n") < F.col("most") + 6 * F.sqrt("most")).select("y", "h", "text", "most").distinct()

    def run(t: pa.Table) -> tuple:
        t = t.sort_by([("h", "ascending"), ("y", "ascending"), ("text", "ascending")])
        taken: dict[str, int] = {}
        keep = []
        for y, most in zip(t.column("y").to_pylist(), t.column("most").to_pylist(), strict=True):
            taken[y] = taken.get(y, 0) + 1
            keep.append(taken[y] <= most)
        t = t.filter(pa.array(keep, pa.bool_()))
        return tuple(fit(t.column("text").to_pylist(), t.column("y").to_pylist()))

    return Model(*fitted(some, run))


def has_letter(c: Chunk) -> np.ndarray:
    count = np.concatenate(([0], np.cumsum(LETTER[c.data])))
    out = np.diff(count[c.offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(c.offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in c.data[c.offsets[i] : c.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out & ~c.null


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) and accepted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # of fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for c in chunks(batch):
                n = c.hi - c.lo
                letters = has_letter(c)
                if m.languages:
                    p = softmax(logits(c, m.table, m.bias) / m.temperature)
                    best, score = p.argmax(1), p.max(1)
                else:
                    letters, best, score = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
                names = np.array([*m.languages, "und"], object)[np.where(letters, best, len(m.languages))]
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(c.lo, n), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "accepted": pa.array(letters & (score > m.accept))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
