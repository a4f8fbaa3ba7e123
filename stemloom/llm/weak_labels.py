"""Quality scores from weak labels.

``LABELLERS`` are overlapping heuristics; each calls a text good or bad, or
abstains where its ratio lies between its two limits. A text's votes are one
pattern, and the patterns of all documents are counted. Expectation-maximisation
on those counts estimates how often each labeller is right on good and on bad
texts, and so the posterior of every pattern. The posteriors are the soft labels
of a linear scorer over hashed terms (words, shapes of words, pairs of shapes,
and levels of the heuristics' ratios), fitted by Adagrad in NumPy on a bounded
sample of distinct texts (``sample``, a documented parameter) and applied to whole
texts. There are at most ``3 ** len(LABELLERS)`` patterns, whatever the corpus is.

Defined results: null and empty texts have no words, get score 0 and are not
kept; equal texts score alike, each with its own row; an empty table gives no
rows; columns other than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import ALNUM, LOWER, NON_SPACE, Chunk, RollingHash, byte_table, chunks, lengths, mix, runs
from stemloom.llm.quality_rules import counts
from stemloom.llm.store import chosen, cut, fitted

U64 = np.uint64
BUCKETS = 1 << 16
UPPER = byte_table([(0x41, 0x5A)])
LETTERS = byte_table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
MARKS = byte_table([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
#: Bytes by kind: upper case, lower case (other alphabets too), digits; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x80:], SHAPE[0x30:0x3A] = 0x41, 0x61, 0x61, 0x30


class Labeller(NamedTuple):
    """Good where the ratio is at most ``good``, bad where it is over ``bad``; otherwise it abstains."""

    name: str
    good: float
    bad: float


LABELLERS = (
    Labeller("symbols", 0.02, 0.15),
    Labeller("capitals", 0.2, 0.5),
    Labeller("marks", 0.5, 1.2),
    Labeller("repeated_lines", 0.1, 0.3),
    Labeller("repeated_words", 0.25, 0.5),
    Labeller("not_letters", 0.2, 0.4),
    Labeller("long_words", 10.0, 16.0),
    Labeller("few_words", 0.02, 0.1),
)


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float


def ratios(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' ratios, a row for each text, and the number of words."""
    n = counts(c.data, c.offsets)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[c.offsets])
    words, lines = np.maximum(n["n_words"], 1), np.maximum(n["n_lines"], 1)
    letters, filled = total(LETTERS[c.data]), np.maximum(total(NON_SPACE[c.data]), 1)
    out = [n["n_symbols"] / words, total(UPPER[c.data]) / np.maximum(letters, 1), total(MARKS[c.data]) / words, n["n_dup_lines"] / lines, n["n_repeat_words"] / words, 1 - letters / filled, n["word_chars"] / words, 1 / words]
    return np.stack(out, 1), n["n_words"]


def votes(ratio: np.ndarray) -> np.ndarray:
    """0 abstains, 1 bad, 2 good."""
    good, bad = np.array([x.good for x in LABELLERS]), np.array([x.bad for x in LABELLERS])
    return np.where(ratio <= good, 2, np.where(ratio > bad, 1, 0))


def patterns(vote: np.ndarray) -> np.ndarray:
    return (vote * 3 ** np.arange(len(LABELLERS))).sum(1)


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return np.asarray(pattern)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def posteriors(pattern: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a text of each pattern is good, and each labeller's accuracy on bad and on good texts.

    A vote counts by how often its labeller is right; abstaining says nothing. The
    start trusts every labeller alike and a bad vote more than a good one, as each
    heuristic knows one kind of bad text only; Beta priors keep the accuracies inside (0, 1).
    """
    v, n = unpacked(pattern), np.asarray(n, float)
    if not len(n):
        return np.zeros(0), np.full((2, len(LABELLERS)), 0.5)
    bad, good = (v == 1).astype(float), (v == 2).astype(float)
    p = np.where(bad.sum(1) > 0, 0.1, np.where(good.sum(1) > 0, 0.95, 0.5))
    prior = 2.0
    for _ in range(rounds):
        g, b = n * p, n * (1 - p)
        on_good = (g @ good + 4 * prior) / (g @ (good + bad) + 5 * prior)
        on_bad = (b @ bad + prior) / (b @ (good + bad) + 5 * prior)
        share = np.clip((g.sum() + 1) / (n.sum() + 2), 0.05, 0.95)
        z = np.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, np.stack([on_bad, on_good])


def terms(c: Chunk, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the distinct terms, sorted by row; a text's weights have length 1."""
    n, low = c.hi - c.lo, LOWER[c.data]
    starts, ends, rows = runs(low, c.offsets, ALNUM)
    hashes, owner = [RollingHash(low).span(starts, ends)], [rows]
    s, e, words = runs(c.data, c.offsets, NON_SPACE)
    shape = SHAPE[c.data]
    first = np.ones(len(shape), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[s] = True
    place = np.concatenate(([0], np.cumsum(first)))
    form = RollingHash(shape[first]).span(place[s], place[e])
    hashes.append(mix(form + U64(1)))
    owner.append(words)
    pair = np.flatnonzero(words[1:] == words[:-1])
    hashes.append(mix(form[pair] * U64(3) + form[pair + 1]))
    owner.append(words[pair])
    level = np.floor(4 * np.log2(ratio + 0.01)).astype(np.int64)
    for k in range(ratio.shape[1]):
        hashes.append(mix((level[:, k] + 1000 * (k + 1)).astype(U64)))
        owner.append(np.arange(n))
    key = np.sort(np.concatenate(owner).astype(U64) * U64(BUCKETS) + (np.concatenate(hashes) >> U64(20)) % U64(BUCKETS))
    key, count = np.unique(key, return_counts=True)
    row, x = (key // U64(BUCKETS)).astype(np.int64), np.log1p(count)
    norm = np.sqrt(np.bincount(row, x * x, minlength=n))
    return row, (key % U64(BUCKETS)).astype(np.int64), (x / np.maximum(norm[row], 1e-9)).astype(np.float32)


def surveyed(docs: DataFrame) -> DataFrame:
    """text_hash, bytes and pattern of every document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                ratio, n = ratios(c)
                yield pa.RecordBatch.from_pydict({"text_hash": batch.column(0).slice(c.lo, c.hi - c.lo), "size": batch.column(2).slice(c.lo, c.hi - c.lo), "pattern": pa.array(patterns(votes(ratio)), pa.int32()), "n_words": pa.array(n, pa.int64())})

    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"), F.octet_length(text).cast("long").alias("size")).mapInArrow(run, "text_hash long, size long, pattern int, n_words long").where("n_words > 0").drop("n_words")


def fit(texts: list[str], target: np.ndarray, epochs: int = 8, rate: float = 0.5, decay: float = 1e-5, batch: int = 32, seed: int = 11) -> Scorer:
    """Logistic regression on soft targets."""
    w, bias = np.zeros(BUCKETS, np.float32), 0.0
    if not texts:
        return Scorer(w, bias)
    rows = []
    for c in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})):
        r, b, x = terms(c, ratios(c)[0])
        at = np.searchsorted(r, np.arange(c.hi - c.lo + 1))
        rows += [(b[at[i] : at[i + 1]].astype(np.int32), x[at[i] : at[i + 1]]) for i in range(c.hi - c.lo)]
    rng, g, g0 = np.random.default_rng(seed), np.full(BUCKETS, 0.1, np.float32), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            r = np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])
            b, x = np.concatenate([rows[i][0] for i in ids]), np.concatenate([rows[i][1] for i in ids])
            z = bias + np.bincount(r, w[b] * x, minlength=len(ids))
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[ids]
            u, at = np.unique(b, return_inverse=True)
            d = np.bincount(at, e[r] * x, minlength=len(u)).astype(np.float32) + decay * w[u]
            g[u] += d * d
            w[u] -= rate * d / np.sqrt(g[u])
            g0 += float(e.sum()) ** 2
            bias -= rate * float(e.sum()) / g0**0.5
    return Scorer(w, bias)


def train(docs: DataFrame, sample: int = 4_000) -> Scorer:
    """Label model on the patterns of all documents; scorer on at most ``sample`` distinct texts of any length, those of least hash, or on fewer where they exceed ``store.BYTES``."""
    seen = cut(surveyed(docs))  # three numbers a document
    counted = seen.groupBy("pattern").count().toPandas()  # 3 ** labellers rows at most
    good = dict(zip(counted["pattern"], posteriors(counted["pattern"].to_numpy(), counted["count"].to_numpy())[0], strict=True))
    ids, most = chosen(seen.groupBy(F.col("text_hash").alias("h")).agg(F.min("pattern").alias("pattern"), F.max("size").alias("size")), sample)
    text = F.col("text").cast("string")
    own = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(F.broadcast(ids.select(F.col("h").alias("text_hash"), "pattern")), "text_hash")
    rows = own.groupBy("text_hash", "pattern").agg(F.max("text").alias("text"))

    def run(t: pa.Table) -> tuple:
        t = t.sort_by("text_hash").slice(0, most)
        return tuple(fit(t.column("text").to_pylist(), np.array([good[x] for x in t.column("pattern").to_pylist()], float)))

    return Scorer(*fitted(rows, run))


def score(docs: DataFrame, scorer: Scorer, least: float = 0.9) -> DataFrame:
    """doc_id, n_words, score and kept (score of ``least`` or more) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(scorer))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(*shared.value)
        for batch in batches:
            for c in chunks(batch):
                ratio, n = ratios(c)
                row, b, x = terms(c, ratio)
                z = m.bias + np.bincount(row, m.weights[b] * x, minlength=c.hi - c.lo)
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(c.lo, c.hi - c.lo), "n_words": pa.array(n, pa.int64()), "score": pa.array(p), "kept": pa.array((n > 0) & (p >= least))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, score double, kept boolean")
