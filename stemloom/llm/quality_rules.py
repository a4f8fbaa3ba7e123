"""Quality rules whose thresholds come from the data.

Each document gets counts of words, symbols, repeated lines and repeated word
windows. Their ratios are summed up per (lang, source) in mergeable quantile
sketches with relative-error buckets: a sketch is a table of bucket counts, so
two sketches merge by adding, partial sums are made before the shuffle, and the
result doesn't depend on the order of the rows. A group's quantiles set its
fences: word length has one on either side of the median, some spreads of the
group away; each other ratio has a rate, somewhat over an upper quantile of the
group. The fences are joined back to the documents by group, and a document is
dropped whose word length lies outside, or whose count exceeds what the rate
makes expected at its length by three standard deviations of such a count.

Defined results: a null or empty text has no words, fails the base rule and is
dropped; null ``lang`` or ``source`` form groups of their own; a group's fence
is drawn to that of all documents with the weight of ``min_group`` documents;
an empty table gives no rows; repeated rows are judged alike, each with its own
row; columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.llm.arrowtext import NON_SPACE, byte_table, chunks, digests, grams, lengths, mix, runs
from stemloom.llm.store import cut

SYMBOLS = byte_table([(ord(c), ord(c)) for c in "#*$%&|<>"])
NOT_NEWLINE = byte_table([(0x0A, 0x0A)], invert=True)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Relative width of a sketch's buckets, ratios being counted in thousandths.
GAMMA = 1.01
METRICS = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: For each ratio its count, what that is a share of, and the quantile that sets the rate: below the share of bad documents
#: that a group may have. Symbols fill whole documents, repeats are a few lines of many.
RATES = {"symbol_ratio": ("n_symbols", "n_words", 0.85), "dup_line_ratio": ("n_dup_lines", "n_lines", 0.98), "repeat_ratio": ("n_repeat_words", "n_words", 0.98)}


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key comes twice or more in its row, and whether it came before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(keys + mix(rows.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    k = own[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] = same
    multiple = again.copy()
    multiple[:-1] |= same
    out = np.empty(len(k), bool), np.empty(len(k), bool)
    out[0][order], out[1][order] = multiple, again
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The six counts of each text of a chunk."""
    n = len(offsets) - 1
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    starts, ends, rows = runs(data, offsets, NON_SPACE)
    words = digests(data, starts, ends)
    gram, first = grams(words, rows, 3)
    multiple, _ = _repeats(gram, rows[first])
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[first[multiple] + k] = True
    ls, le, lrows = runs(data, offsets, NOT_NEWLINE)
    has = np.concatenate(([0], np.cumsum(np.bincount(starts, minlength=len(data) + 1) > 0)))
    full = has[le] > has[ls] if len(ls) else np.zeros(0, bool)
    ls, le, lrows = ls[full], le[full], lrows[full]
    _, again = _repeats(digests(data, ls, le), lrows)
    return {
        "n_words": lengths(rows, n),
        "word_chars": total(NON_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(SYMBOLS[data]),
        "n_dup_lines": lengths(lrows[again], n),
        "n_repeat_words": lengths(rows[np.flatnonzero(covered[: len(words)])], n),
        "n_lines": lengths(lrows, n),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                part = batch.slice(c.lo, c.hi - c.lo)
                own = {k: pa.array(v, pa.int64()) for k, v in counts(c.data, c.offsets).items()}
                yield pa.RecordBatch.from_pydict({k: part.column(i) for i, k in enumerate(("doc_id", "lang", "source"))} | own)

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(measure, schema)


def _metrics() -> dict[str, Column]:
    """Ratios in thousandths."""
    share = lambda count, of: F.floor(1000 * F.col(count) / F.greatest(F.col(of), F.lit(1)))
    return {"word_length": share("word_chars", "n_words")} | {m: share(count, of) for m, (count, of, _) in RATES.items()}


def sketch(measured: DataFrame, *groups: str) -> DataFrame:
    """Bucket counts per group and metric; sketches of parts add up to the sketch of the whole."""
    bucket = lambda x: F.floor(F.log(1.0 + x) / F.log(F.lit(GAMMA)))
    long = measured.where("n_words > 0").select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"))
    return long.select(*groups, "x.*").groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], points: dict[str, float]) -> DataFrame:
    """The sketches' quantiles, as a bucket's lower edge; one row per group and metric.

    A group has at most about a thousand buckets, whatever its documents are, so the window is small.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*groups, "metric")
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    edge = F.pow(F.lit(GAMMA), F.col("bucket")) - 1
    return run.groupBy(*groups, "metric").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), edge)).alias(k) for k, q in points.items()])


def fences(sketches: DataFrame, groups: list[str], reach: float, over: float) -> DataFrame:
    """total, high and low of each group and metric; low is of word length alone.

    The spread of word length is the smaller half of the quartiles' range, so up to half of a group may lie far off on one side;
    it is a bucket's width at least, as a sketch tells no less apart.
    """
    q = quantiles(sketches, groups, {"q25": 0.25, "q50": 0.5, "q75": 0.75} | {m: at for m, (_, _, at) in RATES.items()})
    spread = F.greatest(F.least(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25")), (GAMMA - 1) * F.col("q50"))
    high = F.col("q50") + reach * spread
    for m in RATES:
        high = F.when(F.col("metric") == m, over * F.col(m)).otherwise(high)
    return q.select(*groups, "metric", "total", high.alias("high"), F.when(F.col("metric") == "word_length", F.col("q50") - reach * spread).alias("low"))


def limits(per_group: DataFrame, min_group: int, reach: float, over: float) -> DataFrame:
    """g_lang, g_source and the fences of each metric, one row per group: means of the group's own and those of all documents, weighted by the group's count and ``min_group``."""
    groups = ["lang", "source"]
    own, whole = fences(per_group, groups, reach, over), fences(per_group.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [], reach, over)
    both = own.join(F.broadcast(whole.select("metric", F.col("high").alias("all_high"), F.col("low").alias("all_low"))), "metric")  # four rows
    drawn = lambda c: (F.col("total") * F.col(c) + min_group * F.col(f"all_{c}")) / (F.col("total") + min_group)
    sides = [F.max(F.when(F.col("metric") == m, drawn(side))).alias(f"{m}_{side}") for m in METRICS for side in ("high", "low")]
    return both.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*sides)


def outlying() -> Column:
    """Of counts, ratios and their group's fences: whether a document lies beyond one; no fence, none is beyond it."""
    out = (F.col("word_length") > F.col("word_length_high")) | (F.col("word_length") < F.col("word_length_low"))
    for m, (count, of, _) in RATES.items():
        expected = F.col(f"{m}_high") / 1000 * F.col(of)
        out |= F.col(count) > expected + 3 * F.sqrt(expected + 1)
    return F.coalesce(out, F.lit(False))


def filter_quality(docs: DataFrame, min_group: int = 50, reach: float = 10.0, over: float = 1.5) -> DataFrame:
    """Counts, the base rule and the adaptive verdict for each document; what fails the base rule sets no fence.

    Word length may lie ``reach`` spreads from the median, a rate is ``over`` times its quantile.
    """
    measured = cut(text_counts(docs)).withColumns(_metrics())  # a few numbers a document; the texts are read once
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    g = limits(cut(sketch(measured.where(~base), "lang", "source")), min_group, reach, over)  # about a thousand rows a group at most
    joined = measured.join(g, measured.lang.eqNullSafe(g.g_lang) & measured.source.eqNullSafe(g.g_source), "left")
    return joined.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & ~outlying()).alias("kept"))
