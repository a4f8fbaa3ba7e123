"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed by the SHA-256 of its bytes. The
ledger holds one row for each blob and rule version that was scanned, with what
was found. A scan takes the blobs of the versions at hand, leaves out the pairs
of blob and rule version that the ledger has, reads each remaining blob once,
and joins all findings, old and new, back to every path that holds the blob.

A rule is a pattern with a least length of one of its groups. All matches are
taken leftmost and without overlap, then those that are too short are dropped.
Spans count code points; ends are exclusive.

Defined results: a null text is the empty blob; empty texts have no findings;
repeated rows and paths with equal texts share a blob and get its findings each;
an empty table gives no rows; a path is any value, null too; further columns are
ignored; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string>"
#: Characters of a text that are cut at once.
PART = 1024
LEDGER = f"blob string, kind string, version int, spans array<{SPAN}>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of longs, what ``join`` makes of all entries before it, from 0.

    Arrays grow by copying, and taking a part of one reads it all, so an array of n entries is taken in as many parts as each
    has entries: that is about 2 n steps for each of the root of n, 160,000 entries in a second or two.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    plain = lambda x: F.aggregate(x, start, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    totals = lambda parts: plain(F.transform(parts, lambda own: F.aggregate(own, F.lit(0).cast("long"), join)))

    def parted(x: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))
        made = _once(parts, lambda p: F.flatten(F.zip_with(p, totals(p), lambda own, before: F.transform(plain(own), lambda v: join(before, v)))))
        return F.when(F.size(x) > 0, made).otherwise(F.array().cast("array<bigint>"))

    return _once(values, parted)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans: the text between matches and the matches themselves give the offsets, by running sums."""
    pattern = F.lit(rule.pattern)
    lengths = lambda x: F.transform(x, F.length)
    sizes = F.zip_with(lengths(F.regexp_extract_all(text, pattern, F.lit(0))), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))), lambda m, p: F.struct(m.cast("long").alias("m"), p.alias("p")))

    def placed(found: Column) -> Column:
        gaps = F.slice(lengths(F.split(text, rule.pattern, -1)), F.lit(1), F.size(found))
        return _once(F.zip_with(found, gaps, lambda x, g: F.struct(g.cast("long").alias("g"), x["m"].alias("m"), x["p"].alias("p"))), offset)

    def offset(pieces: Column) -> Column:
        before = _running(F.transform(pieces, lambda x: x["g"] + x["m"]), lambda a, v: a + v)
        ends = F.zip_with(pieces, before, lambda x, b: F.struct((b + x["g"]).alias("start"), (b + x["g"] + x["m"]).alias("end"), x["p"].alias("p")))
        long = F.filter(ends, lambda x: x["p"] >= rule.least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind")))

    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), _once(sizes, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _cleared(text: Column, spans: Column) -> Column:
    """The text with its sorted spans replaced: each begins at or after the end of all before it, or is one with them.

    The text is taken in parts of PART characters, so a piece costs its own length and not its distance from the begin.
    """

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
        some = F.when(first == last, F.get(parts, first)).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
        return F.when(b > a, F.substring(some, (a % PART).cast("int") + 1, (b - a).cast("int"))).otherwise("")

    def joined(parts: Column, own: Column) -> Column:
        kept = F.filter(own, lambda x: x["s"]["start"] >= x["reach"])
        before = F.transform(kept, lambda x: F.concat(piece(parts, x["reach"], x["s"]["start"]), F.lit("["), x["s"]["kind"], F.lit("]")))
        return F.concat(F.array_join(before, ""), piece(parts, F.array_max(F.transform(own, lambda x: x["s"]["end"])), F.length(text)))

    reached = F.zip_with(spans, _running(F.transform(spans, lambda s: s["end"]), lambda a, v: F.greatest(a, v)), lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
    return _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: _once(reached, lambda own: joined(parts, own)))


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of every version."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows: the pairs of blob and rule version that the ledger lacks, each scanned once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    wanted = docs.select(F.xxhash64(F.col(path).cast("string"), body).alias("row"), F.sha2(body, 256).alias("blob"), body.alias("body"))
    blobs = wanted.groupBy("blob").agg(F.min("row").alias("row"))
    if ledger is not None:
        done = ledger.select("blob", "kind", "version").distinct().groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))  # at most one entry a rule version
        blobs = blobs.join(done, "blob", "left")
    else:
        blobs = blobs.withColumn("done", F.lit(None).cast("array<string>"))
    blobs = blobs.withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    keys = [f"{r.kind}:{r.version}" for r in rules]
    unseen = blobs.where(F.size(F.array_except(F.array(*map(F.lit, keys)), "done")) > 0)
    texts = wanted.select("row", "blob", "body").join(unseen, ["row", "blob"]).dropDuplicates(["row", "blob"])
    found = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(~F.array_contains("done", k), _spans(F.col("body"), r, i)).alias("spans")) for i, (r, k) in enumerate(zip(rules, keys, strict=True))])
    return texts.select("blob", F.explode(found).alias("f")).select("blob", "f.*").where("spans is not null")


def _hits(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans sorted by start, then rule) of the blobs with findings of the rules' current versions."""
    current = F.lit(False)
    for r in rules:
        current |= (F.col("kind") == r.kind) & (F.col("version") == r.version)
    of = lambda r: F.first(F.when(F.col("kind") == r.kind, F.col("spans")), ignorenulls=True)  # noqa: E731  equal rows count once
    hits = ledger.where(current & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.filter(F.array(*map(of, rules)), lambda x: x.isNotNull())).alias("spans"))
    return hits.select("blob", F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) of every version, from a ledger that has its blobs."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return versions.join(_hits(ledger, rules), "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret's span replaced by its kind in brackets, and ``n_chars`` to match.

    Spans that overlap are replaced as one, by the first one's kind; texts without secrets stay as they are. Columns may
    have any names: they travel in one struct.
    """
    text = F.col("own.text").cast("string")
    body = _cleared(text, F.col("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob"))
    found = F.col("spans").isNotNull()
    made = whole.join(_hits(ledger, rules), "blob", "left").select("own", F.when(found, body).alias("clean"))
    own = {"text": F.coalesce("clean", F.col("own.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("own.n_chars"))
    return made.select(*[own.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, None if nothing has been scanned into it."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends it there and gives the whole ledger.

    A run that is lost before its commit appends nothing and is scanned again; two runs at once may both append a blob, and
    equal rows of a blob count once.
    """
    spark = docs.sparkSession
    scan(docs, stored(spark, path), rules).write.mode("append").parquet(path)
    return stored(spark, path)
