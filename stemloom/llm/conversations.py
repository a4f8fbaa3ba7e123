"""Repair of conversations by signatures: each distinct sequence of roles and faults is solved once.

A conversation's rows, in order, become a string of one letter a row: its
signature. Letters are s, u, a for the initial of a role, o for any other, in
capitals where the text is cut off, and x for what must go (blank texts, and
repeats of an earlier role and text). The cheapest edits of a signature are
found once, by memoised recursion, joined back to all conversations that have
it, and replayed over their rows.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant turn 2; a cut-off text that stays costs 1 more. The roles that are left
are none, or a system turn or none and then pairs of user and assistant. Among
cheapest edits those whose initials come first in ASCII are taken.

Nothing holds a conversation: its rows are dealt over tasks by ranges of turns
and become segments of at most ``SEGMENT`` letters. A conversation of several
segments is joined by what it costs each of them to go from one state to
another; each segment is then solved for what follows it. The replay streams
sorted rows, so its memory is that of a segment; the digest of one conversation
is one sequence of bytes, and so one task's work.

Defined results: rows are ordered by turn, nulls first, rows of one turn by the
SHA-256 of role and text; a null role or text is one space; equal rows are
repeats; a null conv_id is a conversation; an empty table gives no rows; further
columns are ignored; texts and conversations are taken whole.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemloom.llm.store import cut

SEGMENT = 4096
SPACES = " \t\n\x0b\f\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's; what each wants next.
WANTED = ("user", "user", "assistant", "user")
AFTER = {"user": 2, "assistant": 3}
#: What is still to be inserted where a conversation ends in each state, and its cost.
TAIL = ((), ("user", "assistant"), ("assistant",), ())
INSERT, RENAME, DELETE, CUT_OFF = 2, 2, 3, 1
ENDS = tuple(INSERT * len(t) for t in TAIL)
NEVER = 1 << 50
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Repair:
    """The cheapest edits of one signature, from each state, where ``ends`` is the cost of what follows by the state it is left in."""

    def __init__(self, signature: str, ends: tuple[int, ...] = ENDS) -> None:
        self.signature, self.ends = signature, ends
        self.known: dict[tuple[int, int, int], tuple[int, str]] = {}
        for at in reversed(range(len(signature))):  # so that no recursion is deep
            for state in range(4):
                self.least(at, state)

    def step(self, edit: str, at: int, state: int, inserts: int) -> tuple[int, int, int, int] | None:
        """An edit's own cost, and the place, state and inserts left after it; None where it can't be made."""
        letter, wanted = self.signature[at], WANTED[state]
        held, more = letter.lower(), CUT_OFF * letter.isupper()
        if edit == "D":
            return DELETE, at + 1, state, 2
        if edit == "I":
            return (INSERT, at, AFTER[wanted], inserts - 1) if inserts else None  # a third brings back a state
        if held == "x":
            return None
        if edit == "R":
            return RENAME + more, at + 1, AFTER[wanted], 2
        if held == wanted[0]:
            return more, at + 1, AFTER[wanted], 2
        return (more, at + 1, 1, 2) if held == "s" and state == 0 else None

    def least(self, at: int, state: int, inserts: int = 2) -> tuple[int, str]:
        """The least cost from here on, and the first edit of it."""
        if at == len(self.signature):
            return self.ends[state], ""
        key = at, state, inserts
        if key not in self.known:
            made = [(e, self.step(e, at, state, inserts)) for e in "DIKR"]
            self.known[key] = min((s[0] + self.least(*s[1:])[0], e) for e, s in made if s)
        return self.known[key]

    def edits(self, state: int) -> tuple[str, int]:
        """Initials of the edits from a state, and the state after them."""
        at, inserts, out = 0, 2, []
        while at < len(self.signature):
            edit = self.least(at, state, inserts)[1]
            out.append(edit)
            _, at, state, inserts = self.step(edit, at, state, inserts)
        return "".join(out), state


def crossing(signature: str) -> list[list[int]]:
    """[state before][state after]: the least cost."""
    ways = [Repair(signature, tuple(0 if t == k else NEVER for t in range(4))) for k in range(4)]
    return [[min(NEVER, w.least(0, s)[0]) for w in ways] for s in range(4)]


def chained(crossings: list[list[list[int]]]) -> list[tuple[int, ...]]:
    """For each segment of a conversation, what follows it by the state it is left in, less the least of these."""
    ends, out = ENDS, []
    for c in reversed(crossings):
        out.append(tuple(e - min(ends) for e in ends))
        ends = tuple(min(c[s][t] + ends[t] for t in range(4)) for s in range(4))
    return out[::-1]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, role, text, their nulls replaced."""
    filled = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return filled.select("conv_id", "turn", digest.alias("digest"), "role", "text")


def _last(text: str) -> Column:
    """The last character that is no white space, empty if there is none."""
    return F.right(F.rtrim(F.col(text), F.lit(SPACES)), F.lit(1))


def _letters(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, letter, times: equal rows once, with the letter of the first of them."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(_last("text") == "", "x").when(_last("text").isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    own = turns.select("conv_id", "turn", "digest", letter.alias("letter")).groupBy("conv_id", "turn", "digest", "letter").agg(F.count("*").alias("times"))
    at = F.struct("turn")  # nulls come first
    repeated = own.groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_d")).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    met = own.join(repeated, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    return met.select("conv_id", "turn", "digest", F.when(at > F.col("_first"), "x").otherwise(F.col("letter")).alias("letter"), "times")


def segments(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, turn, digest, no, signature, parts: pieces of signatures, with the key of the row they begin in, and how many the conversation has."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    dealt = _letters(_turns(conversations)).repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    fields = f"conv_id {kind}, turn long, digest binary, no long, signature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, no, made = None, "", 0, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "digest", "no", "signature"])

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.binary(), pa.int64(), pa.string()]
            for conv, turn, digest, letter, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != first[0]:
                    made.append((*first, no, held))
                    held, no = "", 0
                while times:
                    if len(held) >= size:
                        made.append((*first, no, held))
                        held, no = "", no + 1
                        if len(made) >= 1000:
                            yield out()
                    if not held:
                        first = conv, turn, digest
                    more = min(times, size - len(held))
                    held += letter + "x" * (more - 1)
                    times, letter = times - more, "x"
            if made:
                yield out()
        if held:
            made.append((*first, no, held))
            yield out()

    return dealt.mapInArrow(run, fields).withColumn("parts", F.count("*").over(Window.partitionBy("conv_id")))


def _ends(ends: tuple[int, ...]) -> str:
    return ",".join(map(str, ends))


def _followed(several: DataFrame) -> DataFrame:
    """The segments of conversations of several, with ``ends``."""
    schema = several.select("conv_id", "turn", "digest", "no", "signature").schema

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(crossing(t), []) for t in texts], pa.list_(pa.int64()))], names=["signature", "costs"])

    def chain(t: pa.Table) -> pa.Table:
        turns = [(x is not None, x or 0) for x in t.column("turn").to_pylist()]
        order = sorted(zip(turns, t.column("digest").to_pylist(), t.column("no").to_pylist(), range(t.num_rows), strict=True))
        t = t.take(pa.array([k for *_, k in order]))
        found = [[c[4 * s : 4 * s + 4] for s in range(4)] for c in t.column("costs").to_pylist()]
        return t.drop_columns(["costs"]).append_column("ends", pa.array([_ends(e) for e in chained(found)], pa.string()))

    priced = several.select("signature").distinct().mapInArrow(costs, "signature string, costs array<long>")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return several.select(*schema.names).join(priced, "signature").select(*schema.names, "costs").groupBy("conv_id").applyInArrow(chain, f"{kinds}, ends string")


def pieces(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The segments of all conversations with their edits: for each state before them, the initials and the state after."""
    made = cut(segments(conversations, size))
    columns = ["conv_id", "turn", "digest", "no", "signature"]
    whole = made.where("parts = 1").select(*columns, F.lit(_ends(ENDS)).alias("ends"))
    jobs = whole.unionByName(_followed(made.where("parts > 1")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[r.edits(s) for s in range(4)] for r in (Repair(x, tuple(map(int, e.split(",")))) for x, e in zip(*(c.to_pylist() for c in batch.columns), strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[e for e, _ in f] for f in found], pa.list_(pa.string())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.int32()))], names=["signature", "ends", "edits", "leaves"])

    solved = jobs.select("signature", "ends").distinct().mapInArrow(solve, "signature string, ends string, edits array<string>, leaves array<int>")
    return jobs.join(solved, ["signature", "ends"]).select(*columns, "edits", "leaves")


class _Replay:
    """One conversation's rows and pieces as they stream by."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.state, self.cost, self.at = conv_id, 0, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = self.initial = None
        self.audit: list[str] = []
        self.waiting: deque[tuple[str, str]] = deque()  # signatures and edits still to be replayed
        self.letter = self.edit = 0  # places in the first of them
        self.hash = hashlib.sha256()

    def piece(self, signature: str, edits: list[str], leaves: list[int]) -> None:
        self.waiting.append((signature, edits[self.state]))
        self.audit.append(edits[self.state])
        self.state = leaves[self.state]

    def next_edit(self) -> tuple[str, str]:
        """The next edit, and the letter of its row."""
        if self.letter == len(self.waiting[0][0]):
            self.waiting.popleft()
            self.letter = self.edit = 0
        signature, edits = self.waiting[0]
        edit, letter = edits[self.edit], signature[self.letter]
        self.edit, self.letter = self.edit + 1, self.letter + (edit != "I")
        return edit, letter

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """The rows that a row becomes: turns put in before it, and itself unless it goes."""
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.last = turn if self.least is None else self.least, turn
        initial = role[:1]
        self.illegal += self.initial is not None and (self.initial, initial) not in LEGAL
        self.initial = initial
        while True:
            edit, letter = self.next_edit()
            if edit != "I":
                break
            yield self.put(None, self.next_role(), "", edit)
        blank = not text.strip(SPACES)
        self.blank += blank
        self.duplicate += letter == "x" and not blank
        self.truncated += letter.isupper()
        self.cost += DELETE if edit == "D" else RENAME * (edit == "R") + CUT_OFF * letter.isupper()
        if edit != "D":
            yield self.put(turn, self.next_role() if edit == "R" else role, text, edit)

    def next_role(self) -> str:
        """Of what is put out so far: the role that must follow."""
        return "assistant" if self.open else "user"

    open = False  # whether a user's turn is the last one put out

    def put(self, turn: int | None, role: str, text: str, edit: str) -> tuple:
        self.hash.update((b"\n" if self.at else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.at += 1
        self.cost += INSERT * (edit == "I")
        self.open = role[:1] == "u"
        return self.conv_id, self.at - 1, turn, role, text, edit

    def end(self) -> Iterator[tuple]:
        for role in TAIL[self.state]:
            self.audit.append("I")
            yield self.put(None, role, "", "I")

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


SUMMARY = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id {kind}, at long, turn long, role string, text string, edit string"


def _replayed(conversations: DataFrame, known: DataFrame | None, size: int, rows: bool) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType.simpleString()
    fields = (ROWS if rows else SUMMARY).format(kind=kind)
    own = _turns(conversations).withColumn("kind", F.lit(2))
    stream = own.unionByName(pieces(conversations, size).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if known is not None:
        stream = stream.unionByName(known.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    columns = ["conv_id", "kind", "turn", "role", "text", "signature", "edits", "leaves"]
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "kind", "no").select(*columns)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, kinds = None, [], []

        def out() -> pa.RecordBatch:
            data = list(zip(*made, strict=True)) if made else [[] for _ in names]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(data, kinds, strict=True)], names=names)

        def done() -> None:
            last = list(now.end())
            made.extend(last if rows else [now.summary()])

        for batch in batches:
            texts = {"string": pa.string(), "long": pa.int64()}
            kinds = [batch.schema.field("conv_id").type, *(texts[f.split()[1]] for f in fields.split(", ")[1:])]
            for conv, kind_, turn, role, text, signature, edits, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done()
                    now = _Replay(conv)
                if kind_ == 1:
                    now.piece(signature, edits, leaves)
                elif kind_ == 2:
                    found = list(now.row(turn, role, text))
                    if rows:
                        made.extend(found)
                if len(made) >= 1000:
                    yield out()
        if now is not None:
            done()
            yield out()

    return dealt.mapInArrow(run, fields)


def audited(conversations: DataFrame, known: DataFrame | None = None, size: int = SEGMENT) -> DataFrame:
    """A row for each conversation: its gaps, faults, illegal neighbours, the cost and the initials of its edits, and the digest of what they leave.

    ``known`` is a table of further conv_ids: those without rows are there too.
    """
    return _replayed(conversations, known, size, rows=False)


def repaired(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, at, turn, role, text, edit of the rows that are left and put in; ``at`` counts them from 0."""
    return _replayed(conversations, None, size, rows=True)
