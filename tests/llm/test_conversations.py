"""op12 against a plain version that tries all edits, conversations of many segments among them."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from stemloom.llm.conversations import Repair, audited, repaired
from stemloom.llm.queries_conversations import damaged, op12_conversation_repair

SPACES = " \t\n\x0b\f\r"
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plainly(rows):
    """gaps … digest of a conversation's (turn, role, text), by costs and texts of edits tried one after another."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at, state, inserts=0):
        """(cost, audit, repaired) from here on; state 1 follows a system turn."""
        found = [(0, "", ())] if at == len(rows) and state in (0, 3) else []

        def go(cost, edit, line, *then):
            c, a, r = best(*then)
            found.append((cost + c, edit + a, ((line,) if line is not None else ()) + r))

        if inserts < 3:
            go(2, "I", NEXT[state] + ":", at, 2 if NEXT[state] == "user" else 3, inserts + 1)
        if at < len(rows):
            _, role, text = rows[at]
            more = faults[at] == "truncated"
            go(3, "D", None, at + 1, state)
            if faults[at] not in ("blank", "duplicate"):
                go(2 + more, "R", f"{NEXT[state]}:{text}", at + 1, 2 if NEXT[state] == "user" else 3)
                if role[:1] == NEXT[state][0]:
                    go(more, "K", f"{role}:{text}", at + 1, 2 if NEXT[state] == "user" else 3)
                if role[:1] == "s" and state == 0:
                    go(more, "K", f"{role}:{text}", at + 1, 1)
        return min(found, default=(10**9, "", ()), key=lambda f: f[:2])

    for at in reversed(range(len(rows))):
        for state in range(4):
            best(at, state)
    cost, audit, lines = best(0, 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(initials))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
        out[conv] += [] if d == 0 else [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u", None]
    texts = ["Yes.", "No", " \t", "", "Why?\n", "é!", "cut off", None, "same.", "\x0b.\x0c"]
    rows = []
    for c in range(conversations):
        for k in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([k, k, k, k + 1, None, 2 * k]), rng.choice(roles), rng.choice([*texts, f"{k} well.", f"{k} well", f"{k}!"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_random_conversations(spark, size):
    rows = some_rows(3, 150, 14) + [(None, 1, "user", "x."), (None, 2, "assistant", "y.")]
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    found = {r[0]: tuple(r[1:]) for r in audited(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size).collect()}
    assert found == {c: plainly(r) for c, r in by.items()}


def test_long_conversation_of_equal_rows(spark):
    rows = [(1, k, "user", "again.") for k in range(700)] + [(1, 5, "assistant", "same.")] * 900 + [(2, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(2000)]
    found = {r[0]: tuple(r[1:]) for r in audited(spark.createDataFrame(rows, SCHEMA), size=64).collect()}
    assert found[1] == plainly([r[1:] for r in rows if r[0] == 1])
    assert found[2] == plainly([r[1:] for r in rows if r[0] == 2])
    assert found[2][5:7] == (0, "K" * 2000)


def test_damage_and_conversations_without_rows(spark, tmp_path):
    rows = some_rows(8, 120, 9) + [(10_000 + k, 0, "user", "only one.") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: plainly(r) for c, r in harmed(rows).items()}
    assert found == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found.values()


def test_repaired_rows_give_the_digest(spark):
    rows = some_rows(21, 80, 10)
    conversations = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "'z' as kind", "text as edit")
    lines = {}
    for r in repaired(conversations, size=4).orderBy("conv_id", "at").collect():
        assert r.at == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in audited(conversations).collect():
        left = lines.get(r.conv_id, [])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest()
        roles = "".join(x[0] for x in left)
        assert not roles or (roles.removeprefix("s") == "ua" * (len(roles) // 2) and len(roles) > 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not audited(empty).count() and not repaired(empty).count() and not damaged(empty).count()


def test_ties_take_the_least_initials():
    assert Repair("u").edits(0) == ("K", 2)
    assert Repair("uu").edits(0) == ("KR", 3)
    assert Repair("au").edits(0) == ("IKK", 2)  # an assistant's turn follows: 4, as RR
    assert Repair("x").edits(0) == ("D", 0)
    assert Repair("a" * 9000).edits(0)[1] == 3
