"""Structures as pairs and as bracket strings: nested structures of greatest weight, mutual-best pairs, parsing, comparison."""

from __future__ import annotations

import math

import numpy as np

from stemloom.functions.matching import greatest_matching

KINDS = ("()", "[]", "{}", "<>")
#: Columns between the ends of a pair, at least; weights of pairs among which the one of best correlation is taken.
TURN = 3
GAMMAS = (1024, 512, 256, 128, 64, 32, 16, 8, 6, 4, 2)
CANONICAL = {"AU", "UA", "CG", "GC", "GU", "UG"}


def brackets(length: int, pairs, kinds=None) -> str:
    out = ["."] * length
    for k, (i, j) in enumerate(pairs):
        out[i], out[j] = KINDS[kinds[k] if kinds is not None else 0]
    return "".join(out)


def parsed(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of each kind of bracket, in the order in which they close, and the columns with a dot."""
    open_at: dict[str, list[int]] = {k: [] for k in KINDS}
    pairs, free = [], []
    for at, c in enumerate(text):
        for kind in KINDS:
            if c == kind[0]:
                open_at[kind].append(at)
            elif c == kind[1]:
                if not open_at[kind]:
                    raise ValueError(f"nothing open at {at}")
                pairs.append((open_at[kind].pop(), at))
        if c == ".":
            free.append(at)
    if any(open_at.values()):
        raise ValueError("a bracket stays open")
    return pairs, free


def best_nested(length: int, i: np.ndarray, j: np.ndarray, gain: np.ndarray) -> list[int]:
    """Indices of the nested pairs of greatest total gain.

    Row i holds the best total from i to any column; columns that open no pair share the next one's row.
    """
    order = [k for k in np.lexsort((j, i)) if gain[k] > 0]
    partners: dict[int, list[int]] = {}
    for k in order:
        partners.setdefault(int(i[k]), []).append(int(k))
    rows, which = [np.zeros(length + 1)], np.zeros(length + 2, int)  # row[x + 1] is the total up to column x
    for at in range(length - 1, -1, -1):
        which[at] = which[at + 1]
        if at in partners:
            below = rows[which[at + 1]]
            row = below.copy()
            for k in partners[at]:
                end = int(j[k])
                rest = rows[which[end + 1]]
                row[end + 1 :] = np.maximum(row[end + 1 :], gain[k] + below[end] + rest[end + 1 :])
            rows.append(row)
            which[at] = len(rows) - 1
    found, todo = [], [(0, length - 1)]
    while todo:
        a, b = todo.pop()
        while a < b and rows[which[a]][b + 1] == rows[which[a + 1]][b + 1]:
            a += 1
        if a >= b:
            continue
        whole = rows[which[a]][b + 1]
        for k in partners[a]:
            end = int(j[k])
            if end <= b and gain[k] + rows[which[a + 1]][end] + rows[which[end + 1]][b + 1] == whole:
                found.append(k)
                todo += [(a + 1, end - 1), (end + 1, b)]
                break
    return found


def centroid(length: int, i: np.ndarray, j: np.ndarray, p: np.ndarray, gamma: float) -> list[int]:
    return best_nested(length, i, j, np.where((p > 1 / (gamma + 1)) & (j > i + TURN), (gamma + 1) * p - 1, 0))


def best_gamma(length: int, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> tuple[float, float, list[int]]:
    """(gamma, correlation, pairs) of the centroid whose expected correlation is greatest, ties to the larger gamma; (0, 0, none) if none is over 0."""
    found: tuple[float, float, list[int]] = (0.0, 0.0, [])
    left = p.copy()
    mass = float(p[j > i + TURN].sum())
    for gamma in GAMMAS:
        pairs = centroid(length, i, j, left, gamma)
        hit = float(p[pairs].sum())
        extra, missed = len(pairs) - hit, mass - hit
        rest = length * ((length - 1) // 2) - len(pairs) - mass + hit
        square = (hit + extra) * (hit + missed) * (rest + extra) * (rest + missed)
        score = (hit * rest - extra * missed) / math.sqrt(square) if square > 0 else 0.0
        if score > found[1]:
            found = (float(gamma), score, pairs)
    return found


def greatest_accuracy(length: int, i: np.ndarray, j: np.ndarray, p: np.ndarray, gamma: float, least: float) -> list[int]:
    """Nested pairs of greatest expected accuracy among those with a probability over ``least``; a pair counts 2 gamma times, against its columns unpaired."""
    p = np.where((p > least) & (j > i + TURN), p, 0)
    free = 1 - np.bincount(i, p, minlength=length)[:length] - np.bincount(j, p, minlength=length)[:length]
    return best_nested(length, i, j, np.where(p > 0, 2 * gamma * p - free[i] - free[j], 0))


def mutual_best(i: np.ndarray, j: np.ndarray, p: np.ndarray, least: float = 0.3) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of at least a probability that are the best of both their columns, and the bracket kind of each.

    A pair that crosses an earlier one of a kind goes to the next kind; ties go to the pair that comes first.
    """
    use = np.flatnonzero((p >= least) & (j > i + TURN))
    best: dict[int, float] = {}
    for k in use:
        for end in (int(i[k]), int(j[k])):
            best[end] = max(best.get(end, 0.0), p[k])
    pairs, taken = [], set()
    for k in use[np.lexsort((j[use], i[use]))]:
        x, y = int(i[k]), int(j[k])
        if p[k] == best[x] == best[y] and not {x, y} & taken:
            pairs.append((x, y))
            taken |= {x, y}
    return pairs, layers(pairs)


def layers(pairs: list[tuple[int, int]], kinds: int = len(KINDS)) -> list[int]:
    """The bracket kind of each pair, in order of i: pairs that an earlier one of a kind crosses go on to the next kind, up to the last."""
    kind = dict.fromkeys(pairs, 0)
    level = pairs
    for n in range(1, kinds):
        crossed, open_ends = [], []
        for b in level:  # of earlier pairs, those that end after b begins can cross it
            open_ends = [end for end in open_ends if end > b[0]]
            if any(end < b[1] for end in open_ends):
                crossed.append(b)
            open_ends.append(b[1])
        level = crossed
        kind |= dict.fromkeys(level, n)
    return [kind[x] for x in pairs]


def projected(structure: str, row: str) -> str:
    """The structure of an alignment on one of its rows, without gaps; pairs that the row's bases can't form are left out."""
    row = row.upper().replace("T", "U")
    keep = [at for at, c in enumerate(row) if c != "-"]
    out = {at: "." for at in keep}
    for i, j in parsed(structure)[0]:
        if row[i] + row[j] in CANONICAL:
            out[i], out[j] = structure[i], structure[j]
    return "".join(out[at] for at in keep)


def matching(predicted: list[tuple[int, int]], gold: list[tuple[int, int]], slip: bool = True) -> dict[tuple[int, int], tuple[int, int]]:
    """A greatest matching of predicted pairs to gold pairs of their own; with slip, one end may be off by one."""
    known = set(gold)
    moves = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)] if slip else [(0, 0)]
    return greatest_matching(((i, j), (i + a, j + b)) for i, j in predicted for a, b in moves if (i + a, j + b) in known)


def scores(length: int, gold: tuple[list, list], predicted: tuple[list, list], slip: bool = False, hidden: set[int] | None = None) -> tuple[float, float, float, int]:
    """Precision, sensitivity, F1 and distance of structures as (pairs, free columns).

    The distance is the length less twice the hits and less the columns free in both. With slip, a hit stands where its gold
    pair is, so a column is free there if it is in no hit's gold pair and in no predicted pair that is no hit; ``hidden``
    columns are never free.
    """
    (a, free_a), (b, free_b) = gold, predicted
    match = matching(b, a, slip)
    hit = len(match)
    if slip:
        used = {x for pair in b for x in match.get(pair, pair)} | (hidden or set())
        free_b = [k for k in range(length) if k not in used]
    precision, sensitivity = hit / (len(b) + 1e-10), hit / (len(a) + 1e-10)
    f1 = 2 * precision * sensitivity / (precision + sensitivity + 1e-10)
    return precision, sensitivity, f1, length - 2 * hit - len(set(free_a) & set(free_b))


def compared(gold: str, predicted: str, slip: bool = False) -> tuple[float, float, float, int]:
    """``scores`` of two bracket strings of equal length; * in the predicted one is neither free nor paired."""
    if len(gold) != len(predicted):
        raise ValueError("the structures must have equal lengths")
    return scores(len(gold), parsed(gold), parsed(predicted), slip, {k for k, c in enumerate(predicted) if c == "*"})
