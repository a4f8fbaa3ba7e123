"""Which columns of an alignment may pair, and how well: a sparse, sorted list of column pairs with scores."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from stemloom.functions.energies import TYPE

#: Columns handled at once.
BLOCK = 256
_BASES = {1: "CG", 2: "GC", 3: "GU", 4: "UG", 5: "AU", 6: "UA"}


class Alignment(NamedTuple):
    """Distinct rows as codes (row, column), how often each occurs, and what follows from them."""

    code: np.ndarray
    weight: np.ndarray
    count: np.ndarray  # bases up to and with a column
    before: np.ndarray  # code of the nearest base to the left, 4 if none
    after: np.ndarray
    filled: np.ndarray  # weighted number of bases in columns up to and with this one
    total: int


def alignment(texts: list[str], weight: list[int]) -> Alignment:
    """Rows must have equal lengths. T counts as U, letters may be in either case, letters other than ACGU are bases of no kind."""
    if len({len(t) for t in texts}) > 1:
        raise ValueError("the rows of an alignment must have equal lengths")
    known = np.full(256, 4)
    for letters, code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("UuTt", 3), ("-", 5)):
        known[[ord(x) for x in letters]] = code
    length = len(texts[0]) if texts else 0
    code = known[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(len(texts), length)
    base = code != 5
    count = np.cumsum(base, 1)
    place = np.where(base, np.arange(length), -1)
    last = np.maximum.accumulate(place, 1)
    left = np.concatenate([np.full((len(texts), 1), -1), last[:, :-1]], 1) if length else place
    nearest = np.minimum.accumulate(np.where(base, np.arange(length), length)[:, ::-1], 1)[:, ::-1]
    right = np.concatenate([nearest[:, 1:], np.full((len(texts), 1), length)], 1) if length else place
    padded = np.concatenate([code, np.full((len(texts), 1), 4)], 1)
    w = np.array(weight, int)
    return Alignment(code, w, count, np.take_along_axis(padded, left, 1), np.take_along_axis(padded, right, 1), np.cumsum((base * w[:, None]).sum(0)), int(w.sum()))


def differing_bases() -> np.ndarray:
    """The plain substitution matrix: in how many bases two pair types differ."""
    out = np.zeros((7, 7))
    for k, x in _BASES.items():
        for m, y in _BASES.items():
            out[k, m] = (x[0] != y[0]) + (x[1] != y[1])
    return out


def _alike(low: float) -> bool:
    return 100 * low + 0.5 > 100.45


def least_share(code: np.ndarray, until_unlike: bool = False) -> float:
    """The least share of equal columns among two of distinct rows, 1 of fewer than two; with ``until_unlike``, any share that shows them not to be all alike.

    Two rows differ in no more columns than both together differ from the commonest codes. Rows are met from the furthest
    on, each with those that may still differ from it in more columns than the best pair so far.
    """
    n, length = code.shape
    if n < 2:
        return 1.0
    common = np.argmax(np.stack([(code == c).sum(0) for c in range(6)]), 0)
    far = (code != common).sum(1)
    order = np.argsort(-far, kind="stable")
    code, far = code[order], far[order]
    most = 0
    for k in range(n - 1):
        if far[k] + far[k + 1] <= most or until_unlike and not _alike((length - most) / max(1, length)):
            break
        end = int(np.searchsorted(-far, far[k] - most - 1, side="right"))
        most = max(most, int((code[k + 1 : end] != code[k]).sum(1).max(initial=0)))
    return (length - most) / max(1, length)


def greatest_share(code: np.ndarray) -> float:
    """The greatest share of equal columns among two rows; stops at rows that are equal, or differ in one column where none are equal."""
    n, length = code.shape
    code, times = np.unique(code, axis=0, return_counts=True)
    if (times > 1).any() or not length:
        return 1.0 if length else 0.0
    best = int((code[1:] == code[:-1]).sum(1).max(initial=0))
    for k in range(n - 1):
        if best == length - 1:
            break
        best = max(best, int((code[k + 1 :] == code[k]).sum(1).max()))
    return best / length


def identity_bins(code: np.ndarray, weight: np.ndarray) -> tuple[int, int] | None:
    """Bins of 5 % of the greatest and the least share of equal columns among two rows, which choose the substitution matrix; None if rows are too few or all equal."""
    if weight.sum() < 2:
        return None
    low = least_share(code)
    if _alike(low):
        return None
    high = 1.0 if (weight > 1).any() else greatest_share(code)
    top, bottom = max(12, int(100 * high + 0.5) // 5), max(5, int(100 * low + 0.5) // 5)
    return top, min(bottom, top - 1)


def substitution(a: Alignment, tables: dict[tuple[int, int], np.ndarray] | None) -> np.ndarray:
    """The table of the alignment's identity bins, with pair types as its two axes; without tables, the differing bases."""
    if tables is None:
        return np.zeros((7, 7)) if _alike(least_share(a.code, True)) else differing_bases()
    bins = identity_bins(a.code, a.weight)
    if bins is None:
        return np.zeros((7, 7))
    top, bottom = bins
    while (top, bottom) not in tables and bottom > 0:
        bottom -= 1
    if bottom == 0:
        raise KeyError(f"no substitution table for the bins {bins}")
    return np.asarray(tables[top, bottom], float)


class Pairable(NamedTuple):
    key: np.ndarray  # i * length + j, ascending
    score: np.ndarray
    length: int

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Index of the first pair (i, x) with x > j; it may belong to another i."""
        return np.searchsorted(self.key, i * self.length + j, side="right")

    def following(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least x > j that may pair with i, or -1."""
        at = self.after(i, j)
        found = np.append(self.key, -1)[at]
        return np.where((found >= 0) & (found // max(1, self.length) == i), found % max(1, self.length), -1)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of pairs that are listed."""
        return self.score[np.searchsorted(self.key, i * self.length + j)]


def pairable(a: Alignment, matrix: np.ndarray, cutoff: float = -40, beta: float = 1.2, delta: float = 0.1) -> Pairable:
    """Pairs i < j that at least half of the rows allow and whose conservation score reaches the cutoff."""
    length = a.code.shape[1]
    own = [(a.code == c) for c in range(6)]
    held = [(x * a.weight[:, None]).T.astype(float) for x in own]
    own = [x.astype(float) for x in own]
    sides = {int(TYPE[x, y]): (x, y) for x in range(4) for y in range(4) if TYPE[x, y] < 7}
    keys, scores = [], []
    for lo in range(0, length, BLOCK):
        hi = min(lo + BLOCK, length)
        f = {k: held[x][lo:hi] @ own[y] for k, (x, y) in sides.items()}
        gaps = held[5][lo:hi] @ own[5]
        other = a.total - gaps - sum(f.values())
        bonus = sum(f[k] * (f[k] - 1) / 2 * matrix[k, k] for k in f) + sum(f[k] * f[m] * matrix[k, m] for k in f for m in f if k < m)
        score = beta * (100 * bonus / a.total - 100 * delta * (other + 0.25 * gaps)) / a.total
        fit = (2 * other + gaps <= a.total) & (score >= cutoff) & (np.arange(length)[None, :] > np.arange(lo, hi)[:, None])
        i, j = np.nonzero(fit)
        keys.append((i + lo) * length + j)
        scores.append(score[i, j])
    return Pairable(np.concatenate(keys) if keys else np.zeros(0, int), np.concatenate(scores) if scores else np.zeros(0), length)
