"""Energies of loops summed over many rows of an alignment: rows that look alike in a loop are counted, and each look is scored once.

What a row shows in a loop is what it shows in two segments of columns: the bases at
their ends, the nearest bases inside, and how many bases lie between. A segment is
looked at once, whatever the number of loops that it is a side of. All sums are of
whole numbers, so they are those of the rows one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from stemloom.functions.conservation import Alignment
from stemloom.functions.energies import BASE, TYPE, Energies

#: Looks that are scored at once; bytes of the segments that are kept.
LOOKS, KEPT = 1 << 16, 256 << 20


class Segment(NamedTuple):
    """Columns x < y: which look each row has, and of each look the bases between, the codes at x and y, and the table bases after x and before y."""

    look: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray
    after: np.ndarray
    before: np.ndarray


class Counts:
    def __init__(self, a: Alignment, energies: Energies) -> None:
        self.code, self.count, self.after, self.before = (np.ascontiguousarray(x.T) for x in (a.code, a.count, BASE[a.after], BASE[a.before]))
        self.weight, self.e = a.weight, energies
        self.known: dict[tuple[int, int], Segment] = {}
        self.bytes = 0

    def segment(self, x: int, y: int) -> Segment:
        if (x, y) not in self.known:
            size = self.count[y - 1] - self.count[x]
            key = (((size * 6 + self.code[x]) * 6 + self.code[y]) * 5 + self.after[x]) * 5 + self.before[y]
            there = np.flatnonzero(np.bincount(key))
            place = np.zeros(int(there[-1]) + 1, np.uint16 if len(there) < 1 << 16 else np.int64)
            place[there] = np.arange(len(there))
            rest, before = np.divmod(there, 5)
            rest, after = np.divmod(rest, 5)
            rest, last = np.divmod(rest, 6)
            found = Segment(place[key], *np.divmod(rest, 6), last, after, before)
            if self.bytes > KEPT:
                self.known.clear()
                self.bytes = 0
            self.known[x, y] = found
            self.bytes += found.look.nbytes
        return self.known[x, y]

    def sums(self, p: np.ndarray, i: np.ndarray, j: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The summed energies of the loops between outer pairs (p, q) and inner pairs (i, j)."""
        out = np.zeros(len(p), np.int64)
        waiting: list[tuple[int, Segment, Segment, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for k, (x, y, u, v) in enumerate(zip(p.tolist(), i.tolist(), j.tolist(), q.tolist(), strict=True)):
            left, right = self.segment(x, y), self.segment(u, v)
            wide = len(right.size)
            if len(left.size) * wide <= 8 * len(self.weight):
                times = np.bincount(left.look.astype(np.int64) * wide + right.look, self.weight)
                looks = np.flatnonzero(times)
                waiting.append((k, left, right, *np.divmod(looks, wide), times[looks].astype(np.int64)))
            else:
                waiting.append((k, left, right, left.look, right.look, self.weight))
            size += len(waiting[-1][5])
            if size >= LOOKS:
                self._score(waiting, out)
                size = 0
        self._score(waiting, out)
        return out

    def _score(self, waiting: list, out: np.ndarray) -> None:
        if not waiting:
            return
        of: Callable[[int, int, str], np.ndarray] = lambda side, at, name: np.concatenate([getattr(w[side], name)[w[at]] for w in waiting])
        n1, cp, ci, si, sp = (of(1, 3, x) for x in ("size", "x", "y", "after", "before"))
        n2, cj, cq, sq, sj = (of(2, 4, x) for x in ("size", "x", "y", "after", "before"))
        energy = self.e.loops(n1, n2, TYPE[cp, cq], TYPE[cj, ci], si, sj, sp, sq) * np.concatenate([w[5] for w in waiting])
        ends = np.cumsum([len(w[5]) for w in waiting])
        out[[w[0] for w in waiting]] = np.add.reduceat(energy, np.append(0, ends[:-1]))
        waiting.clear()


__all__ = ["Counts", "Segment"]
