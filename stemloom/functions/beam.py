"""Consensus folding of one alignment: a sweep over its columns, in which contributions to later states are sent ahead.

A state is a chart and two columns. Whatever adds to a state is an edge with a
score and up to two earlier states. Edges wait in the column where their state
ends; when the sweep comes there, they are reduced at once, by their maximum
(best structure) or the logarithm of their sum (partition function), the beam
is cut, and what follows from the states that stay is sent ahead, all states
of a column and all rows of the alignment in arrays.

The edges of the states that stay are kept; tracing back, sampling and outside
sums read them only. A state's value is the sum of all its edges; with ``floor``,
those below it (a logarithm of their share of the state) are not kept and the
others stand for them, so no mass is lost on the way back. ``None`` keeps all.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np

from stemloom.functions.conservation import Alignment, Pairable
from stemloom.functions.energies import BASE, FAR, TYPE, Energies
from stemloom.functions.loop_counts import Counts

KT = 61.63207755
SPAN = 30
HAIRPIN_COLUMNS = 4
#: Loops scored at once, times rows.
CELLS = 1 << 15
#: From so many rows on, rows that look alike in a loop are counted first.
MANY = 4096
SUPPORT = -9.91152


class Batch(NamedTuple):
    """States of one chart that end in one column, ascending by ``i``, with their edges."""

    chart: str
    j: int
    first: int  # number of the first state
    i: np.ndarray
    value: np.ndarray
    offset: np.ndarray  # where the edges of each state begin, and the end
    score: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n consecutive numbers from each first."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


class Columns(NamedTuple):
    """An alignment by (column, row), as loops look columns up."""

    code: np.ndarray
    count: np.ndarray
    before: np.ndarray
    after: np.ndarray


#: The charts of states, as counters name them.
CHARTS = ("C", "H", "M", "M2", "Multi", "P")


class Sweep:
    def __init__(self, a: Alignment, pairs: Pairable, energies: Energies, beam: int = 100, summed: bool = False, by_columns: bool = False, floor: float | None = -20.0) -> None:
        self.a, self.pairs, self.e, self.beam, self.summed, self.floor = a, pairs, energies, beam, summed, floor
        self.length = a.code.shape[1]
        self.unit = 1 / KT if summed else 1.0
        self.waiting: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = defaultdict(list)
        self.batches: list[Batch] = []
        self.states = 0
        self.seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # of each chart: states reached, kept, edges kept
        self.prefix = np.zeros(self.length)  # values of the chart C
        self.closed = np.full(self.length, -1)  # its states
        # unpaired columns of a multiloop up to a column: bases of the rows, or columns where those stand for them
        self.open = np.arange(self.length) * a.total if by_columns else a.filled
        self.columns = Columns(*(np.ascontiguousarray(x.T) for x in (a.code, a.count, BASE[a.before], BASE[a.after])))
        bases = np.arange(int(a.count.max(initial=0)) + 1)
        self.by_bases, self.by_skew = energies.by_size(energies.interior, bases), energies.skews(bases)
        self.counts = Counts(a, energies) if len(a.weight) >= MANY else None
        self.listed = self._listed()
        self._run()

    def _listed(self) -> dict[int, np.ndarray] | None:
        """Energies of the special hairpins, by loop size: at the base that opens the loop, FAR where it is none."""
        if not self.e.special:
            return None
        rows = ["".join("ACGUN"[c] for c in row if c != 5) for row in self.a.code]
        width = max(map(len, rows), default=0)
        out = {size: np.full((len(rows), width + 1), FAR) for size in (3, 4, 6)}
        for size, table in out.items():
            for r, text in enumerate(rows):
                for k in range(len(text) - size - 1):
                    table[r, k] = self.e.special.get(text[k : k + size + 2], FAR)
        return out

    # scores: sums over the rows of arrays (row, state)
    def _sum(self, energy: np.ndarray) -> np.ndarray:
        return -(self.a.weight @ energy) / self.a.total * self.unit

    def _hairpins(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a = self.a
        size = a.count[:, j - 1] - a.count[:, i]
        listed = None
        if self.listed is not None:
            start = np.maximum(a.count[:, i] - 1, 0)
            listed = np.full(size.shape, FAR)
            for n, table in self.listed.items():
                listed = np.where(size == n, np.take_along_axis(table, start, 1), listed)
        return self._sum(self.e.hairpins(size, TYPE[a.code[:, i], a.code[:, j]], BASE[a.after[:, i]], BASE[a.before[:, j]], listed))

    def _loops(self, i: np.ndarray, j: int, k: np.ndarray, p: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Loops between the outer pairs (p, q) numbered ``u`` and the inner pairs (i, j) numbered ``k``; what one pair decides is looked up once a pair."""
        if self.counts:
            return -self.counts.sums(p[u], i[k], np.full(len(k), j), q[u]) / self.a.total * self.unit
        e, count, weight, rows = self.e, self.columns.count, self.a.weight, len(self.a.weight)
        after, before, kind = self.columns.after, self.columns.before, lambda x, y: TYPE[self.columns.code[x], self.columns.code[y]]
        t2, sp, sq, until = kind(np.full(len(i), j), i), before[i], np.broadcast_to(after[j], (len(i), rows)), count[i - 1]
        inner, out = e.mismatch_interior[t2, sq, sp], np.zeros(len(k))
        inner_sum = inner @ weight
        block, step = max(1, 8 * CELLS // max(1, rows)), max(1, CELLS // max(1, rows))
        for first in range(0, len(p), block):
            x, y = p[first : first + block], q[first : first + block]
            t1, si, sj, since, right = kind(x, y), after[x], before[y], count[x], count[y - 1] - count[j]
            outer = e.mismatch_interior[t1, si, sj]
            outer_sum = outer @ weight
            mine = np.flatnonzero((u >= first) & (u < first + block)) if len(p) > block else np.arange(len(k))
            for lo in range(0, len(mine), step):
                edge = mine[lo : lo + step]
                v, w = u[edge] - first, k[edge]
                n1, n2 = until[w] - since[v], right[v]
                energy, mismatches = self.by_bases.take(n1 + n2) + self.by_skew.take(np.abs(n1 - n2)), outer_sum[v] + inner_sum[w]
                at, r = np.nonzero(np.minimum(n1, n2) <= e.tabled)
                v, w = v[at], w[at]
                energy[at, r] = e.loops(n1[at, r], n2[at, r], t1[v, r], t2[w, r], si[v, r], sj[v, r], sp[w, r], sq[w, r]) - outer[v, r] - inner[w, r]
                out[edge] = -(energy @ weight + mismatches) / self.a.total * self.unit
        return out

    def _stems(self, table: np.ndarray, i: np.ndarray, j: int) -> np.ndarray:
        a = self.a
        five = np.where(i > 0, BASE[a.before[:, i]] + 1, 0)
        three = BASE[a.after[:, j]] + 1 if j + 1 < self.length else np.zeros(len(a.weight), int)
        return self._sum(table[TYPE[a.code[:, i], a.code[:, j, None]], five, three[:, None]])

    def _closing(self, i: np.ndarray, j: int) -> np.ndarray:
        a = self.a
        return self._sum(self.e.inner_stem[TYPE[a.code[:, j, None], a.code[:, i]], BASE[a.before[:, j, None]] + 1, BASE[a.after[:, i]] + 1] + self.e.multi_closing)

    def _unpaired(self, columns: np.ndarray) -> np.ndarray:
        return -self.e.multi_base * columns / self.a.total * self.unit

    # edges
    def _send(self, chart: str, j: np.ndarray, i: np.ndarray, score: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> None:
        if not len(i):
            return
        none = np.full(len(i), -1)
        left, right = none if left is None else left, none if right is None else right
        if np.ndim(j) == 0:
            self.waiting[chart, int(j)].append((i, score, left, right))
            return
        order = np.argsort(j, kind="stable")
        j, i, score, left, right = j[order], i[order], score[order], left[order], right[order]
        cuts = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(j)), strict=True):
            self.waiting[chart, int(j[lo])].append((i[lo:hi], score[lo:hi], left[lo:hi], right[lo:hi]))

    def _take(self, chart: str, j: int) -> Batch:
        """The states of a chart that end in a column, cut to the beam."""
        parts = self.waiting.pop((chart, j), [])
        i, score, left, right = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        order = np.lexsort((-score, i))
        i, score, left, right = i[order], score[order], left[order], right[order]
        new = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        size = np.diff(np.append(new, len(i)))
        heads, value = i[new], score[new]
        if self.summed and len(i):
            value = value + np.log(np.add.reduceat(np.exp(score - np.repeat(value, size)), new))
        stay = np.ones(len(heads), bool)
        if self.beam > 0 and len(heads) > self.beam and chart != "C":
            rank = value + np.where(heads > 0, self.prefix[heads - 1], 0)
            stay = rank >= np.partition(rank, len(rank) - self.beam - 1)[len(rank) - self.beam - 1]
        edges = np.repeat(stay, size)
        if self.summed:
            if self.floor is not None:
                edges &= score >= np.repeat(value, size) + self.floor
        else:
            best = np.zeros(len(i), bool)
            best[new] = True
            edges &= best
        at = np.repeat(np.cumsum(stay) - 1, size)[edges]
        heads, value = heads[stay], value[stay]
        for n, more in enumerate((len(new), len(heads), int(edges.sum()))):
            self.seen[chart][n] += more
        batch = Batch(chart, j, self.states, heads, value, np.searchsorted(at, np.arange(len(heads) + 1)), score[edges], left[edges], right[edges])
        if chart != "H" and len(heads):
            self.batches.append(batch)
            self.states += len(heads)
        return batch

    def _run(self) -> None:
        a, e, last = self.a, self.e, self.length - 1
        inner: dict[int, Batch] = {}
        for j in range(self.length):
            self._open_hairpins(j)
            if j == 0:
                self._send("C", 0, np.zeros(1, int), np.zeros(1))
            else:
                m = self._take("Multi", j)
                ids = m.first + np.arange(len(m.i))
                self._send("P", j, m.i, m.value + self._closing(m.i, j) + self._kept(m.i, j), ids)
                q = self.pairs.following(m.i, np.full(len(m.i), j))
                go = (q >= 0) & (a.filled[q - 1] - a.filled[j - 1] <= SPAN * a.total)
                self._send("Multi", q[go], m.i[go], m.value[go] + self._unpaired(self.open[q[go] - 1] - self.open[j - 1]), ids[go])
                self._from_pairs(self._take("P", j), j, inner)
                two = self._take("M2", j)
                ids = two.first + np.arange(len(two.i))
                self._send("M", j, two.i, two.value, ids)
                p, k = self._outwards(two.i)
                q = self.pairs.following(p, np.full(len(p), j))
                p, k, q = p[q >= 0], k[q >= 0], q[q >= 0]
                self._send("Multi", q, p, two.value[k] + self._unpaired(self.open[two.i[k] - 1] - self.open[p] + self.open[q - 1] - self.open[j]), ids[k])
                inner[j] = many = self._take("M", j)
                if j < last:
                    self._send("M", j + 1, many.i, many.value + self._unpaired(self.open[j + 1] - self.open[j]), many.first + np.arange(len(many.i)))
            c = self._take("C", j)
            self.prefix[j], self.closed[j] = c.value[0], c.first
            if j < last:
                self._send("C", j + 1, np.zeros(1, int), c.value, np.array([c.first]))

    def _kept(self, i: np.ndarray, j: int | np.ndarray) -> np.ndarray:
        return self.pairs.of(i, j) * self.unit

    def _open_hairpins(self, j: int) -> None:
        a = self.a
        h = self._take("H", j)
        self._send("P", j, h.i, h.value + self._kept(h.i, j))
        i, q = h.i, self.pairs.following(h.i, np.full(len(h.i), j))
        enough = int(np.searchsorted(a.filled, a.filled[j] + HAIRPIN_COLUMNS // 2 * a.total))
        i, q = np.append(i, j), np.append(q, self.pairs.following(np.array([j]), np.array([max(j + HAIRPIN_COLUMNS - 1, enough - 1)])))
        i, q = i[q >= 0], q[q >= 0]
        self._send("H", q, i, self._hairpins(i, q))

    def _outwards(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All p < i with few bases between them, and the index of the i of each."""
        inside = np.where(i > 0, self.a.filled[i - 1], 0)
        lowest = np.searchsorted(self.a.filled, inside - SPAN * self.a.total, side="left")
        n = np.maximum(i - lowest, 0)
        k = np.repeat(np.arange(len(i)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lowest[k], k

    def _from_pairs(self, b: Batch, j: int, inner: dict[int, Batch]) -> None:
        a, e, last = self.a, self.e, self.length - 1
        if not len(b.i):
            return
        ids = b.first + np.arange(len(b.i))
        stem = self._stems(e.inner_stem, b.i, j)
        if j < last:
            p, k = self._outwards(b.i)
            left = a.filled[b.i[k] - 1] - a.filled[p]
            furthest = np.minimum(np.searchsorted(a.filled, a.filled[j] + SPAN * a.total - left, side="right"), last)
            lo, hi = self.pairs.after(p, np.full(len(p), j)), self.pairs.after(p, furthest)
            n = np.maximum(hi - lo, 0)
            at, k = _ranges(lo, n), np.repeat(k, n)
            # the pairs that any of them reaches, listed once
            opening, place = np.unique(p, return_inverse=True)
            begin, reach = np.zeros(len(opening), int), np.zeros(len(opening), int)
            begin[place] = lo
            np.maximum.at(reach, place, n)
            listed = self.pairs.key[_ranges(begin, reach)]
            u = at + np.repeat((np.cumsum(reach) - reach - begin)[place], n)
            outer_p, outer_q = listed // self.length, listed % self.length
            score = b.value[k] + self._loops(b.i, j, k, outer_p, outer_q, u) + self.pairs.score[at] * self.unit
            self._send("P", outer_q[u], outer_p[u], score, ids[k])
            some = b.i > 0
            self._send("M", j, b.i[some], (b.value + stem)[some], ids[some])
        for k, i in enumerate(b.i.tolist()):
            m = inner.get(i - 1) if i > 1 else None
            if m is not None:
                self._send("M2", j, m.i, m.value + b.value[k] + stem[k], m.first + np.arange(len(m.i)), np.full(len(m.i), ids[k]))
        outer = b.value + self._stems(e.exterior_stem, b.i, j)
        before = np.maximum(b.i - 1, 0)
        self._send("C", j, np.zeros(len(b.i), int), outer + np.where(b.i > 0, self.prefix[before], 0), np.where(b.i > 0, self.closed[before], -1), ids)

    # what the edges tell
    def _at(self, state: int) -> tuple[Batch, int]:
        b = self.batches[int(np.searchsorted(self._firsts(), state, side="right")) - 1]
        return b, state - b.first

    def _firsts(self) -> np.ndarray:
        if not hasattr(self, "_first"):
            self._first = np.array([b.first for b in self.batches])
        return self._first

    @property
    def total(self) -> float:
        return float(self.prefix[-1]) if self.length else 0.0

    def structure(self, draw: np.random.Generator | None = None) -> list[tuple[int, int]]:
        """The pairs of the best structure or, with a generator, of one drawn by its weight."""
        found, todo = [], [int(self.closed[-1])] if self.length else []
        while todo:
            b, k = self._at(todo.pop())
            if b.chart == "P":
                found.append((int(b.i[k]), b.j))
            lo, hi = b.offset[k], b.offset[k + 1]
            at = lo
            if draw is not None and hi - lo > 1:
                up_to = np.cumsum(np.exp(b.score[lo:hi] - b.value[k]))
                at = lo + min(int(np.searchsorted(up_to, draw.random() * up_to[-1], side="right")), hi - lo - 1)
            todo += [int(x[at]) for x in (b.left, b.right) if x[at] >= 0]
        return sorted(found)

    def probabilities(self, lazy: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, p) of all pairs with some support, by outside sums along the edges from the last to the first.

        With ``lazy``, states of little support are not visited and edges of little support not followed; a state's other
        edges take their mass, or its best edge if there are no others.
        """
        value = np.concatenate([b.value for b in self.batches]) if self.batches else np.zeros(0)
        outside = np.full(self.states, -np.inf)
        if self.length:
            outside[self.closed[-1]] = 0.0
        rows = []
        for b in reversed(self.batches):
            own, size = outside[b.first : b.first + len(b.i)], np.diff(b.offset)
            use = np.repeat(np.isfinite(own), size)
            if lazy:
                use &= np.repeat(own + b.value - self.total > SUPPORT, size)
                use &= (b.score > self.total + SUPPORT - np.repeat(own, size)) | (b.score == np.repeat(np.maximum.reduceat(b.score, b.offset[:-1]), size))
            kept = np.where(use, np.exp(b.score - np.repeat(b.value, size)), 0.0)
            share = np.add.reduceat(kept, b.offset[:-1])
            through = np.repeat(own, size) + b.score - np.log(np.where(share > 0, share, 1)).repeat(size)
            for side in (b.left, b.right):
                at = use & (side >= 0)
                np.logaddexp.at(outside, side[at], through[at] - value[side[at]])
            if b.chart == "P":
                log = b.value + own - self.total
                use = log > SUPPORT
                rows.append((b.i[use], np.full(use.sum(), b.j), np.minimum(1.0, np.exp(log[use]))))
        i, j, p = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((j, i))
        return i[order], j[order], p[order]
