"""Greatest matchings of bipartite graphs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from typing import TypeVar

A, B = TypeVar("A"), TypeVar("B")


def greatest_matching(edges: Iterable[tuple[A, B]]) -> dict[A, B]:
    """From left to right, in phases: a breadth-first layering from all free lefts, then disjoint shortest augmenting paths through it. The order of the edges decides between equals."""
    near: dict[A, list[B]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    left: dict[A, B] = {}
    right: dict[B, A] = {}
    while True:
        layer = {a: 0 for a in near if a not in left}
        todo, reached = deque(layer), False
        while todo:
            a = todo.popleft()
            for b in near[a]:
                if b not in right:
                    reached = True
                elif right[b] not in layer:
                    layer[right[b]] = layer[a] + 1
                    todo.append(right[b])
        if not reached:
            return left
        rest = {a: iter(near[a]) for a in layer}
        for start in [a for a in near if a not in left]:
            path: list[tuple[A, B]] = []
            at = start
            while True:
                step = next((b for b in rest[at] if b not in right or layer.get(right[b]) == layer[at] + 1), None)
                if step is None and not path:
                    break
                if step is None:
                    at = path.pop()[0]
                    continue
                path.append((at, step))
                if step not in right:
                    for a, b in path:
                        left[a], right[b] = b, a
                    break
                at = right[step]
