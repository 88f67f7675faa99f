"""Canonical forms of small labelled, directed graphs: colour refinement, then individualisation where colours stay equal."""

from __future__ import annotations


class _Search:
    """One graph's search. Colours are 0, 1, ... in an order that does not depend on how nodes are numbered."""

    def __init__(self, nodes: int, arcs: list[tuple[int, int, str]], labels: list[str]):
        self.n, self.arcs = nodes, arcs
        self.near: list[list[tuple[str, int]]] = [[] for _ in range(nodes)]
        for a, b, t in arcs:
            self.near[a].append((f">{t}", b))
            self.near[b].append((f"<{t}", a))
        self.best: tuple | None = None
        self.trace: list[tuple] = []
        self.order: list[int] = []
        self.path: list[int] = []  # the nodes that the best leaf was singled out by
        self.maps: list[list[int]] = []  # automorphisms met
        rank = {x: i for i, x in enumerate(sorted(set(labels)))}
        self.go(self.refine([rank[x] for x in labels]), [], [])

    def refine(self, colour: list[int]) -> list[int]:
        """Splits colours by the colours around until nothing more splits."""
        many = len(set(colour))
        while True:
            told = [(colour[v], sorted((how, colour[w]) for how, w in self.near[v])) for v in range(self.n)]
            ordered = sorted(range(self.n), key=lambda v: told[v])
            new, c = [0] * self.n, -1
            for i, v in enumerate(ordered):
                c += i == 0 or told[v] != told[ordered[i - 1]]
                new[v] = c
            if c + 1 == many:
                return new
            colour, many = new, c + 1

    def told(self, colour: list[int]) -> tuple:
        """What a refined colouring looks like, whatever the numbering: colours with their sizes and the colours around one of each."""
        of: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            of.setdefault(c, []).append(v)
        return tuple((len(of[c]), *sorted((how, colour[w]) for how, w in self.near[of[c][0]])) for c in sorted(of))

    def orbits(self, fixed: list[int]) -> list[int]:
        """The least node that each node can be mapped to by the automorphisms met that keep the fixed nodes."""
        root = list(range(self.n))

        def find(v: int) -> int:
            while root[v] != v:
                v = root[v]
            return v

        for m in self.maps:
            if all(m[v] == v for v in fixed):
                for v in range(self.n):
                    a, b = find(v), find(m[v])
                    root[max(a, b)] = min(a, b)
        return [find(v) for v in range(self.n)]

    def go(self, colour: list[int], fixed: list[int], trace: list[tuple]) -> int:
        """Keeps the leaf of least trace and code; branches of a larger trace, and nodes that an automorphism maps to one already tried, are left out. Returns the depth that the search goes on from: a leaf like the best one says that its whole branch is like the best one's, below the node where they part."""
        trace = [*trace, self.told(colour)]
        if self.best is not None and trace > self.trace[: len(trace)]:
            return len(fixed)
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            cells.setdefault(c, []).append(v)
        open_ = [c for c in sorted(cells) if len(cells[c]) > 1]
        if not open_:
            code = tuple(sorted((colour[a], colour[b], t) for a, b, t in self.arcs))
            order = sorted(range(self.n), key=lambda v: colour[v])
            if self.best is None or (trace, code) < (self.trace, self.best):
                self.best, self.trace, self.order, self.path = code, trace, order, fixed
            elif code == self.best and trace == self.trace:
                m = [0] * self.n
                for a, b in zip(self.order, order, strict=True):
                    m[a] = b
                self.maps.append(m)
                return next(i for i, (v, w) in enumerate(zip(fixed, self.path, strict=True)) if v != w)
            return len(fixed)
        cell = min(open_, key=lambda c: (len(cells[c]), c))
        tried: list[int] = []
        for v in cells[cell]:
            own = self.orbits(fixed)
            if any(own[v] == own[w] for w in tried):
                continue
            tried.append(v)
            back = self.go(self.refine([2 * c + (c == cell and w != v) for w, c in enumerate(colour)]), [*fixed, v], trace)
            if back < len(fixed):
                return back
        return len(fixed)


def canonical_code(nodes: int, arcs: list[tuple[int, int, str]], labels: list[str]) -> str:
    """A text that two graphs share if and only if they are isomorphic with labels, directions and types: sorted labels, then arcs between places in that order.

    For patterns, of some twenty nodes; refinement alone settles most, and symmetric graphs are cut down by their own
    automorphisms. A null label is an empty one; no nodes give "|".
    """
    labels = ["" if x is None else x for x in labels]
    if not nodes:
        return "|"
    found = _Search(nodes, sorted(set(arcs)), labels)
    return ",".join(labels[v] for v in found.order) + "|" + ";".join(f"{a}>{b}:{t}" for a, b, t in found.best)
