"""Small connected patterns: the part of mining that lives on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import permutations


@dataclass(frozen=True)
class Pattern:
    """Vertex labels by position, and edges (u, v, label) with u < v in order. Any whole numbers are labels."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(labels: Iterable[int], edges: Iterable[tuple[int, int, int]]) -> Pattern:
        """A pair given twice keeps its last label."""
        by_pair = {(min(u, v), max(u, v)): el for u, v, el in edges}
        return Pattern(tuple(labels), tuple(sorted((u, v, el) for (u, v), el in by_pair.items())))

    @staticmethod
    def single_edge(la: int, lb: int, el: int = 0) -> Pattern:
        return Pattern((la, lb), ((0, 1, el),))

    @cached_property
    def links(self) -> tuple[dict[int, int], ...]:
        """For each position its neighbours and the labels of the edges to them."""
        out: tuple[dict[int, int], ...] = tuple({} for _ in self.labels)
        for u, v, el in self.edges:
            out[u][v] = out[v][u] = el
        return out

    @property
    def n_vertices(self) -> int:
        return len(self.labels)

    @property
    def n_edges(self) -> int:
        return len(self.edges)

    def edge_label(self, u: int, v: int) -> int | None:
        return self.links[u].get(v)

    def has_edge(self, u: int, v: int) -> bool:
        return v in self.links[u]

    def degree(self, u: int) -> int:
        return len(self.links[u])

    def neighbours(self, u: int) -> list[int]:
        return sorted(self.links[u])

    def with_leaf(self, u: int, label: int, el: int = 0) -> Pattern:
        return Pattern((*self.labels, label), (*self.edges, (u, len(self.labels), el))).sorted()

    def with_chord(self, u: int, v: int, el: int = 0) -> Pattern:
        return Pattern.of(self.labels, (*self.edges, (u, v, el)))

    def sorted(self) -> Pattern:
        return Pattern(self.labels, tuple(sorted(self.edges)))

    def triples(self) -> set[tuple[int, int, int]]:
        """(smaller label, larger label, edge label) of each edge."""
        return {(*sorted((self.labels[u], self.labels[v])), el) for u, v, el in self.edges}

    def restricted(self, edges: Iterable[tuple[int, int, int]]) -> Pattern | None:
        """The pattern of these edges without isolated positions, or None if they aren't connected."""
        edges = list(edges)
        used = sorted({x for u, v, _ in edges for x in (u, v)})
        reached, growing = set(used[:1]), True
        while growing:
            growing = False
            for u, v, _ in edges:
                if (u in reached) != (v in reached):
                    reached |= {u, v}
                    growing = True
        if not edges or len(reached) < len(used):
            return None
        at = {x: k for k, x in enumerate(used)}
        return Pattern(tuple(self.labels[x] for x in used), tuple(sorted((at[u], at[v], el) for u, v, el in edges)))

    def smaller(self) -> list[Pattern]:
        """Connected patterns with one edge less; an end left alone goes with its edge."""
        found = (self.restricted(e for e in self.edges if e != gone) for gone in self.edges)
        return [p for p in found if p is not None]

    def two_edge_parts(self) -> list[Pattern]:
        """The pairs of edges that share a position."""
        out = []
        for k, a in enumerate(self.edges):
            for b in self.edges[k + 1 :]:
                if {a[0], a[1]} & {b[0], b[1]}:
                    out.append(self.restricted((a, b)))
        return out

    def to_text(self) -> str:
        """v and e lines, as in the text graph format."""
        return "".join([f"v {i} {x}\n" for i, x in enumerate(self.labels)] + [f"e {u} {v} {el}\n" for u, v, el in self.edges])

    @cached_property
    def code(self) -> str:
        return canonical_code(self)


def _refine(p: Pattern, colour: list[int]) -> list[int]:
    """Split colours by the colours and labels around, until stable; the numbering depends on structure alone."""
    while True:
        seen = [(colour[u], tuple(sorted((el, colour[v]) for v, el in p.links[u].items()))) for u in range(p.n_vertices)]
        rank = {s: k for k, s in enumerate(sorted(set(seen)))}
        finer = [rank[s] for s in seen]
        if len(rank) == len(set(colour)):
            return finer
        colour = finer


def _twins(p: Pattern, u: int, v: int) -> bool:
    """Exchanging u and v maps the pattern to itself."""
    a, b = dict(p.links[u]), dict(p.links[v])
    a.pop(v, None)
    b.pop(u, None)
    return p.labels[u] == p.labels[v] and a == b


def _orders(p: Pattern, colour: list[int]) -> Iterator[list[int]]:
    """Position orders that structure allows: refine, single out a member of the first tied class, and go on. Of
    members that are twins one is enough, since exchanging them changes nothing."""
    colour = _refine(p, colour)
    classes: dict[int, list[int]] = {}
    for u, c in enumerate(colour):
        classes.setdefault(c, []).append(u)
    tied = next((members for _, members in sorted(classes.items()) if len(members) > 1), None)
    if tied is None:
        yield sorted(range(p.n_vertices), key=colour.__getitem__)
        return
    tried: list[int] = []
    for u in tied:
        if any(_twins(p, u, v) for v in tried):
            continue
        tried.append(u)
        yield from _orders(p, [2 * c - (x == u) for x, c in enumerate(colour)])


def _written(p: Pattern, order: list[int]) -> tuple:
    at = {x: k for k, x in enumerate(order)}
    return tuple(p.labels[x] for x in order), tuple(sorted((min(at[u], at[v]), max(at[u], at[v]), el) for u, v, el in p.edges))


def canonical_code(p: Pattern) -> str:
    """Equal for two patterns if and only if they are isomorphic: the least way to write the pattern, over all orders
    that refinement leaves open. No assumption is made on what refinement can tell apart."""
    ranks = {x: k for k, x in enumerate(sorted(set(p.labels)))}
    labels, edges = min(_written(p, o) for o in _orders(p, [ranks[x] for x in p.labels]))
    return " ".join(map(str, labels)) + "|" + ";".join(f"{u} {v} {el}" for u, v, el in edges)


def canonical_order(p: Pattern) -> list[int]:
    """The positions in the order in which the least way writes them."""
    ranks = {x: k for k, x in enumerate(sorted(set(p.labels)))}
    return min(_orders(p, [ranks[x] for x in p.labels]), key=lambda o: _written(p, o))


def brute_force_code(p: Pattern) -> str:
    """The same partition into classes by trying every order; for checks on small patterns."""
    labels, edges = min(_written(p, list(o)) for o in permutations(range(p.n_vertices)))
    return " ".join(map(str, labels)) + "|" + ";".join(f"{u} {v} {el}" for u, v, el in edges)


@dataclass(frozen=True)
class Growth:
    """How a child comes from its parent: a leaf at u (then w is the new position), or a chord from u to w."""

    child: Pattern
    kind: str
    u: int
    w: int
    label: int
    el: int


def grow(p: Pattern, labels: Iterable[int], edge_labels: Iterable[int], triples: set[tuple[int, int, int]]) -> Iterator[Growth]:
    """All patterns with one edge more whose new edge's triple is present in the graph. Positions are kept."""
    labels, edge_labels = sorted(labels), sorted(edge_labels)
    n = p.n_vertices
    for u in range(n):
        for lb in labels:
            for el in edge_labels:
                if (*sorted((p.labels[u], lb)), el) in triples:
                    yield Growth(p.with_leaf(u, lb, el), "leaf", u, n, lb, el)
        for w in range(u + 1, n):
            if not p.has_edge(u, w):
                for el in edge_labels:
                    if (*sorted((p.labels[u], p.labels[w])), el) in triples:
                        yield Growth(p.with_chord(u, w, el), "chord", u, w, p.labels[w], el)
