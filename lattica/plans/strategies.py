"""What makes a frequent pattern a result: nothing, its smallest edge, or its smallest vertex."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from lattica.operators import dense, index, match, support
from lattica.operators.pattern import Pattern, grow
from lattica.sources.graph import Graph


@dataclass(frozen=True)
class Measured:
    """Exact support, smallest edge of the best occurrence, smallest vertex of the best occurrence."""

    mni: int
    bottleneck: float | None
    vertex_bottleneck: float | None


class Strategy(Protocol):
    name: str

    def prepare(self, g: Graph, min_sup: int) -> None:
        """What the strategy needs of the graph."""

    def pruned(self, p: Pattern) -> str | None:
        """The counter of the filter that refuses a candidate before its support is known."""

    def accepted(self, p: Pattern, m: Measured) -> bool: ...

    def extended(self, p: Pattern, m: Measured) -> bool: ...


@dataclass
class Unweighted:
    name: str = "none"

    def prepare(self, g: Graph, min_sup: int) -> None:
        pass

    def pruned(self, p: Pattern) -> str | None:
        return None

    def accepted(self, p: Pattern, m: Measured) -> bool:
        return True

    def extended(self, p: Pattern, m: Measured) -> bool:
        return True


@dataclass
class EdgeBottleneck:
    """Patterns with an occurrence whose edges all weigh least or more.

    filter "edge" refuses a candidate that has an edge whose labels never reach the threshold. filter "lookup" refuses
    one with a two-edge part that isn't frequent, or whose parts' best weight is under the threshold. cut ends growth
    at patterns under the threshold; it is safe, since weights never rise with a further edge, and "lookup" always
    does it.
    """

    least: float
    filter: str = "lookup"
    cut: bool = True
    table: dict[str, float] = field(default_factory=dict, repr=False)
    best: dict[tuple[int, int, int], float] = field(default_factory=dict, repr=False)
    prepared: bool = False
    measured: dict[str, tuple] = field(default_factory=dict, repr=False)

    @property
    def name(self) -> str:
        return self.filter

    def prepare(self, g: Graph, min_sup: int) -> None:
        """The table of two-edge patterns doesn't depend on the threshold, so a sweep can share it."""
        if self.prepared:
            return
        if self.filter == "lookup":
            self.measured.clear()
            self.table = lookup_table(g, min_sup, self.measured)
        else:
            self.best = {(r["la"], r["lb"], r["el"]): r["max_w"] for r in index.triple_max_weight(g).collect()}

    def bound(self, p: Pattern) -> float | None:
        """Least of the best weights of a pattern's two-edge parts; None if one isn't frequent."""
        parts = [self.table.get(q.code) for q in p.two_edge_parts()]
        return None if None in parts else min(parts, default=float("inf"))

    def pruned(self, p: Pattern) -> str | None:
        if self.filter == "edge":
            return "pruned_by_strategy" if any(self.best.get(t, -float("inf")) < self.least for t in p.triples()) else None
        if self.filter == "lookup" and p.n_edges >= 2:
            bound = self.bound(p)
            return "pruned_by_structure" if bound is None else "pruned_by_weight" if bound < self.least else None
        return None

    def accepted(self, p: Pattern, m: Measured) -> bool:
        return m.bottleneck is not None and m.bottleneck >= self.least

    def extended(self, p: Pattern, m: Measured) -> bool:
        return self.accepted(p, m) if self.cut or self.filter == "lookup" else True


@dataclass
class VertexBottleneck:
    """Patterns with an occurrence whose vertices all weigh least or more."""

    least: float
    cut: bool = True
    name: str = "vertex"
    weighty: set[tuple[int, int, int]] = field(default_factory=set, repr=False)

    def prepare(self, g: Graph, min_sup: int) -> None:
        self.weighty = {tuple(r) for r in index.weighty_triples(g, self.least).collect()}

    def pruned(self, p: Pattern) -> str | None:
        return "pruned_by_strategy" if not p.triples() <= self.weighty else None

    def accepted(self, p: Pattern, m: Measured) -> bool:
        return m.vertex_bottleneck is not None and m.vertex_bottleneck >= self.least

    def extended(self, p: Pattern, m: Measured) -> bool:
        return self.accepted(p, m) if self.cut else True


def lookup_table(g: Graph, min_sup: int, measured: dict[str, tuple] | None = None) -> dict[str, float]:
    """code -> best weight of each frequent two-edge pattern; at most one entry per label combination. measured gets what is
    known of patterns by that, without vertex weights."""
    if dense.rows_to_list(g) > dense.SMALL:
        labels, triples = {r["label"] for r in index.frequent_labels(g, min_sup).collect()}, {tuple(r) for r in index.edge_triples(g).collect()}
        single = [Pattern.single_edge(*t) for t in sorted(triples) if {*t[:2]} <= labels]
        pairs = list({x.child.code: x.child for p in single for x in grow(p, labels, {t[2] for t in triples}, triples) if x.child.n_vertices == 3}.values())
        measures = match.Measures(g, labels, ends=False)
        found = measures.measure(dict(enumerate(pairs)), min_sup)
        measures.close()
        known = {p.code: found.get(k, (0, None, None)) for k, p in enumerate(pairs)}
        if measured is not None:
            measured.update(known)
        return {code: w for code, (n, w, _) in known.items() if n >= min_sup}
    return {Pattern.of([r["a"], r["b"], r["c"]], [(0, 1, r["e1"]), (1, 2, r["e2"])]).code: r["max_w"] for r in support.two_paths(g, min_sup).collect()}
