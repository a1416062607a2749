"""Shapes of dense graphs whose occurrences are far more than vertices: supports from tiles of pairs, weights from heavy parts.

What has an occurrence in a part of the graph has one in the whole, and a vertex is no image where it has fewer neighbours
of a label than the position; where both bounds of a support meet, no more than a small part was looked at.

Two vertices' common neighbours of a label say whether the pair closes a triangle or a 4-cycle. They are counted for all
pairs of two blocks of vertices in one task, so that no row per two-path is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.derive import TILE, pairs_sharing
from lattica.sources.graph import Graph

#: Rows of the adjacency that are listed without thought, and labels up to which tiles keep a matrix for each.
SMALL, LABELS = 200_000, 32
#: Rows of the first heavy part, as a share of SMALL.
FIRST = 0.08
#: Neighbours of each label that a vertex has at least in the part in which images are looked for first.
NEAR = 4
#: Rings of labels up to which 4-cycles are bounded before they are looked for in tiles.
RINGS = 10_000


def worth_tiles(g: Graph) -> bool:
    """Whether two-paths are more than pairs of vertices, in a graph of one edge label that isn't small."""
    return g.shared("worth tiles", lambda: _worth_tiles(g))


def _worth_tiles(g: Graph) -> bool:
    degree = g.adj.groupBy("src", "ls", "el").agg(F.count("*").alias("n"))
    x = degree.agg(F.sum("n").alias("rows"), F.count_distinct("src").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("paths"), F.count_distinct("ls").alias("labels"), F.count_distinct("el").alias("els")).first()
    return bool(x["rows"]) and x["rows"] > SMALL and x["els"] == 1 and x["labels"] <= LABELS and x["paths"] > x["n"] ** 2


def rows_to_list(g: Graph) -> int:
    """Rows of the adjacency that occurrences start from: those between the first of each class of twins."""
    return g.shared("rows to list", lambda: _rows_to_list(g))


def _rows_to_list(g: Graph) -> int:
    rows = g.adj.select("src", "dst")
    if g.twins is not None:
        later = g.twins.members().where("v <> first").select("v")
        rows = rows.join(later.toDF("src"), "src", "left_anti").join(later.toDF("dst"), "dst", "left_anti")
    return rows.count()


def tiles(g: Graph, found: Callable, schema: str) -> DataFrame:
    """found(x, y, same) of all pairs of blocks of vertices: sides are Arrow tables (v, label, near), near a list of (ld, dst);
    it gives rows of the schema. What is shuffled is each vertex's neighbours, once for each block."""
    n = g.adj.select("src").distinct().count()
    blocks = max(1, -(-n // TILE))
    lists = g.adj.groupBy(F.col("src").alias("v"), F.col("ls").alias("label")).agg(F.collect_list(F.struct("ld", "dst")).alias("near"))
    own = lists.withColumn("own", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = own.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "label", "near")

    def each(held):
        import pyarrow as pa

        lo, hi = held.column("lo")[0].as_py(), held.column("hi")[0].as_py()
        x, y = (held.filter(pa.array(held.column("own").to_numpy() == k)) for k in (lo, hi))
        rows = found(Side(x), Side(y), lo == hi) if len(x) and len(y) else columns([], " ".join(f.split()[0] for f in schema.split(",")))
        return pa.table(rows)

    return dealt.groupBy("lo", "hi").applyInArrow(each, schema)


class Side:
    """A block's vertices, sorted by label, with memberships (neighbour, place) of each label of neighbours."""

    def __init__(self, t):
        order = np.lexsort((t.column("v").to_numpy(), t.column("label").to_numpy()))
        t = t.take(order)
        self.v, self.label = t.column("v").to_numpy(), t.column("label").to_numpy()
        near = t.column("near").combine_chunks()
        owner = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        entries = near.flatten()
        self.ld, dst = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("ld", "dst"))
        by = np.argsort(dst, kind="stable")
        self.ld, self.dst, self.owner = self.ld[by], dst[by], owner[by]
        #: Where each label's vertices begin.
        self.labels, self.begins = np.unique(self.label, return_index=True)

    def near(self, label: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.ld == label
        return self.dst[own], self.owner[own]


def common(x: Side, y: Side, same: bool, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the pairs that have one common neighbour of the label at least, and two."""
    (i, j), n = pairs_sharing(x.near(label), y.near(label), len(x.v), len(y.v), 1, same)
    one, two = np.zeros((len(x.v), len(y.v)), bool), np.zeros((len(x.v), len(y.v)), bool)
    one[i, j], two[i, j] = True, n > 1
    if same:
        one[j, i], two[j, i] = True, n > 1
    return one, two


def reached(hit: np.ndarray, x: Side, y: Side) -> Iterator[tuple[np.ndarray, int]]:
    """For each label of y the vertices of x that have a hit among its vertices."""
    if hit.size:
        for k, any_ in enumerate(np.logical_or.reduceat(hit, y.begins, axis=1).T):
            if any_.any():
                yield x.v[any_], int(y.labels[k])


def columns(rows: list[tuple], names: str) -> dict:
    """Arrow columns of rows (vertices, number, ...)."""
    size = [len(r[0]) for r in rows]
    whole = [np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)]
    return dict(zip(names.split(), whole + [np.repeat(np.array([r[k] for r in rows], np.int32), size) for k in range(1, len(names.split()))]))


def cycle_corners(g: Graph) -> DataFrame:
    """(v, lo, l1, l3), l1 <= l3: vertices with an opposite one of label lo to which middles of labels l1 and l3 lead."""

    def found(x: Side, y: Side, same: bool) -> dict:
        rows, labels = [], np.intersect1d(np.unique(x.ld), np.unique(y.ld))
        held = {int(k): common(x, y, same, k) for k in labels}
        for l1, (one, two) in held.items():
            for l3 in held:
                if l1 <= l3:
                    hit = two if l1 == l3 else one & held[l3][0]
                    rows += [(v, lo, l1, l3) for v, lo in reached(hit, x, y)]
                    if not same:
                        rows += [(v, lo, l1, l3) for v, lo in reached(hit.T, y, x)]
        return columns(rows, "v lo l1 l3")

    return tiles(g, found, "v long, lo int, l1 int, l3 int").distinct()


def triangle_corners(g: Graph) -> DataFrame:
    """(v, label, l1, l2), l1 <= l2: corners of triangles, and the labels of the other two."""

    def found(x: Side, y: Side, same: bool) -> dict:
        rows, linked = [], adjacent(x, y)
        for l2 in map(int, np.intersect1d(np.unique(x.ld), np.unique(y.ld))):
            hit = linked & common(x, y, same, l2)[0]
            for a, b, h in ((x, y, hit), (y, x, hit.T))[: 1 if same else 2]:
                rows += [(v, min(l1, l2), max(l1, l2)) for v, l1 in reached(h, a, b)]
        return columns(rows, "v l1 l2")

    own = g.adj.select(F.col("src").alias("v"), F.col("ls").alias("label")).distinct()
    return tiles(g, found, "v long, l1 int, l2 int").distinct().join(own, "v")


def adjacent(x: Side, y: Side) -> np.ndarray:
    """The matrix of edges between two blocks."""
    by = np.argsort(y.v)
    at = np.minimum(np.searchsorted(y.v[by], x.dst), len(by) - 1)
    in_y = y.v[by][at] == x.dst
    out = np.zeros((len(x.v), len(y.v)), bool)
    out[x.owner[in_y], by[at[in_y]]] = True
    return out


def heavy_parts(g: Graph, weight: Column) -> Iterator[Graph]:
    """The graph of its heaviest edges by this weight of a row of the adjacency, of ever more of them, at last of all. What
    occurs in a part has its best occurrence there."""
    for t in g.shared(f"shares of {weight}", lambda: _thresholds(g, weight)):
        yield Graph(g.vertices, g.edges, g.shared(f"{weight} from {t}", lambda: g.adj.where(weight >= t)), twins=g.twins)
    yield g


def _thresholds(g: Graph, weight: Column) -> list[float]:
    rows = g.adj.count()
    shares = []
    while FIRST * SMALL * 4 ** len(shares) < rows / 2:
        shares.append(1 - FIRST * SMALL * 4 ** len(shares) / rows)
    least = g.adj.agg(F.percentile_approx(weight, shares, 10_000)).first()[0] if shares else []
    return sorted(set(least), reverse=True)


def near_part(g: Graph) -> Graph:
    """The graph of each vertex's NEAR heaviest neighbours of each label and edge label. Of equal weights the first ids are
    taken, and so the first of each class of twins."""
    place = F.row_number().over(Window.partitionBy("dst", "ls", "el").orderBy(F.desc("w"), "src"))

    def rows() -> DataFrame:
        near = g.adj.withColumn("place", place).where(F.col("place") <= NEAR).drop("place")
        back = near.select("dst", "src", "el", "w", "ld", "ls", "wd", "ws").toDF("src", "dst", "el", "w", "ls", "ld", "ws", "wd")
        return near.select(*back.columns).union(back).distinct()

    return Graph(g.vertices, g.edges, g.shared("near", rows), twins=g.twins)


def kinds(g: Graph) -> DataFrame:
    """(label, near, n): how many vertices have a label and, by (label, edge label), so many neighbours, up to NEAR."""
    counts = g.adj.groupBy("src", "ls", "ld", "el").agg(F.least(F.count("*"), F.lit(NEAR)).cast("int").alias("n"))
    own = counts.groupBy(F.col("src").alias("v"), F.col("ls").alias("label")).agg(F.sort_array(F.collect_list(F.struct("ld", "el", "n"))).alias("near"))
    times = F.lit(1)
    if g.twins is not None:
        own = own.join(g.twins.members(), "v", "left").where("first is null or first = v")
        times = F.coalesce("times", F.lit(1))
    return own.groupBy("label", "near").agg(F.sum(times).alias("n"))


def at_most(g: Graph, positions: Iterable[tuple[int, int, int, list[tuple[int, int, int]]]]) -> dict[int, int]:
    """For each pattern the support that it has at most, by the numbers of neighbours alone; a row per pattern comes back.
    positions: (pattern, position, label, neighbours (label, edge label, how many))."""
    rows = [(pid, pos, label, [{"ld": ld, "el": el, "r": min(r, NEAR)} for ld, el, r in near]) for pid, pos, label, near in positions]
    wanted = F.broadcast(g.adj.sparkSession.createDataFrame(rows, "pid int, pos int, label int, groups array<struct<ld:int,el:int,r:int>>"))
    near = F.map_from_entries(F.transform("near", lambda x: F.struct(F.struct(x["ld"], x["el"]), x["n"])))
    of = g.shared("kinds", lambda: kinds(g)).select("label", near.alias("near"), "n").join(wanted, "label", "right")
    fits = F.forall("groups", lambda x: F.coalesce(F.try_element_at("near", F.struct(x["ld"], x["el"])) >= x["r"], F.lit(False)))
    each = of.groupBy("pid", "pos").agg(F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("n"))
    return {r["pid"]: r["n"] for r in each.groupBy("pid").agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).collect()}
