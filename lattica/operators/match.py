"""Support and weights of many candidates at once, from factorised occurrences.

A pattern is its core (the positions of degree two or more) and groups of leaves: so many leaves of one label and edge
label at one core position. Occurrences of cores are listed in tables that all patterns with the same core share; leaves
are never listed. A core grows by a position at a time, joined along the edge whose end has fewest neighbours that fit and
checked along the others, so that a cycle costs what its least frequented edge costs. What a row needs to know about
leaves it carries: for each core vertex, by label and edge label, how many neighbours there are and the few heaviest.

Leaves that compete for vertices are settled exactly by Hall's condition: every set of groups of one label needs as many
candidates together as leaves. A set that has no more than it needs keeps its candidates from all other groups. Few
candidates of each group suffice to decide this, so that a vertex of many neighbours costs no more than others; the images
of leaves are the neighbours, less those that every row keeps from them.

Of twins (sources/graph.py) a core row has the first of a class before the second, and so on: what other rows would say follows
by exchanging them, since one of a class that is an image counts for all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import dense
from lattica.operators.pattern import Pattern, canonical_order
from lattica.operators.support import SALTS, class_counts
from lattica.sources.graph import Graph
from lattica.sources.scratch import Scratch

#: Leaf images are numbered from here on, behind the core's positions.
LEAVES = 1000
#: Neighbours of each label that a profile lists at first, doubled for patterns of more positions.
LISTED = 6

#: So many patterns of one core are tried on a row at once; more go to further copies of the row.
BATCH = 32

ASKED = (
    "offers array<struct<u:int,lb:int,el:int,others:array<int>>>, "
    "wants array<struct<pid:int,groups:array<struct<i:int,r:int,least:int>>,rivals:array<struct<members:array<int>,need:int>>>>"
)


@dataclass(frozen=True)
class Shape:
    """A pattern as a core in canonical order and groups of leaves (core position, label, edge label, how many)."""

    core: Pattern
    groups: tuple[tuple[int, int, int, int], ...]

    @staticmethod
    def of(p: Pattern) -> Shape:
        inner = [0] if p.n_edges == 1 else [u for u in range(p.n_vertices) if p.degree(u) > 1]
        at = {u: k for k, u in enumerate(inner)}
        core = Pattern(tuple(p.labels[u] for u in inner), tuple(sorted((at[u], at[v], el) for u, v, el in p.edges if u in at and v in at)))
        order = canonical_order(core)
        to = {inner[u]: k for k, u in enumerate(order)}
        count: dict[tuple[int, int, int], int] = {}
        for u in inner:
            for v, el in p.links[u].items():
                if v not in at:
                    key = (to[u], p.labels[v], el)
                    count[key] = count.get(key, 0) + 1
        return Shape(reordered(core, order), tuple(sorted((*k, n) for k, n in count.items())))

    def rivals(self) -> list[tuple[list[int], int]]:
        """Sets of groups of one label that another group has too, with the leaves they need together."""
        by_label: dict[int, list[int]] = {}
        for k, (_, label, _, _) in enumerate(self.groups):
            by_label.setdefault(label, []).append(k)
        sets = (s for own in by_label.values() if len(own) > 1 for n in range(1, len(own) + 1) for s in combinations(own, n))
        return [(list(s), sum(self.groups[k][3] for k in s)) for s in sets]

    def least(self, k: int) -> int:
        """Neighbours of the group's label that its core vertex has at least: the leaves, and those in the core."""
        u, label, el, r = self.groups[k]
        return r + sum(self.core.labels[v] == label and e == el for v, e in self.core.links[u].items())

    def others(self, k: int) -> list[int]:
        """Core positions that might stand where a leaf of the group would."""
        u, label, _, _ = self.groups[k]
        return [v for v, x in enumerate(self.core.labels) if x == label and v != u]


def reordered(p: Pattern, order: list[int]) -> Pattern:
    at = {u: k for k, u in enumerate(order)}
    return Pattern(tuple(p.labels[u] for u in order), tuple(sorted((min(at[u], at[v]), max(at[u], at[v]), el) for u, v, el in p.edges)))


@dataclass(frozen=True)
class Step:
    """How a core comes from one with a position less: the new position's label, its edges (parent's position, label), and
    for each position of the core the parent's, -1 for the new one."""

    parent: Pattern
    label: int
    edges: tuple[tuple[int, int], ...]
    places: tuple[int, ...]

    @staticmethod
    def to(core: Pattern) -> Step:
        """The position that goes is one of least degree whose loss leaves the rest connected, so that cycles are closed
        early and what hangs on them comes last."""

        def rest(gone: int) -> Pattern | None:
            edges = [e for e in core.edges if gone not in e[:2]]
            left = core.restricted(edges)
            if core.n_vertices == 2:
                return Pattern((core.labels[1 - gone],), ())
            return left if left is not None and left.n_vertices == core.n_vertices - 1 else None

        gone = min((u for u in range(core.n_vertices) if rest(u) is not None), key=lambda u: (core.degree(u), -u))
        kept = [u for u in range(core.n_vertices) if u != gone]
        parent = rest(gone)
        order = canonical_order(parent)
        to = {kept[u]: k for k, u in enumerate(order)}
        edges = tuple((to[v], el) for v, el in sorted(core.links[gone].items()))
        return Step(reordered(parent, order), core.labels[gone], edges, tuple(to.get(u, -1) for u in range(core.n_vertices)))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of candidates: the lattice's level, which the driver holds anyway."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once however often it is used: what a generator makes isn't written out again in
    the filters and columns that use it."""
    return rows.select("*", F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))


def profile(g: Graph, labels: Iterable[int], listed: int) -> DataFrame:
    """(v, label, weight, near) of the vertices of these labels: near maps (label, edge label) to (n, top, topv), the number
    of such neighbours, and the `listed` of them with the heaviest edges and with the heaviest ends, as (w, v), falling.

    Lists are cut in two steps, so that a hub's edges never form one list; a row is as long as the labels around it."""
    spark = g.adj.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in labels], "x int")
    edge, end = F.struct("w", F.col("dst").alias("v")), F.struct(F.col("wd").alias("w"), F.col("dst").alias("v"))
    cut = lambda x: F.slice(F.sort_array(x, asc=False), 1, listed)
    known = g.adj.join(wanted.toDF("ls"), "ls", "left_semi").join(wanted.toDF("ld"), "ld", "left_semi")
    part = known.groupBy("src", "ld", "el", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), cut(F.collect_list(edge)).alias("top"), cut(F.collect_list(end)).alias("topv"))
    whole = part.groupBy("src", "ld", "el").agg(F.sum("n").alias("n"), cut(F.flatten(F.collect_list("top"))).alias("top"), cut(F.flatten(F.collect_list("topv"))).alias("topv"))
    near = whole.groupBy(F.col("src").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ld", "el"), F.struct("n", "top", "topv")))).alias("near"))
    own = g.vertices.join(wanted.toDF("label"), "label", "left_semi").select(F.col("id").alias("v"), "label", "weight")
    return own.join(near, "v")


def scarce_profile(g: Graph, labels: Iterable[int], listed: int) -> DataFrame:
    """profile() for supports alone: neighbours are listed where they are fewer than `listed`, elsewhere they are so many that
    leaves always find one, and their number is rounded so that such profiles are much the same. Only the few listed
    neighbours are gathered."""
    wanted = g.adj.sparkSession.createDataFrame([(int(x),) for x in labels], "x int")
    keys = ["src", "ld", "el"]
    known = g.adj.join(wanted.toDF("ls"), "ls", "left_semi").join(wanted.toDF("ld"), "ld", "left_semi").select(*keys, "dst")
    counts = known.groupBy(*keys).agg(F.count("*").alias("n"))
    lists = known.join(counts.where(F.col("n") < listed).drop("n"), keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct(F.lit(None).cast("double").alias("w"), F.col("dst").alias("v"))).alias("top"))
    rounded = F.when(F.col("n") < listed, F.col("n")).otherwise(F.greatest(F.lit(listed), F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long")))
    top = F.coalesce("top", F.array().cast("array<struct<w:double,v:long>>"))
    whole = counts.join(lists, keys, "left").select(*keys, rounded.alias("n"), top.alias("top"), F.slice(top, 1, 0).alias("topv"))
    near = whole.groupBy(F.col("src").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ld", "el"), F.struct("n", "top", "topv")))).alias("near"))
    own = g.vertices.join(wanted.toDF("label"), "label", "left_semi").select(F.col("id").alias("v"), "label", "weight")
    return own.join(near, "v")


def _around(position: Column, label: Column, el: Column) -> Column:
    """What a row's profile says about one label around one of its positions; null if there is none."""
    return F.try_element_at(F.get("near", position), F.struct(label.alias("ld"), el.alias("el")))


def _placed(old: str, new: str) -> Column:
    """The parent's values in the order of the child's positions, with the new one's where it belongs."""
    return F.transform("places", lambda i: F.when(i < 0, F.col(new)).otherwise(F.get(old, i)))


class Occurrences:
    """Core tables of a graph, made when a pattern first needs them, and measures of patterns on them.

    labels: of the vertices that any pattern may have. Tables are written to the shared folder, which cuts their lineage and
    keeps them when an executor is lost. reduce: leave out core occurrences around which no candidate's leaves may be found;
    later candidates with the same core are larger, so they lose nothing. rows counts what was listed.
    """

    profile = staticmethod(profile)

    def __init__(self, g: Graph, labels: Iterable[int], reduce: bool = True):
        self.g, self.spark, self.labels, self.reduce = g, g.adj.sparkSession, sorted(labels), reduce
        self.listed, self.rows, self.around, self.turns, self.scratch = 0, 0, None, None, None
        self.numbers: dict[str, int] = {}
        self.tables: list[tuple[set[str], DataFrame]] = []
        self.adj = g.adj.select("src", "dst", "ld", "el", "w")

    def close(self) -> None:
        if self.scratch is not None:
            self.scratch.close()
        self.tables, self.around, self.turns, self.scratch = [], None, None, None

    def list_at_least(self, n: int) -> None:
        """Profiles with so many neighbours of each label; tables that carry shorter ones go."""
        if n > self.listed:
            self.close()
            self.listed = max(LISTED, n, 2 * self.listed)
            self.scratch = Scratch(self.spark, "occurrences")
            self.around = self.put(self.profile(self.g, self.labels, self.listed))
            self.turns = self.g.twins and self.scratch.put(self.g.twins.members().where("v <> first").select("v", "before"))

    def put(self, rows: DataFrame) -> DataFrame:
        """A table whose rows are costly to work on: one of fewer files than there are cores is dealt out when it is read."""
        made, cores = self.scratch.put(rows), self.spark.sparkContext.defaultParallelism
        return made.repartition(cores) if len(made.inputFiles()) < cores else made

    def number(self, core: Pattern) -> int:
        return self.numbers.setdefault(core.code, len(self.numbers))

    def need(self, shapes: Iterable[Shape]) -> DataFrame:
        """(cid, m, near, bw, vbw) of the shapes' cores, each of which is listed once. near has a profile for each position."""
        cores = {s.core.code: s.core for s in shapes}
        asked: dict[str, list[list[tuple]]] = {}
        for s in shapes:
            asked.setdefault(s.core.code, []).append([(u, lb, el, s.least(k)) for k, (u, lb, el, _) in enumerate(s.groups)])
        have = set().union(*(codes for codes, _ in self.tables))
        missing, steps = {c: p for c, p in cores.items() if c not in have}, {}
        todo = list(missing.values())
        while todo:
            core = todo.pop()
            if core.n_vertices > 1:
                step = steps[core.code] = Step.to(core)
                if step.parent.code not in have and step.parent.code not in missing:
                    missing[step.parent.code] = step.parent
                    todo.append(step.parent)
        for size in sorted({p.n_vertices for p in missing.values()}):
            new = {c: p for c, p in missing.items() if p.n_vertices == size}
            if size == 1:
                made = self.vertices(new)
            else:
                made = self.grown(self.of({steps[c].parent.code for c in new}), {c: (p, steps[c]) for c, p in new.items()}, asked)
            made = self.put(made)
            self.rows += made.count()
            self.tables.append((set(new), made))
        return self.of(set(cores))

    def of(self, codes: set[str]) -> DataFrame:
        numbers = _table(self.spark, [(self.numbers[c],) for c in sorted(codes)], "cid int")
        parts = [table for own, table in self.tables if own & codes]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.join(numbers, "cid", "left_semi")

    def vertices(self, cores: dict[str, Pattern]) -> DataFrame:
        wanted = _table(self.spark, [(self.number(p), p.labels[0]) for p in cores.values()], "cid int, label int")
        first = self.around if self.turns is None else self.around.join(self.turns, "v", "left_anti")
        rows = first.join(wanted, "label")
        return rows.select("cid", F.array("v").alias("m"), F.array("near").alias("near"), F.lit(float("inf")).alias("bw"), F.col("weight").alias("vbw"))

    def grown(self, parents: DataFrame, cores: dict[str, tuple[Pattern, Step]], asked: dict[str, list[list[tuple]]]) -> DataFrame:
        """Occurrences of cores by one position more. Each restricts to exactly one occurrence of its parent, so the list is
        complete, but for exchanges of twins, and free of repeats. asked: groups of leaves of the candidates of a core, if there are any yet: a row stays if
        those of one may be found, judged by numbers of neighbours, of the parent's positions before it grows."""

        def wanted(p: Pattern, s: Step, new: bool) -> list:
            sets = asked.get(p.code, []) if self.reduce else []
            at = (lambda u: u) if new else (lambda u: s.places[u])
            return [[{"u": at(u), "lb": lb, "el": el, "r": r} for u, lb, el, r in groups if at(u) >= 0] for groups in sets]

        rows = [(self.number(p), self.number(s.parent), s.label, [{"u": u, "el": el} for u, el in s.edges], list(s.places), wanted(p, s, False), wanted(p, s, True)) for p, s in cores.values()]
        group = "array<array<struct<u:int,lb:int,el:int,r:int>>>"
        steps = _table(self.spark, rows, f"child int, cid int, lb int, ext array<struct<u:int,el:int>>, places array<int>, before {group}, after {group}")
        hold = lambda sets: (F.size(sets) == 0) | F.exists(sets, lambda x: F.forall(x, lambda y: F.coalesce(_around(y["u"], y["lb"], y["el"])["n"] >= y["r"], F.lit(False))))
        sizes = F.transform("ext", lambda x, i: F.struct(_around(x["u"], F.col("lb"), x["el"])["n"].alias("n"), i.alias("i")))
        open_ = once(parents.join(steps, "cid").where(hold("before")), sizes=sizes).where(F.forall("sizes", lambda x: x["n"].isNotNull())).drop("before")
        first = F.array_min("sizes")["i"]
        open_ = once(open_.withColumnRenamed("ext", "given"), ext=F.concat(F.slice("given", first + 1, 1), F.filter("given", lambda x, i: i != first))).drop("sizes", "given")
        most = max(len(s.edges) for _, s in cores.values())
        parts = []
        if any(len(s.edges) == 1 for _, s in cores.values()):
            parts.append(self.hung(open_.where(F.size("ext") == 1)))
        if most > 1:
            parts.append(self.closed(open_.where(F.size("ext") > 1), most, max(p.n_vertices for p, _ in cores.values())))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.where(hold("after")).select(F.col("child").alias("cid"), "m", "near", "bw", "vbw")

    def neighbours(self, rows: DataFrame) -> DataFrame:
        """rows with a neighbour dst along the first edge of ext that is no vertex of the row yet; the twins before it are."""
        leg = F.get("ext", F.lit(0))
        rows = rows.withColumn("src", F.get("m", leg["u"])).withColumn("el", leg["el"]).withColumnRenamed("lb", "ld").join(self.adj, ["src", "ld", "el"])
        rows = rows.where(~F.array_contains("m", F.col("dst"))).withColumn("bw", F.least("bw", "w")).drop("src", "ld", "el", "w")
        if self.turns is None:
            return rows
        held = F.coalesce(F.forall("before", lambda x: F.array_contains("m", x)), F.lit(True))
        return rows.join(self.turns.withColumnRenamed("v", "dst"), "dst", "left").where(held).drop("before")

    def hung(self, rows: DataFrame) -> DataFrame:
        """Rows grown by a vertex that hangs on one edge; all that fit stay, and keep the profiles of the parent."""
        rows = self.neighbours(rows).join(self.around.select(F.col("v").alias("dst"), "weight", F.col("near").alias("own")), "dst")
        rows = once(rows.withColumnsRenamed({"m": "old", "near": "older"}), m=_placed("old", "dst"), near=_placed("older", "own"))
        return rows.select("child", "after", "m", "near", "bw", F.least("vbw", "weight").alias("vbw"))

    def closed(self, rows: DataFrame, most: int, size: int) -> DataFrame:
        """Rows grown by a vertex that closes cycles. Most of what the first edge offers fails at the others, so rows go without
        profiles until all edges are checked, one after the other; those that are left fetch them for each of their positions."""
        rows = self.neighbours(rows.drop("near"))
        for k in range(1, most):
            more, done = rows.where(F.size("ext") > k), rows.where(F.size("ext") <= k)
            leg = F.get("ext", F.lit(k))
            more = more.withColumn("src", F.get("m", leg["u"])).withColumn("el", leg["el"]).join(self.adj.drop("ld"), ["src", "dst", "el"])
            more = more.withColumn("bw", F.least("bw", "w")).drop("src", "el", "w")
            rows = more if k == 1 else done.unionByName(more)
        rows = once(rows.withColumnRenamed("m", "old"), m=_placed("old", "dst")).select("child", "after", "m", "bw", "vbw")
        for k in range(size):
            own = self.around.select(F.col("v").alias("at"), "weight", F.col("near").alias(f"near{k}"))
            rows = rows.withColumn("at", F.get("m", F.lit(k))).join(own, "at").withColumn("vbw", F.least("vbw", "weight")).drop("at", "weight")
        return rows.select("child", "after", "m", F.array(*[f"near{k}" for k in range(size)]).alias("near"), "bw", "vbw")

    def measure(self, patterns: dict[int, Pattern], min_sup: int = 1) -> dict[int, tuple[int, float, float]]:
        """(support, weight, vertex weight) of each pattern that has an occurrence; of one whose core has fewer images than
        min_sup the support is that number, and its leaves aren't looked at. A row per pattern and position comes back."""
        if not patterns:
            return {}
        self.list_at_least(max(p.n_vertices for p in patterns.values()) + 1)
        shapes = {k: Shape.of(p) for k, p in patterns.items()}
        fits = self.fitting(self.need(shapes.values()), shapes).cache()
        core = class_counts(self.g, fits.select("pid", F.posexplode("m").alias("pos", "v"), "bw", "vbw"), ["pid", "pos"], "v", F.max("bw").alias("bw"), F.max("vbw").alias("vbw"))
        least, weights = {}, {}
        for r in core.collect():
            least[r["pid"]] = min(r["n"], least.get(r["pid"], r["n"]))
            weights[r["pid"]] = (r["bw"], r["vbw"])
        frequent = {k: shapes[k] for k, n in least.items() if n >= min_sup and shapes[k].groups}
        if frequent:
            for r in self.leaf_images(fits, frequent).collect():
                least[r["pid"]] = min(r["n"], least[r["pid"]])
        fits.unpersist()
        return {k: (n, *weights[k]) for k, n in least.items()}

    def fitting(self, cores: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
        """(pid, m, bw, vbw, held) of the core rows on which a pattern's leaves find distinct vertices, with the weights of
        the best choice; held has for each group the vertices that it may not take."""
        parts = [self.fitted(cores, own, bool(rivals)) for rivals in (0, 1) if (own := {k: s for k, s in shapes.items() if bool(s.rivals()) == bool(rivals)})]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def tried(self, cores: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
        """Core rows with what they offer to groups of leaves (open) and the patterns that are tried on them (wants)."""
        by_core: dict[int, list[int]] = {}
        for k, s in shapes.items():
            by_core.setdefault(self.number(s.core), []).append(k)
        rows = [(cid, *self.batch(shapes, own[i : i + BATCH])) for cid, own in by_core.items() for i in range(0, len(own), BATCH)]
        wanted = _table(self.spark, rows, f"cid int, {ASKED}")
        # of each label at each position the candidates by edge and by end, without core vertices of the row
        seen = F.transform("offers", lambda x: F.struct(F.transform(x["others"], lambda i: F.get("m", i)).alias("own"), _around(x["u"], x["lb"], x["el"]).alias("near")))
        rest = lambda x, list_: F.when(F.size(x["own"]) == 0, x["near"][list_]).otherwise(F.filter(x["near"][list_], lambda y: ~F.array_contains(x["own"], y["v"])))
        rows = once(cores.join(wanted, "cid"), seen=seen).drop("near", "offers", "cid")
        return once(rows, open=F.transform("seen", lambda x: F.struct(x["near"]["n"].alias("n"), x["own"].alias("own"), rest(x, "top").alias("top"), rest(x, "topv").alias("topv")))).drop("seen")

    def fitted(self, cores: DataFrame, shapes: dict[int, Shape], rivals: bool) -> DataFrame:
        """fitting() of patterns that all have, or all don't have, groups that compete. What a core row offers to a group of
        leaves is the same for all patterns, so it is made once for a batch of them, and they are tried inside the row.

        Without competition held is null: a group then leaves alone the core vertices of its label, and nothing else."""
        rows = self.tried(cores, shapes)
        offer = lambda x: F.get("open", x["i"])
        enough = lambda x: F.coalesce((offer(x)["n"] >= x["least"]) & (F.size(offer(x)["top"]) >= x["r"]), F.lit(False))
        fit = F.filter("wants", lambda c: F.forall(c["groups"], enough))
        if not rivals:
            # the smallest weight of the best choice of leaves: of each group the r-th
            best = lambda c, list_: F.coalesce(F.array_min(F.transform(c["groups"], lambda x: F.get(offer(x)[list_], x["r"] - 1)["w"])), F.lit(float("inf")))
            rows = rows.select("m", "bw", "vbw", F.inline(F.transform(fit, lambda c: F.struct(c["pid"].alias("pid"), best(c, "top").alias("low"), best(c, "topv").alias("lowv")))))
            return rows.select("pid", "m", F.least("bw", "low").alias("bw"), F.least("vbw", "lowv").alias("vbw"), F.lit(None).cast("array<array<long>>").alias("held"))
        free = lambda c: F.transform(c["groups"], lambda x: F.struct(x["r"].alias("r"), *[offer(x)[a].alias(a) for a in ("own", "top", "topv")]))
        rows = rows.select("m", "bw", "vbw", F.inline(F.transform(fit, lambda c: F.struct(c["pid"].alias("pid"), free(c).alias("free"), c["rivals"].alias("rivals")))))
        many = lambda s, list_, least=None: F.size(F.array_distinct(F.flatten(F.transform(s["members"], lambda i: F.transform(F.get("free", i)[list_] if least is None else F.filter(F.get("free", i)[list_], lambda y: y["w"] >= least), lambda y: y["v"])))))
        rows = once(rows, spare=F.transform("rivals", lambda s: many(s, "top") - s["need"])).where(F.forall("spare", lambda n: n >= 0))
        best = lambda list_: F.array_min(F.transform("free", lambda x: F.get(x[list_], x["r"] - 1)["w"]))
        rows = once(rows, each=best("top"), eachv=best("topv"))
        # where groups compete, the largest weight at which all sets still have as many candidates as they need
        whole = lambda list_, t: F.forall("rivals", lambda s: many(s, list_, t) >= s["need"])
        highest = lambda list_, most: F.array_max(F.filter(F.array_distinct(F.flatten(F.transform("free", lambda x: F.transform(x[list_], lambda y: y["w"])))), lambda t: (t < F.col(most)) & whole(list_, t)))
        tried = lambda list_, most: F.when(whole(list_, F.col(most)), F.col(most)).otherwise(highest(list_, most))
        tight = F.filter("rivals", lambda s, k: F.get("spare", k) == 0)
        rows = once(rows, low=tried("top", "each"), lowv=tried("topv", "eachv"), tight=tight)
        taken = lambda i: F.flatten(F.transform(F.filter("tight", lambda s: ~F.array_contains(s["members"], i)), lambda s: F.flatten(F.transform(s["members"], lambda k: F.transform(F.get("free", k)["top"], lambda y: y["v"])))))
        held = F.transform("free", lambda x, i: F.array_union(x["own"], taken(i)))
        return rows.select("pid", "m", F.least("bw", "low").alias("bw"), F.least("vbw", "lowv").alias("vbw"), held.alias("held"))

    def batch(self, shapes: dict[int, Shape], ids: list[int]) -> tuple[list[dict], list[dict]]:
        """What patterns with one core ask of its rows: the offers (label and edge label at a position) that any of them uses, and
        the patterns, which name offers by place."""
        offers: dict[tuple[int, int, int], tuple[int, dict]] = {}
        wants = []
        for k in ids:
            s, groups = shapes[k], []
            for i, (u, lb, el, r) in enumerate(s.groups):
                offer = offers.setdefault((u, lb, el), (len(offers), {"u": u, "lb": lb, "el": el, "others": s.others(i)}))
                groups.append({"i": offer[0], "r": r, "least": s.least(i)})
            wants.append({"pid": k, "groups": groups, "rivals": [{"members": x, "need": n} for x, n in s.rivals()]})
        return [x for _, x in offers.values()], wants

    def leaf_images(self, fits: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
        """(pid, pos, n): how many vertices the leaves of each group are mapped to. Rows are gathered by the vertex that the
        leaves hang on: a neighbour is an image unless all rows of that vertex hold it back. Few are, and these are listed beside the
        vertex, so that images are dealt by nothing."""
        rows = [(k, LEAVES + i, u, lb, el, s.others(i), bool(s.others(i) or s.rivals())) for k, s in shapes.items() for i, (u, lb, el, _) in enumerate(s.groups)]
        wanted = _table(self.spark, rows, "pid int, pos int, u int, ld int, el int, others array<int>, held_back boolean")
        held = F.coalesce(F.get("held", F.col("pos") - LEAVES), F.transform("others", lambda i: F.get("m", i)))
        at = fits.select("pid", "m", "held").join(wanted, "pid").select("pid", "pos", "ld", "el", F.get("m", "u").alias("src"), F.when(F.col("held_back"), held).alias("held"))
        keys = ["pid", "pos", "src"]
        hung = at.groupBy(*keys, "ld", "el").agg(F.count("*").alias("rows"))
        links = self.adj.select("src", "ld", "el", "dst")
        if any(r[-1] for r in rows):
            held = at.where(F.size("held") > 0).select(*keys, F.explode("held").alias("dst")).groupBy(*keys, "dst").agg(F.count("*").alias("times"))
            never = held.join(hung.select(*keys, "rows"), keys).where("times = rows").groupBy(*keys).agg(F.collect_list("dst").alias("never"))
            images = hung.join(never, keys, "left").join(links, ["src", "ld", "el"]).where("never is null or not array_contains(never, dst)")
        else:
            images = hung.join(links, ["src", "ld", "el"])
        return class_counts(self.g, images, ["pid", "pos"], "dst")


class Supports(Occurrences):
    """Supports alone, of graphs with many more edges than vertices. Profiles list only scarce neighbours, patterns that a core
    row fits stay together as one list, and images are gathered by such lists; where leaves need no more than they surely find,
    that is one list for most rows. Triangles come from tiles of pairs of vertices where these are fewer than two-paths."""

    profile = staticmethod(scarce_profile)

    def __init__(self, g: Graph, labels: Iterable[int], reduce: bool = True):
        super().__init__(g, labels, reduce)
        self.tiled: bool | None = None
        self.corners: DataFrame | None = None

    def measure(self, patterns: dict[int, Pattern], min_sup: int = 1) -> dict[int, tuple[int, None, None]]:
        flat = {k: p for k, p in patterns.items() if p.n_vertices == p.n_edges == 3}
        if flat and self.tiled is None:
            self.tiled = dense.worth_tiles(self.g)
        flat = flat if self.tiled else {}
        rest, least = {k: p for k, p in patterns.items() if k not in flat}, {}
        if rest:
            self.list_at_least(max(p.n_vertices for p in rest.values()) + 1)
            shapes = {k: Shape.of(p) for k, p in rest.items()}
            free, tight = self.split(self.need(shapes.values()), shapes)
            free, tight = free.cache(), tight.cache()
            at = lambda rows, *own: rows.select(*own, F.posexplode("m").alias("pos", "v")).distinct()
            images = at(free, "pids").select(F.explode("pids").alias("pid"), "pos", "v").unionByName(at(tight, "pid"))
            counts = class_counts(self.g, images, ["pid", "pos"], "v").collect()
            least = {k: min(r["n"] for r in counts if r["pid"] == k) for k in {r["pid"] for r in counts}}
            frequent = {k: shapes[k] for k, n in least.items() if n >= min_sup and shapes[k].groups}
            if frequent:
                for r in self.leaves(free, tight, frequent).collect():
                    least[r["pid"]] = min(r["n"], least[r["pid"]])
            free.unpersist()
            tight.unpersist()
        if flat:
            for r in self.triangles(flat).collect():
                least[r["pid"]] = min(r["n"], least.get(r["pid"], r["n"]))
        return {k: (n, None, None) for k, n in least.items()}

    def triangles(self, patterns: dict[int, Pattern]) -> DataFrame:
        """(pid, pos, n) of triangles."""
        if self.corners is None:
            if self.scratch is None:
                self.list_at_least(LISTED)
            self.corners = self.scratch.put(dense.triangle_corners(self.g))
        rows = [(k, u, p.labels[u], *sorted(p.labels[v] for v in range(3) if v != u)) for k, p in patterns.items() for u in range(3)]
        return class_counts(self.g, self.corners.join(_table(self.spark, rows, "pid int, pos int, label int, l1 int, l2 int"), ["label", "l1", "l2"]).select("pid", "pos", "v"), ["pid", "pos"], "v")

    def close(self) -> None:
        super().close()
        self.corners = None

    def split(self, cores: DataFrame, shapes: dict[int, Shape]) -> tuple[DataFrame, DataFrame]:
        """(m, pids) of the core rows and all patterns that fit on them and hold back core vertices alone; (pid, m, held) of those
        where a set of groups has no more candidates than it needs, and keeps them from others."""
        # where each label around a row has plenty, what fits follows from the labels, and is tried once for all such rows
        rich = F.forall("near", lambda p: F.forall(F.map_values(p), lambda x: x["n"] >= self.listed))
        marked = once(cores, rich=rich)
        same = marked.where("rich").select("m", F.col("cid").alias("core"), F.transform("near", lambda p: F.sort_array(F.map_keys(p))).alias("kinds"))
        none = F.array().cast("array<struct<w:double,v:long>>")
        full = F.struct(F.lit(self.listed).cast("long").alias("n"), none.alias("top"), none.alias("topv"))
        near = F.transform("kinds", lambda k: F.map_from_arrays(k, F.transform(k, lambda _: full)))
        classes = same.select("core", "kinds").distinct().select("core", "kinds", F.col("core").alias("cid"), F.array().cast("array<long>").alias("m"), near.alias("near"))
        fits = lambda rows, *own: rows.select(*own, F.sort_array(F.transform("fit", lambda c: c["pid"])).alias("pids")).where(F.size("pids") > 0)
        by_class = self.scratch.put(fits(self.fit(self.tried(classes, shapes)), "core", "kinds"))
        rows = self.fit(self.tried(marked.where("not rich").drop("rich"), shapes))
        is_tight = lambda c: F.exists(c["spare"], lambda n: n == 0)
        free = fits(rows.withColumn("fit", F.filter("fit", lambda c: ~is_tight(c))), "m").unionByName(same.join(by_class, ["core", "kinds"]).select("m", "pids"))
        offer = lambda x: F.get("open", x["i"])
        own = lambda c: F.transform(c["groups"], lambda x: F.struct(offer(x)["own"].alias("own"), F.transform(offer(x)["top"], lambda y: y["v"]).alias("top")))
        tight = rows.select("m", F.inline(F.transform(F.filter("fit", is_tight), lambda c: F.struct(c["pid"].alias("pid"), own(c).alias("free"), F.filter(c["rivals"], lambda s, k: F.get(c["spare"], k) == 0).alias("tight")))))
        taken = lambda i: F.flatten(F.transform(F.filter("tight", lambda s: ~F.array_contains(s["members"], i)), lambda s: F.flatten(F.transform(s["members"], lambda k: F.get("free", k)["top"]))))
        held = F.transform("free", lambda x, i: F.array_union(x["own"], taken(i)))
        return free, tight.select("pid", "m", held.alias("held"))

    def fit(self, rows: DataFrame) -> DataFrame:
        """tried() rows with the patterns that fit on them (fit), and how many candidates each set of rivals can spare."""
        plenty = lambda x: x["n"] >= self.listed
        offer = lambda x: F.get("open", x["i"])
        enough = lambda x: F.coalesce((offer(x)["n"] >= x["least"]) & (plenty(offer(x)) | (F.size(offer(x)["top"]) >= x["r"])), F.lit(False))
        group = lambda c, i: offer(F.get(c["groups"], i))
        together = lambda c, s: F.size(F.array_distinct(F.flatten(F.transform(s["members"], lambda i: F.transform(group(c, i)["top"], lambda y: y["v"])))))
        spare = lambda c, s: F.when(F.exists(s["members"], lambda i: plenty(group(c, i))), F.lit(self.listed)).otherwise(together(c, s) - s["need"])
        fit = F.transform(F.filter("wants", lambda c: F.forall(c["groups"], enough)), lambda c: F.struct(c["pid"].alias("pid"), c["groups"].alias("groups"), c["rivals"].alias("rivals"), F.transform(c["rivals"], lambda s: spare(c, s)).alias("spare")))
        return once(rows, fit=F.filter(fit, lambda c: F.forall(c["spare"], lambda n: n >= 0))).drop("wants")

    def leaves(self, free: DataFrame, tight: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
        """leaf_images() of split rows. Of cores of two positions a vertex holds back the other one, in all its rows if the least
        and the largest are the same; rows of larger cores are taken apart by pattern."""
        small = {k: s for k, s in shapes.items() if s.core.n_vertices <= 2}
        parts = []
        if len(small) < len(shapes):
            whole = free.select(F.explode("pids").alias("pid"), "m", F.lit(None).cast("array<array<long>>").alias("held")).unionByName(tight)
            parts.append(self.leaf_images(whole, {k: s for k, s in shapes.items() if k not in small}))
        if small:
            rows = [(k, LEAVES + i, u, lb, el, bool(s.others(i)), i) for k, s in small.items() for i, (u, lb, el, _) in enumerate(s.groups)]
            wanted = _table(self.spark, rows, "pid int, pos int, u int, ld int, el int, other boolean, i int")
            keys = ["pid", "pos", "src", "ld", "el"]
            by_list = free.where(F.size("m") <= 2).select("pids", "m", F.posexplode("m").alias("u", "src")).groupBy("pids", "u", "src").agg(F.min(F.get("m", 1 - F.col("u"))).alias("lo"), F.max(F.get("m", 1 - F.col("u"))).alias("hi"))
            sure = by_list.withColumn("pid", F.explode("pids")).join(wanted, ["pid", "u"]).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("other").alias("other"))
            sure = sure.select(*keys, F.when(F.col("other") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("one"))
            rare = tight.join(wanted, "pid").select(*[c for c in keys if c != "src"], F.get("m", "u").alias("src"), F.get("held", "i").alias("held"))
            times = rare.select(*keys, F.explode("held").alias("dst")).groupBy(*keys, "dst").agg(F.count("*").alias("times"))
            rare = rare.groupBy(*keys).agg(F.count("*").alias("rows")).join(sure.select(*keys, "one", F.lit(True).alias("free")), keys, "left")
            # a neighbour is no image if all free rows and all others hold it back
            links = self.adj.select("src", "ld", "el", "dst")
            only = sure.join(rare.select(*keys), keys, "left_anti")
            # a vertex's neighbours are images of the same leaves, whose list many vertices share: a neighbour is taken once for each list
            lists = only.where("one is null").groupBy("src", "ld", "el").agg(F.sort_array(F.collect_list(F.struct("pid", "pos"))).alias("asks"))
            shared = lists.join(links, ["src", "ld", "el"]).select("asks", "dst").distinct().select(F.inline("asks"), "dst")
            only = only.where("one is not null").join(links, ["src", "ld", "el"]).where("one <> dst").select("pid", "pos", "dst").unionByName(shared)
            mixed = rare.join(links, ["src", "ld", "el"]).join(times, [*keys, "dst"], "left").where("coalesce(times, 0) < rows or (free and (one is null or one <> dst))").select("pid", "pos", "dst")
            parts.append(class_counts(self.g, only.unionByName(mixed), ["pid", "pos"], "dst"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Measures:
    """Measures of patterns: of a small graph by Occurrences. Of others, supports are bounded from above by numbers of
    neighbours and from below by occurrences among each vertex's heaviest neighbours; where these differ, Supports looks at the
    whole graph. Weights of frequent patterns come from occurrences in ever larger heavy parts, until a pattern has one. Parts
    and the whole list all cores, since what is asked of them varies. ends: whether vertex weights are wanted; without, they may
    be None."""

    def __init__(self, g: Graph, labels: Iterable[int], reduce: bool = True, ends: bool = True):
        self.g, self.labels, self.ends = g, sorted(labels), ends
        self.large = dense.rows_to_list(g) > dense.SMALL
        self.whole = Supports(g, labels, False) if self.large else Occurrences(g, labels, reduce)
        self.near: Supports | None = None
        self.parts: dict[str, list[Occurrences]] = {}
        self.more: dict[str, Iterator[Graph]] = {}

    def all(self) -> list[Occurrences]:
        return [self.whole, *([self.near] if self.near else []), *(x for own in self.parts.values() for x in own)]

    @property
    def rows(self) -> int:
        return sum(x.rows for x in self.all())

    def close(self) -> None:
        for x in self.all():
            x.close()

    def measure(self, patterns: dict[int, Pattern], min_sup: int = 1) -> dict[int, tuple[int, float | None, float | None]]:
        if not self.large or not patterns:
            return self.whole.measure(patterns, min_sup)
        found = self.supports(patterns, min_sup)
        self.collect()
        frequent = {k: patterns[k] for k, n in found.items() if n >= min_sup}
        best = [self.best(frequent, "w", F.col("w"), 1), self.best(frequent, "ends", F.least("ws", "wd"), 2) if self.ends else {}]
        return {k: (n, *(x.get(k) for x in best)) for k, n in found.items()}

    def supports(self, patterns: dict[int, Pattern], min_sup: int) -> dict[int, int]:
        """Supports; of patterns under min_sup a number under it that they have at most."""
        most = dense.at_most(self.g, [(k, u, p.labels[u], [(*to, n) for to, n in Counter((p.labels[v], el) for v, el in p.links[u].items()).items()]) for k, p in patterns.items() for u in range(p.n_vertices)])
        found = {k: n for k, n in most.items() if 0 < n < min_sup}
        left = {k: p for k, p in patterns.items() if most[k] >= max(1, min_sup)}
        if left and self.near is None:
            self.near = Supports(dense.near_part(self.g), self.labels, False)
        # what is under min_sup among these neighbours need not be in the whole graph
        found |= {k: n for k, (n, _, _) in self.near.measure(left, min_sup).items() if n == most[k]} if left else {}
        return found | {k: n for k, (n, _, _) in self.whole.measure({k: p for k, p in left.items() if k not in found}, min_sup).items()}

    def best(self, patterns: dict[int, Pattern], name: str, weight: Column, at: int) -> dict[int, float]:
        own, more = self.parts.setdefault(name, []), self.more.setdefault(name, dense.heavy_parts(self.g, weight))
        done: dict[int, float] = {}
        k = 0
        while left := {k: p for k, p in patterns.items() if k not in done}:
            if k == len(own):
                if (part := next(more, None)) is None:
                    break
                own.append(Occurrences(part, self.labels, False))
            # no support is asked for, so leaves' images aren't looked at
            done |= {pid: m[at] for pid, m in own[k].measure(left, 1 << 62).items()}
            self.collect()
            k += 1
        return done

    def collect(self) -> None:
        """Garbage on the driver, which holds broadcasts, shuffles and compiled plans of jobs that are done: a level has hundreds
        of these, and the driver's heap alone is no reason to clear them soon."""
        self.g.adj.sparkSession._jvm.System.gc()
