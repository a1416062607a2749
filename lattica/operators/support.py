"""Support and bottleneck weight of patterns, from occurrence rows.

An occurrence is an injective map of a pattern's positions to vertices that keeps labels and edges; automorphic ones
count too. The support of a pattern is the least number of distinct images over its positions, its weight the best
occurrence's smallest edge, its vertex weight the best occurrence's smallest vertex.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import dense
from lattica.sources.graph import Graph, Parts
from lattica.sources.scratch import Scratch


def bitmap_counts(rows: DataFrame, keys: list[str], value: str, *more: Column, times: str | None = None) -> DataFrame:
    """(keys, n, more): distinct whole numbers of each key, counted in bitmaps of 32,768 of them. A task sends a bitmap for
    each key and range of numbers that it has, not a row for each number, and nothing is dealt by number. more: maxima of
    other columns by name, as max(x) AS x. times: a column that follows from the number, and says how often it counts."""
    x, by = F.col(value), [*keys, *([times] if times else [])]
    part = rows.groupBy(*by, F.bitmap_bucket_number(x).alias("_bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(x))).alias("_n"), *more)
    names = [c for c in part.columns if c not in (*by, "_bucket", "_n")]
    return part.groupBy(*keys).agg(F.sum(F.col("_n") * F.col(times) if times else "_n").alias("n"), *[F.max(c).alias(c) for c in names])


def class_counts(g: Graph, rows: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """bitmap_counts() of vertices of the whole graph: one of a class of twins, whichever it is, counts for all of them."""
    if g.twins is None:
        return bitmap_counts(rows, keys, value, *more)
    known = g.twins.members().select(F.col("v").alias(value), F.col("first").alias("_first"), F.col("times").alias("_times"))
    rows = rows.join(known, value, "left").withColumns({value: F.coalesce("_first", value), "_times": F.coalesce("_times", F.lit(1))})
    return bitmap_counts(rows, keys, value, *more, times="_times")


def image_support(rows: DataFrame, keys: list[str], positions: list[str], alias: str = "mni") -> DataFrame:
    """(keys, mni): least count of distinct images. The long form keeps partial counts per key and position, where several
    distinct counts at once would expand every row."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.col(c).alias("v")) for k, c in enumerate(positions)]))
    images = rows.select(*keys, at.alias("i")).select(*keys, "i.pos", "i.v")
    return bitmap_counts(images, [*keys, "pos"], "v").groupBy(*keys).agg(F.min("n").alias(alias))


def measured(rows: DataFrame, keys: list[str], positions: list[str], weights: list[str], min_sup: int = 1) -> DataFrame:
    """(keys, mni, max_w) of the groups of occurrences with at least min_sup."""
    frequent = image_support(rows, keys, positions).where(F.col("mni") >= min_sup)
    low = F.least(*weights) if len(weights) > 1 else F.col(weights[0])
    return frequent.join(rows.groupBy(*keys).agg(F.max(low).alias("max_w")), keys)


def _adj(g: Graph, mark: str, *columns: str) -> DataFrame:
    return g.adj.select(*[F.col(c).alias(f"{mark}_{c}") for c in (columns or ("src", "dst", "ls", "ld", "el", "w"))])


def edges(g: Graph, min_sup: int = 1) -> DataFrame:
    """Single edges: (la, lb, el, mni, max_w). Equal labels count both orientations."""
    rows = g.adj.where("ls <= ld").select(F.col("ls").alias("la"), F.col("ld").alias("lb"), "el", "src", "dst", "w")
    return measured(rows, ["la", "lb", "el"], ["src", "dst"], ["w"], min_sup)


def edge_vertex_weights(g: Graph) -> DataFrame:
    """(la, lb, el, max_vw) of single edges."""
    return g.adj.where("ls <= ld").groupBy(F.col("ls").alias("la"), F.col("ld").alias("lb"), "el").agg(F.max(F.least("ws", "wd")).alias("max_vw"))


#: A hub's edges are dealt to so many groups before its largest weights are picked.
SALTS = 64


def star_profile(g: Graph, most: int = 3) -> DataFrame:
    """(src, ls, ld, el, cnt, top): neighbours of each label and edge label, and the `most` heaviest edges to them as
    (w, dst), falling. Lists are cut down in two steps, so that a hub's edges never form one list."""
    edge = F.struct("w", "dst")
    cut = lambda x: F.slice(F.sort_array(x, asc=False), 1, most)
    part = g.adj.groupBy("src", "ls", "ld", "el", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("cnt"), cut(F.collect_list(edge)).alias("top"))
    return part.groupBy("src", "ls", "ld", "el").agg(F.sum("cnt").alias("cnt"), cut(F.flatten(F.collect_list("top"))).alias("top"))


def weight_profile(g: Graph, most: int = 3) -> DataFrame:
    """(src, ls, ld, el, cnt, ws): neighbours of each label and edge label, and the weights of the `most` heaviest edges to them,
    falling. Edges of one weight are counted where they are read and shuffled as one row."""
    keys = ["src", "ls", "ld", "el"]
    cut = lambda x: F.slice(F.sort_array(x, asc=False), 1, most)
    each = g.adj.groupBy(*keys, "w").agg(F.count("*").alias("n"))
    part = each.groupBy(*keys, F.pmod(F.xxhash64("w"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("cnt"), cut(F.collect_list(F.struct("w", "n"))).alias("top"))
    whole = part.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), cut(F.flatten(F.collect_list("top"))).alias("top"))
    times = F.flatten(F.transform("top", lambda x: F.array_repeat(x["w"], F.least(x["n"], F.lit(most)).cast("int"))))
    return whole.select(*keys, "cnt", F.slice(times, 1, most).alias("ws"))


#: Centres that are sent to every task, at most; of two numbers each.
SENT_CENTRES = 100_000


def two_path_centres(g: Graph, profile: DataFrame | None = None) -> DataFrame:
    """(src, a, b, c, e1, e2, w): for each vertex the two-paths a - b - c that it is the centre of, and the best one's
    weight, read off the vertex's profile: a row per pair of neighbour labels, not of neighbours."""
    k = star_profile(g, 2) if profile is None else profile
    x = k.select("src", F.col("ls").alias("b"), F.col("ld").alias("a"), F.col("el").alias("e1"), F.col("cnt").alias("n1"), F.col("top").alias("t1"))
    y = k.select("src", F.col("ld").alias("c"), F.col("el").alias("e2"), F.col("top").alias("t2"))
    same = (F.col("a") == F.col("c")) & (F.col("e1") == F.col("e2"))
    rows = x.join(y, "src").where((F.struct("a", "e1") <= F.struct(F.col("c").alias("a"), F.col("e2").alias("e1"))) & (~same | (F.col("n1") >= 2)))
    first, second = F.get("t1", F.lit(0))["w"], F.get("t1", F.lit(1))["w"]
    return rows.select("src", "a", "b", "c", "e1", "e2", F.when(same, second).otherwise(F.least(first, F.get("t2", F.lit(0))["w"])).alias("w"))


PATH = ["a", "b", "c", "e1", "e2"]


def two_path_weights(g: Graph) -> DataFrame:
    """(a, b, c, e1, e2, max_w) of all two-paths."""
    return two_path_centres(g).groupBy(*PATH).agg(F.max("w").alias("max_w"))


def two_paths(g: Graph, min_sup: int = 1, profile: DataFrame | None = None) -> DataFrame:
    """The lookup table of two-edge patterns: (a, b, c, e1, e2, mni, max_w). Occurrences are never listed: a centre's
    neighbours of the leaf's label and edge label are the leaf's images."""
    g.complete_to(3)
    rows, n = two_path_centres(g, profile), F.count("*")
    if g.twins is not None:
        rows = rows.join(g.twins.extra.select(F.col("v").alias("src"), "extra"), "src", "left")
        n = F.sum(F.coalesce("extra", F.lit(0)) + 1)
    centres = rows.groupBy(*PATH).agg(n.alias("n"), F.max("w").alias("max_w")).where(F.col("n") >= min_sup)
    kept = rows.join(centres.select(*PATH), PATH, "left_semi")
    ends = F.array_distinct(F.array(F.struct(F.col("a").alias("ld"), F.col("e1").alias("el")), F.struct(F.col("c").alias("ld"), F.col("e2").alias("el"))))
    leaves = kept.select("src", *PATH, F.explode(ends).alias("leaf")).select("src", *PATH, "leaf.ld", "leaf.el")
    images = leaves.join(g.adj.select("src", "ld", "el", "dst"), ["src", "ld", "el"]).select(*PATH, "ld", "el", "dst").distinct()
    k = F.count("*")
    if g.twins is not None:
        images = images.join(g.twins.extra.select(F.col("v").alias("dst"), "extra"), "dst", "left")
        k = F.sum(F.coalesce("extra", F.lit(0)) + 1)
    low = images.groupBy(*PATH, "ld", "el").agg(k.alias("k")).groupBy(*PATH).agg(F.min("k").alias("leaf"))
    return centres.join(low, PATH).select(*PATH, F.least("n", "leaf").alias("mni"), "max_w").where(F.col("mni") >= min_sup)


def three_paths(g: Graph, min_sup: int = 1) -> DataFrame:
    """Paths of four vertices: (l0, l1, l2, l3, mni, max_w), for graphs of one edge label. Both end pairs must be
    frequent two-paths; the label table of those is an aggregate of the label set and is read twice, so it is written.

    Occurrences are listed here, one row each after both pairs are known to be frequent. Reading them off profiles, as
    for two-paths, has a row per edge and pair of end labels, which was slower on graphs of about as many labels as
    neighbours.
    """
    p, q, r = _adj(g, "p", "src", "dst", "ls", "ld", "w"), _adj(g, "q", "src", "dst", "ld", "w"), _adj(g, "r", "src", "dst", "ld", "w")
    known = two_paths(g, min_sup).select("a", "b", "c")
    known = Scratch(g.adj.sparkSession, "paths").put(known.union(known.select("c", "b", "a")).distinct())
    rows = p.join(q, (F.col("p_src") == F.col("q_src")) & (F.col("p_dst") != F.col("q_dst")))
    rows = rows.join(known.toDF("p_ld", "p_ls", "q_ld"), ["p_ld", "p_ls", "q_ld"], "left_semi")
    rows = rows.join(r, (F.col("q_dst") == F.col("r_src")) & (F.col("r_dst") != F.col("p_src")) & (F.col("r_dst") != F.col("p_dst")))
    rows = rows.where((F.col("p_ld") < F.col("r_ld")) | (F.col("p_ld") == F.col("r_ld")) & (F.col("p_ls") <= F.col("q_ld")))
    rows = rows.join(known.toDF("p_ls", "q_ld", "r_ld"), ["p_ls", "q_ld", "r_ld"], "left_semi")
    rows = rows.select(F.col("p_ld").alias("l0"), F.col("p_ls").alias("l1"), F.col("q_ld").alias("l2"), F.col("r_ld").alias("l3"), F.col("p_dst").alias("v0"), F.col("p_src").alias("v1"), F.col("q_dst").alias("v2"), F.col("r_dst").alias("v3"), F.least("p_w", "q_w", "r_w").alias("w"))
    return measured(rows, ["l0", "l1", "l2", "l3"], ["v0", "v1", "v2", "v3"], ["w"], min_sup)


def triangle_rows(g: Graph) -> DataFrame:
    """Occurrences of triangles with rising labels. Each triangle is found once, at its vertex of least degree: edges
    point to the end of larger degree, so that a hub has few of them to pair."""
    degree = g.adj.groupBy("src").agg(F.count("*").alias("ds"))
    e = g.adj.join(degree, "src").join(degree.toDF("dst", "dd"), "dst").where(F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src")))
    e = e.select("src", "dst", "ls", "ld", "w")
    p, q, r = e.toDF("x", "y", "lx", "ly", "wxy"), e.select("src", "dst", "ld", "w").toDF("x", "z", "lz", "wxz"), e.select("src", "dst", "w").toDF("y", "z", "wyz")
    # either of two neighbours may be the lower end of the third edge
    found = p.join(q, "x").where("y <> z").join(r, ["y", "z"])
    corner = {"x": "lx", "y": "ly", "z": "lz"}
    turns = []
    for m in permutations("xyz"):
        l, v = [F.col(corner[c]) for c in m], [F.col(c) for c in m]
        turn = F.struct(*[c.alias(f"l{i}") for i, c in enumerate(l)], *[c.alias(f"v{i}") for i, c in enumerate(v)])
        turns.append(F.when((l[0] <= l[1]) & (l[1] <= l[2]), turn))
    return found.select(F.explode(F.array_compact(F.array(*turns))).alias("t"), F.least("wxy", "wxz", "wyz").alias("w1")).select("t.*", "w1")


def triangles(g: Graph, min_sup: int = 1) -> DataFrame:
    """(l0, l1, l2, mni, max_w), for graphs of one edge label."""
    return measured(triangle_rows(g), ["l0", "l1", "l2"], ["v0", "v1", "v2"], ["w1"], min_sup)


def four_cycles(g: Graph, min_sup: int = 1) -> DataFrame:
    """(l0, l1, l2, l3, mni, max_w) of cycles v0 - v1 - v2 - v3, for graphs of one edge label, labels read from the corner and
    in the direction that give the least row.

    Where two-paths are more than pairs of vertices, supports come from cycles among each vertex's heaviest neighbours, if
    these are all that there may be, else from tiles of pairs, and weights from cycles of heavy parts of the graph.
    """
    g.complete_to(4)
    scratch = Scratch(g.adj.sparkSession, "cycles")
    g = replace(g, adj=scratch.put(g.adj), parts=Parts(scratch))
    if not dense.worth_tiles(g):
        return listed_cycles(g, min_sup)
    support = near_cycles(g, min_sup)
    if support is None:
        support = tiled_cycles(g, min_sup)
    best: dict[tuple, float] = {}
    for part in dense.heavy_parts(g, F.col("w")):
        if len(best) < len(support):
            found = cycle_weights(part, Scratch(g.adj.sparkSession, "cycles"))[2].collect()
            best = {tuple(r["ring"]): r["max_w"] for r in found if tuple(r["ring"]) in support} | best
    return g.adj.sparkSession.createDataFrame([(*k, n, best[k]) for k, n in support.items()], "l0 int, l1 int, l2 int, l3 int, mni long, max_w double")


def near_cycles(g: Graph, min_sup: int) -> dict[tuple, int] | None:
    """Supports of frequent cycles by their labels, a row per combination of labels, if cycles among each vertex's heaviest
    neighbours have as many images as there may be; else None."""
    links = {(r["ls"], r["ld"]) for r in g.adj.select("ls", "ld").distinct().collect()}
    (el,) = (r["el"] for r in g.adj.select("el").distinct().collect())
    after = {x: [b for a, b in links if a == x] for x, _ in links}
    if sum(len(after[b]) * len(after[c]) for a, b in links for c in after[b]) > 8 * dense.RINGS:
        return None
    rings = {(a, b, c, d) for a, b in links for c, d in product(after[b], after[a]) if (c, d) in links}
    read = lambda x: [x[k:] + x[:k] for k in range(4)]
    rings = sorted({min(read(x) + read(x[::-1])) for x in rings})
    around = lambda x, k: sorted((x[k - 1], x[(k + 1) % 4]))
    groups = lambda a, b: [(a, el, 2)] if a == b else [(a, el, 1), (b, el, 1)]
    most = dense.at_most(g, [(n, k, x[k], groups(*around(x, k))) for n, x in enumerate(rings) for k in range(4)])
    left = {x: most[n] for n, x in enumerate(rings) if most[n] >= max(1, min_sup)}
    found = {(r["l0"], r["l1"], r["l2"], r["l3"]): r["mni"] for r in cycles_found(dense.near_part(g), min_sup).collect()} if left else {}
    return left if all(found.get(x) == n for x, n in left.items()) else None


def tiled_cycles(g: Graph, min_sup: int) -> dict[tuple, int]:
    """Supports of frequent cycles by their labels, from tiles of pairs of vertices."""
    ring, corner = ["l0", "l1", "l2", "l3"], ["ls", "l1", "lo", "l3"]
    least, turns = _read_ways(ring, corner)
    own = g.adj.select(F.col("src").alias("v"), "ls").distinct()
    corners = dense.cycle_corners(g).join(own, "v").select("v", least.alias("ring"), F.explode(turns).alias("turn"))
    images = corners.select("ring", "v", F.posexplode("turn").alias("pos", "who")).where("who = 0")
    support = class_counts(g, images, ["ring", "pos"], "v").groupBy("ring").agg(F.min("n").alias("mni")).where(F.col("mni") >= min_sup)
    # a row per combination of labels
    return {tuple(r["ring"]): r["mni"] for r in support.collect()}


def _read_ways(ring: list[str], corner: list[str]) -> tuple[Column, Column]:
    """Labels of a cycle's corners read the least way, and the ways (places of corners) in which that is read."""
    ways = [[(k + i) % 4 for i in range(4)] for k in range(4)] + [[(k - i) % 4 for i in range(4)] for k in range(4)]
    read = lambda way: F.struct(*[F.col(corner[c]).alias(r) for c, r in zip(way, ring)])
    least = F.least(*[read(way) for way in ways])
    return least, F.array_compact(F.array(*[F.when(read(way) == least, F.array(*[F.lit(c) for c in way])) for way in ways]))


def cycle_weights(g: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two-paths below their corner of largest degree, the cycles they close by label, and (ring, max_w).

    A cycle is found once, at its corner h of largest degree: two-paths h - m - o whose m and o are of less degree than h,
    which a hub has no more of than its small neighbours have neighbours. The two-paths between two corners are counted by
    the label of their middle and never paired: the middles of two labels, or of one label that has two, close cycles. What is
    read several times is written.
    """
    adj = scratch.put(g.adj.select("src", "dst", "ls", "ld", "w"))
    degree = adj.groupBy("src").agg(F.count("*").alias("n"))
    ranked = adj.join(degree, "src").join(degree.toDF("dst", "nd"), "dst").withColumn("up", F.struct("n", "src") < F.struct(F.col("nd").alias("n"), F.col("dst").alias("src")))
    up = ranked.where("up").select(F.col("src").alias("m"), F.col("ls").alias("lm"), F.col("dst").alias("h"), F.col("ld").alias("lh"), F.col("nd").alias("nh"), F.col("w").alias("wh"))
    other = ranked.select(F.col("src").alias("m"), F.col("dst").alias("o"), F.col("ld").alias("lo"), F.col("nd").alias("no"), F.col("w").alias("wo"))
    wedge = up.join(other, "m").where(F.struct(F.col("no").alias("n"), F.col("o").alias("v")) < F.struct(F.col("nh").alias("n"), F.col("h").alias("v")))
    wedge = scratch.put(wedge.select("h", "lh", "o", "lo", "m", "lm", F.least("wh", "wo").alias("w")))
    # the best and the second best two-path of each middle label
    first = wedge.groupBy("h", "lh", "o", "lo", "lm").agg(F.count("*").alias("n"), F.max(F.struct("w", "m")).alias("top"))
    second = wedge.join(first.select("h", "o", "lm", F.col("top.m").alias("best")), ["h", "o", "lm"]).where("m <> best").groupBy("h", "o", "lm").agg(F.max("w").alias("w2"))
    sides = first.join(second, ["h", "o", "lm"], "left").select("h", "lh", "o", "lo", "lm", "n", F.col("top.w").alias("w1"), "w2")
    x, y = sides.withColumnRenamed("lm", "l1").withColumnRenamed("n", "n1"), sides.select("h", "o", F.col("lm").alias("l3"), F.col("w1").alias("wy"))
    found = x.join(y, ["h", "o"]).where("l1 < l3 or (l1 = l3 and n1 >= 2)")
    found = found.select("h", "o", "lh", "l1", "lo", "l3", F.when(F.col("l1") == F.col("l3"), F.col("w2")).otherwise(F.least("w1", "wy")).alias("w"))
    ring, corner = ["l0", "l1", "l2", "l3"], ["lh", "l1", "lo", "l3"]
    least, turns = _read_ways(ring, corner)
    rows = scratch.put(found.select("h", "o", F.col("l1").alias("m1"), F.col("l3").alias("m3"), "w", least.alias("ring"), turns.alias("turns")))
    return wedge, rows, rows.groupBy("ring").agg(F.max("w").alias("max_w"))


def listed_cycles(g: Graph, min_sup: int) -> DataFrame:
    """four_cycles() of a graph whose two-paths are written."""
    return cycles_found(g, min_sup)


def cycles_found(g: Graph, min_sup: int) -> DataFrame:
    """The cycles of a graph or a part of it, from its two-paths, which are written."""
    ring = ["l0", "l1", "l2", "l3"]
    wedge, rows, best = cycle_weights(g, Scratch(g.adj.sparkSession, "cycles"))
    at = rows.select("h", "o", "m1", "m3", "ring", F.explode(F.array_distinct("turns")).alias("turn")).select("h", "o", "m1", "m3", "ring", F.posexplode("turn").alias("pos", "who"))
    ends = at.where("who in (0, 2)").select("ring", "pos", F.when(F.col("who") == 0, F.col("h")).otherwise(F.col("o")).alias("v"))
    middles = at.where("who in (1, 3)").select("ring", "pos", "h", "o", F.when(F.col("who") == 1, F.col("m1")).otherwise(F.col("m3")).alias("lm")).distinct()
    middles = middles.join(wedge.select("h", "o", "lm", F.col("m").alias("v")), ["h", "o", "lm"]).select("ring", "pos", "v")
    support = class_counts(g, ends.unionByName(middles), ["ring", "pos"], "v").groupBy("ring").agg(F.min("n").alias("mni")).where(F.col("mni") >= min_sup)
    return support.join(best, "ring").select(*[F.col(f"ring.{c}").alias(c) for c in ring], "mni", "max_w")


def three_stars(g: Graph, min_sup: int = 1) -> DataFrame:
    """Stars of three leaves: (lc, a, b, c, mni, max_w), a <= b <= c, for graphs of one edge label.

    Occurrences are never listed: a vertex is a centre exactly if it has as many neighbours of each leaf label as the
    star has leaves; its neighbours of these labels are the leaf images; and the r-th largest weight of each label
    gives the best occurrence. Centres of the same stars are of one kind, and leaves are gathered by kind and not by star, so that
    an edge is read once, however many stars it may be a leg of.
    """
    scratch = Scratch(g.adj.sparkSession, "stars")
    k = scratch.put(weight_profile(g))
    x, y, z = (k.select("src", *(["ls"] if m == "x" else []), F.col("ld").alias(f"{m}_ld"), F.col("cnt").alias(f"{m}_cnt"), F.col("ws").alias(f"{m}_ws")) for m in "xyz")
    rows = x.join(y, "src").where("x_ld <= y_ld").join(z, "src").where("y_ld <= z_ld")
    ry = F.when(F.col("y_ld") == F.col("x_ld"), 2).otherwise(1)
    rz = F.when(F.col("z_ld") == F.col("y_ld"), ry + 1).otherwise(1)
    rows = rows.where((F.col("y_cnt") >= ry) & (F.col("z_cnt") >= rz))
    best = F.least(F.get("x_ws", F.lit(0)), F.get("y_ws", ry - 1), F.get("z_ws", rz - 1))
    stars = rows.select("src", F.col("ls").alias("lc"), F.col("x_ld").alias("a"), F.col("y_ld").alias("b"), F.col("z_ld").alias("c"), best.alias("w"))
    keys = ["lc", "a", "b", "c"]
    centres = stars.groupBy(*keys).agg(F.count("*").alias("n"), F.max("w").alias("max_w")).where(F.col("n") >= min_sup)
    kept = stars.join(centres.select(*keys), keys, "left_semi").groupBy("src").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("stars"))
    kept = scratch.put(kept)
    kinds = scratch.put(kept.groupBy("stars").agg(F.min("src").alias("kind")))
    centre = scratch.put(kept.join(kinds, "stars").select("src", "kind"))
    if centre.count() <= SENT_CENTRES:
        centre = F.broadcast(centre)
    reached = g.adj.select("src", "ld", "dst").join(centre, "src").select("kind", "ld", "dst").distinct()
    images = reached.join(kinds, "kind").select("ld", "dst", F.inline("stars")).where("ld in (a, b, c)")
    low = bitmap_counts(images, [*keys, "ld"], "dst").groupBy(*keys).agg(F.min("n").alias("leaf"))
    return centres.join(low, keys).select(*keys, F.least("n", "leaf").alias("mni"), "max_w").where(F.col("mni") >= min_sup)


def heavy(g: Graph, least: float) -> Graph:
    """The graph of edges of at least so much; written on the adjacency, where it reaches the scan."""
    return Graph(g.vertices, g.edges.where(F.col("w") >= least), g.adj.where(F.col("w") >= least), twins=g.twins)


def heavy_ends(g: Graph, least: float) -> Graph:
    return Graph(g.vertices, g.edges, g.adj.where((F.col("ws") >= least) & (F.col("wd") >= least)), twins=g.twins)


def neighbour_profile(g: Graph) -> DataFrame:
    """(v, label, degree, nbrs): nbrs maps (neighbour label, edge label) to a count."""
    per = g.adj.groupBy(F.col("src").alias("v"), F.col("ls").alias("label"), "ld", "el").agg(F.count("*").alias("n"))
    return per.groupBy("v", "label").agg(F.sum("n").alias("degree"), F.map_from_entries(F.collect_list(F.struct(F.struct("ld", "el"), "n"))).alias("nbrs"))


def first_domains(g: Graph, p) -> DataFrame:
    """(pos, v): vertices of the position's label with its degree and, for each neighbour label and edge label, at
    least as many neighbours as the position has."""
    profile = neighbour_profile(g)
    fits = []
    for u in range(p.n_vertices):
        need: dict[tuple[int, int], int] = {}
        for v, el in p.links[u].items():
            need[(p.labels[v], el)] = need.get((p.labels[v], el), 0) + 1
        ok: list[Column] = [F.col("label") == p.labels[u], F.col("degree") >= p.degree(u)]
        for (lb, el), n in need.items():
            key = F.struct(F.lit(lb).cast("int").alias("ld"), F.lit(el).cast("int").alias("el"))
            ok.append(F.coalesce(F.try_element_at("nbrs", key), F.lit(0)) >= n)
        fits.append(F.when(reduce(lambda x, y: x & y, ok), F.lit(u)))
    return profile.select(F.explode(F.array_compact(F.array(*fits))).alias("pos"), "v")


def arc_consistent(g: Graph, p, domains: DataFrame, rounds: int | None = None) -> DataFrame:
    """Domains where each vertex has, along every pattern edge, a neighbour in the other end's domain. Stops when no
    domain shrinks or after so many rounds; any number of rounds is sound. A round is one join of all domains with the
    edges: a vertex stays if it is reached along as many of the pattern's arcs as its position has."""
    spark = g.adj.sparkSession
    arcs = [(u, v, el) for u, v, el in p.edges] + [(v, u, el) for u, v, el in p.edges]
    # a row per arc of the pattern
    wanted = F.broadcast(spark.createDataFrame([(k, *a, p.degree(a[0])) for k, a in enumerate(arcs)], "arc int, pos int, other int, el int, need long"))
    links = g.adj.select("src", "dst", "el")
    dom, done = domains.select(F.col("pos").cast("int").alias("pos"), "v").cache(), 0
    before = dom.count()
    while rounds is None or done < rounds:
        done += 1
        asked = dom.select(F.col("pos").alias("other"), F.col("v").alias("dst")).join(wanted, "other")
        reached = asked.join(links, ["dst", "el"]).groupBy("pos", F.col("src").alias("v")).agg(F.count_distinct("arc").alias("arcs"), F.first("need").alias("need"))
        kept = dom.join(reached.where("arcs = need").select("pos", "v"), ["pos", "v"], "left_semi").cache()
        now = kept.count()
        dom.unpersist()
        dom = kept
        if now == before:
            break
        before = now
    return dom


def inherited_domains(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The child's domains without vertices that its parent's reduced domains have lost; positions are kept by growth,
    and a position that the parent lacks stays as it is."""
    have = parent.select("pos").distinct()
    old = child.join(have, "pos", "left_semi").join(parent, ["pos", "v"], "left_semi")
    return old.unionByName(child.join(have, "pos", "left_anti"))


def ranked_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
