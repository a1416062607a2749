"""The plain text graph format: t and # lines, v id label, e source target value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import constant_label, same_weight
from lattica.operators.pattern import Pattern
from lattica.sources.graph import Graph, make_graph, mean_weight, numbered

#: Weights that differ by more than this, on two directions of one edge, are in conflict.
SAME = 1e-9


@dataclass(frozen=True)
class Loaded:
    graph: Graph
    stats: DataFrame
    warnings: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, line) with numbers from 1 in the order of files and of lines in them.

    Files are read in splits; a line's number is its place in the split plus the lines of the splits before, of which
    there is one small row each.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("k"), "value")
    splits = raw.groupBy("f", "s").agg(F.count("*").alias("n"), F.min("k").alias("k0"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(splits.select("f", "s", (before - F.col("k0") + 1).alias("shift")), ["f", "s"])
    return placed.select((F.col("k") + F.col("shift")).cast("long").alias("no"), F.trim(F.regexp_replace("value", r"\s", " ")).alias("line"))


def preview(spark: SparkSession, path: str, n: int = 30) -> DataFrame:
    """The first lines as they are; only as much is read as they need."""
    return spark.read.text(path).withColumnRenamed("value", "line").limit(n).select((F.monotonically_increasing_id()).alias("no"), "line")


def read_patterns(spark: SparkSession, path: str, skip: int = 2) -> list[Pattern]:
    """Patterns stored as text: after so many first lines, blocks of v and e lines under a line "number:". A result has
    few patterns, so they come to the driver. An e line without a label has label 0."""
    lines = [r["line"] for r in numbered_lines(spark, path).where(F.col("no") > skip).orderBy("no").collect()]
    blocks: list[tuple[dict[int, int], list[tuple[int, int, int]]]] = []
    for line in lines:
        kind, *rest = line.split() or [""]
        if kind.endswith(":") and kind[:-1].isdigit():
            blocks.append(({}, []))
        elif kind == "v" and blocks:
            blocks[-1][0][int(rest[0])] = int(rest[1])
        elif kind == "e" and blocks:
            blocks[-1][1].append((int(rest[0]), int(rest[1]), int(float(rest[2])) if len(rest) > 2 else 0))
    out = []
    for labels, edges in blocks:
        at = {v: k for k, v in enumerate(sorted(labels))}
        out.append(Pattern.of([labels[v] for v in sorted(labels)], [(at[u], at[v], el) for u, v, el in edges]))
    return out


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared vertices (no, key, label) and edge lines (no, src, dst, raw); lines of other kinds are passed over.

    A v line of under 3 parts, an e line of under 4, or a part that is no number raises ValueError with the line.
    """
    parts = F.split("line", r"\s+")
    own = lines.where(F.length("line") > 0).withColumn("kind", F.substring("line", 1, 1)).where(F.col("kind").isin("v", "e")).withColumn("p", parts)
    number = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    own = own.select("no", "kind", "line", number(1, "int").alias("p1"), number(2, "int").alias("p2"), number(1, "double").alias("d1"), number(2, "double").alias("d2"), number(3, "double").alias("d3"))
    bad = own.where("(kind = 'v' and (p1 is null or p2 is null)) or (kind = 'e' and (d1 is null or d2 is null or d3 is null))").orderBy("no").first()
    if bad:
        raise ValueError(f"line {bad['no']} is malformed: {bad['line']}")
    vertices = own.where("kind = 'v'").select("no", F.col("p1").cast("long").alias("key"), F.col("p2").alias("label"))
    edges = own.where("kind = 'e'").select("no", F.col("d1").cast("long").alias("src"), F.col("d2").cast("long").alias("dst"), F.col("d3").alias("raw"))
    return vertices, edges


#: Line numbers of one part of the numbering.
LINES = 1 << 20


def dense_ids(declared: DataFrame) -> DataFrame:
    """(key, id, label): ids in order of first declaration; a key declared again keeps its place and takes the last
    label. Vertices are numbered within runs of lines, and runs by their counts, so no task sees all of them."""
    own = declared.groupBy("key").agg(F.min("no").alias("first"), F.max_by("label", "no").alias("label"))
    return numbered(own.withColumn("part", F.floor(F.col("first") / LINES)), "part", ["first"], "id").select("key", "id", "label")


def merge_edges(edges: DataFrame, weight: Callable[[Column], Column] = same_weight, edge_label: Callable[[Column], Column] = constant_label) -> DataFrame:
    """Every edge line (no, src, dst, raw) with what becomes of it: fate is kept, loop, parallel or reciprocal.

    Of the lines of an undirected pair the first stays. A line in the direction of an earlier one is parallel, and
    its weight isn't compared; the first in the other direction is reciprocal, and conflicts if the weights differ.
    """
    own = edges.withColumn("w", weight(F.col("raw")).cast("double")).withColumn("el", edge_label(F.col("raw")).cast("int"))
    own = own.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    by_pair = Window.partitionBy("a", "b").orderBy("no")
    by_direction = Window.partitionBy("a", "b", "src").orderBy("no")
    own = own.withColumn("nth", F.row_number().over(by_direction)).withColumn("any", F.row_number().over(by_pair)).withColumn("first_w", F.first("w").over(by_pair))
    fate = F.when(F.col("src") == F.col("dst"), "loop").when(F.col("nth") > 1, "parallel").when(F.col("any") > 1, "reciprocal").otherwise("kept")
    own = own.withColumn("fate", fate)
    return own.select("no", "src", "dst", "raw", "a", "b", "el", "w", "fate", ((F.col("fate") == "reciprocal") & (F.abs(F.col("w") - F.col("first_w")) > SAME)).alias("conflict"))


def load_stats(declared: DataFrame, ids: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of load counters."""
    is_ = lambda f: F.count_if(F.col("fate") == f)
    kept = F.when(F.col("fate") == "kept", F.col("w"))
    e = merged.agg(
        F.count("*").alias("edge_lines"), is_("kept").alias("n_edges"), is_("loop").alias("self_loops"), is_("parallel").alias("parallel_dropped"), is_("reciprocal").alias("reciprocal_merged"),
        F.count_if("conflict").alias("conflicting_weights"), F.count_if((F.col("fate") == "kept") & (F.col("w") <= 0)).alias("non_positive"),
        F.min(kept).alias("min_w"), F.max(kept).alias("max_w"), F.coalesce(F.sum(kept), F.lit(0.0)).alias("sum_w"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean_w"),
        F.array_sort(F.collect_set(F.when(F.col("fate") == "kept", F.col("el")))).alias("edge_labels"),
    )
    v = declared.agg(F.array_sort(F.collect_set("label")).alias("vertex_labels"))
    i = ids.agg(F.count("*").alias("n_vertices"), F.coalesce(F.bool_or(F.col("key") != F.col("id")), F.lit(False)).alias("ids_remapped"))
    return i.crossJoin(v).crossJoin(e)


def load_warnings(merged: DataFrame) -> DataFrame:
    """(no, message) of self-loops, conflicts and weights that aren't positive."""
    text = (
        F.when(F.col("fate") == "loop", F.format_string("self-loop at %d skipped", "src"))
        .when(F.col("conflict"), F.format_string("edge %d-%d: the two directions differ in weight", "a", "b"))
        .when((F.col("fate") == "kept") & (F.col("w") <= 0), F.format_string("edge %d-%d: weight is not positive", "a", "b"))
    )
    return merged.select("no", text.alias("message")).where("message is not null")


def read_lg(spark: SparkSession, path: str, weight=same_weight, edge_label=constant_label, assign=mean_weight) -> Loaded:
    """A graph with its counters and warnings. An edge of an undeclared vertex raises ValueError."""
    declared, lines = parse(numbered_lines(spark, path))
    ids = dense_ids(declared).cache()
    merged = merge_edges(lines, weight, edge_label).cache()
    s, d = ids.select(F.col("key").alias("src"), F.col("id").alias("si")), ids.select(F.col("key").alias("dst"), F.col("id").alias("di"))
    known = merged.join(s, "src", "left").join(d, "dst", "left")
    lost = known.where("si is null or di is null").orderBy("no").first()
    if lost:
        raise ValueError(f"line {lost['no']}: edge of an undeclared vertex")
    edges = known.where("fate = 'kept'").select(F.least("si", "di").alias("a"), F.greatest("si", "di").alias("b"), "el", "w")
    return Loaded(make_graph(ids.select("id", "label"), edges, assign), load_stats(declared, ids, merged), load_warnings(merged))


def write_lg(graph: Graph, path: str) -> None:
    """v lines, then e lines, as text files whose names are in that order."""
    v = graph.vertices.orderBy("id").select(F.format_string("v %d %d", "id", "label").alias("value"))
    e = graph.edges.orderBy("a", "b").select(F.concat(F.format_string("e %d %d ", "a", "b"), F.col("w").cast("string")).alias("value"))
    v.write.text(f"{path}/1-vertices")
    e.write.text(f"{path}/2-edges")
