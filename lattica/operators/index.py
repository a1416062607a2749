"""Aggregates of a graph that mining starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import triple
from lattica.sources.graph import Graph
from lattica.sources.ranks import picked


def label_counts(g: Graph) -> DataFrame:
    return g.vertices.groupBy("label").agg(F.count("*").alias("n"))


def frequent_labels(g: Graph, min_sup: int) -> DataFrame:
    return label_counts(g).where(F.col("n") >= min_sup)


def edge_triples(g: Graph) -> DataFrame:
    """Distinct (la, lb, el), la <= lb."""
    return g.adj.select(*triple(F.col("ls"), F.col("ld"), F.col("el"))).distinct()


def edge_labels(g: Graph) -> DataFrame:
    return g.edges.select("el").distinct()


def distinct_weights(g: Graph) -> DataFrame:
    return g.edges.select("w").distinct().orderBy(F.desc("w"))


def triple_max_weight(g: Graph) -> DataFrame:
    return g.adj.groupBy(*triple(F.col("ls"), F.col("ld"), F.col("el"))).agg(F.max("w").alias("max_w"))


def weighty_triples(g: Graph, least: float) -> DataFrame:
    """Triples of edges both of whose ends weigh at least so much."""
    return edge_triples(Graph(g.vertices, g.edges, g.adj.where((F.col("ws") >= least) & (F.col("wd") >= least))))


def degrees(g: Graph) -> DataFrame:
    """(id, degree), isolated vertices included."""
    d = g.adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def weight_grid(g: Graph, shares: list[float]) -> DataFrame:
    """(q, w): of the distinct weights in rising order, the one at floor(q * (n - 1))."""
    at = lambda q: F.floor(q * (F.col("_n") - 1)).cast("long")
    wanted = F.transform(F.array(*[F.lit(float(q)) for q in shares]), at)
    found = picked(g.edges.select("w").distinct(), [], "w", wanted)
    n = g.edges.select(F.count_distinct("w").alias("_n"))
    # one row, with an entry for each share
    asked = n.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), at(F.lit(float(q))).alias("rank")) for q in shares])).alias("a")).select("a.*")
    return found.join(asked, "rank").select("q", "w")


def upper_median(rows: DataFrame, keys: list[str], x: str, alias: str = "median") -> DataFrame:
    """(keys, median): sorted[n / 2] of each key's values that aren't null, without interpolation; a key without any has no
    row."""
    half = F.array(F.floor(F.col("_n") / 2).cast("long"))
    return picked(rows.where(F.col(x).isNotNull()), keys, x, half).select(*keys, F.col(x).alias(alias))


def graph_stats(g: Graph) -> DataFrame:
    v = g.vertices.agg(F.count("*").alias("n_vertices"), F.count_distinct("label").alias("n_labels"))
    e = g.edges.agg(F.count("*").alias("n_edges"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("sum_w"), F.coalesce(F.avg("w"), F.lit(0.0)).alias("mean_w"))
    return v.crossJoin(e)
