"""Scalar functions of graphs as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of cellular places and their labels, the first that is contained wins.
PLACES = (
    ("outer membrane", 4),
    ("periplasm", 3),
    ("plasma membrane", 2),
    ("inner membrane", 2),
    ("membrane", 2),
    ("cytosol", 1),
    ("cytoplasm", 1),
    ("intracellular", 1),
)
UNKNOWN_PLACE = 0
TRUST_SHIFT = 11


def nearest_label(raw: Column) -> Column:
    """Nearest whole number, halves upward (2.5 -> 3, -2.5 -> -2), as an edge label."""
    return F.floor(raw + 0.5).cast("int")


def constant_label(raw: Column) -> Column:
    return F.lit(0)


def same_weight(raw: Column) -> Column:
    return raw.cast("double")


def pair(u: Column, v: Column) -> list[Column]:
    """The key of an undirected pair."""
    return [F.least(u, v).alias("a"), F.greatest(u, v).alias("b")]


def triple(ls: Column, ld: Column, el: Column) -> list[Column]:
    return [F.least(ls, ld).alias("la"), F.greatest(ls, ld).alias("lb"), el.alias("el")]


def jaccard_percent(x: Column, y: Column) -> Column:
    """100 times shared over joint elements of two arrays; null arrays are empty, an empty union gives 0."""
    empty = F.array().cast("array<int>")
    x, y = F.coalesce(x, empty), F.coalesce(y, empty)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union * 100.0)


def shifted_trust(rating: Column) -> Column:
    return rating + TRUST_SHIFT


def quantile_label(rank_from_zero: Column, n: Column, buckets: int = 5) -> Column:
    """The bucket of a rank: floor(rank * buckets / n), which deals remainders otherwise than ntile."""
    return F.least(F.lit(buckets - 1), F.floor(rank_from_zero * buckets / n)).cast("int")


def priority_label(terms: Column, places: Sequence[tuple[str, int]] = PLACES, otherwise: int = UNKNOWN_PLACE) -> Column:
    """The label of the first keyword, in order of priority, that the lower-cased terms contain."""
    low = F.lower(F.coalesce(terms, F.lit("")))
    out = None
    for word, label in places:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return (F.lit(otherwise) if out is None else out.otherwise(otherwise)).cast("int")


def weight_model(strategy: Column) -> Column:
    return F.when(strategy.isin("edge", "lookup"), "edge").when(strategy == "vertex", "vertex").otherwise("none")


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x.cast("double"))


def weight_text(x: Column) -> Column:
    """A threshold as text; NaN and null give NA."""
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(x.cast("string"))


def pattern_text(labels: Column, edges: Column) -> Column:
    """v and e lines of a pattern from an array of labels and an array of (u, v, el)."""
    vs = F.transform(labels, lambda x, i: F.format_string("v %d %d\n", i, x))
    es = F.transform(edges, lambda e: F.format_string("e %d %d %d\n", e["u"], e["v"], e["el"]))
    return F.concat(F.array_join(vs, ""), F.array_join(es, ""))
