"""Numbers and places in a global order, without a task that sees all rows or all rows of a key.

Rows are dealt by sampled ranges of their order and written, so that everybody agrees on the ranges; the rows of each
range are counted, and the counts, a row per key and range, say where each range begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.scratch import Scratch


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows as a table of the shared folder, with the number of their range in _part. Equal rows of the order come into one
    range, so they should be few; the table stays, since lazy results read it."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    return Scratch(spark, "ranges").put(dealt.withColumn("_part", F.spark_partition_id()))


def numbered_by_range(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a column of numbers from 0 in this order, by which no two rows are equal."""
    placed = ranged(rows, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    return placed.join(starts, "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_before", "_part")


def picked(rows: DataFrame, keys: list[str], x: str, ranks: Column) -> DataFrame:
    """(keys, rank, x): of each key's values in rising order, those at these places. ranks: an array of places from 0, made of
    _n, the number of the key's rows.

    Values are counted first, so that many equal ones are one row; then only the ranges that hold a wanted place are sorted."""
    values = rows.groupBy(*keys, x).agg(F.count("*").alias("_times"))
    placed = ranged(values, [*keys, x])
    counts = placed.groupBy(*keys, "_part").agg(F.sum("_times").alias("_held"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_held").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_n", F.sum("_held").over(own))
    wanted = counts.withColumn("rank", F.explode(F.array_distinct(ranks))).where("rank >= _before and rank < _before + _held")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    hit = placed.alias("p").join(wanted.alias("w"), [F.col("p._part") == F.col("w._part"), *same]).select("p.*", "w.rank", "w._before")
    upto = F.col("_before") + F.sum("_times").over(Window.partitionBy(*keys, "_part", "rank").orderBy(F.col(x).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = hit.withColumn("_upto", upto).where("rank < _upto and rank >= _upto - _times")
    return found.select(*keys, "rank", x)
