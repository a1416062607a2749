"""Mixing sources to target weights by a time-varying curriculum.

Each source has a demand target and a weight schedule over training time. The schedule's integral, scaled to the
target, is the source's cumulative token demand; inverting it at a document's token offset within its source gives
the document's training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, n_words, partitions, table

WEIGHTS = (5, 2, 1)
#: A source's target, and so any document, stops at so many times its size.
MOST_REPEATS = 3
#: Slopes of the weight schedules over training time, repeating with the weights: at time t in [0, 1] a source's
#: share runs as 1 + slope * (2 t - 1), so heavy sources start strong and the light ones come in late.
SLOPES = (-0.5, 0.0, 0.5)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, rank, weight, source_size, target) from rows (source, source_size), one per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; a target stops
    at `most` times its source's size and the excess is shared anew by weight. The fixpoint is found in one pass:
    in order of cap / weight, sources are capped as long as their cap is under the level that the others then get.
    The table has a row per source, so its windows are over an aggregate, not over documents.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("long"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward).cast("double")
    # The first source, in this order, whose cap is not under the level sets the level for itself and all after it.
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("cap").cast("double") >= F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(everything)["level"]
    target = F.when(final.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), final * F.col("weight")))
    return leveled.select("source", "rank", "weight", "source_size", target.alias("target"))


def demand_time(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which the integral of 1 + slope * (2 t - 1) reaches share: slope t^2 + (1 - slope) t = share."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * share))
    return F.when(slope == 0, share).otherwise(2 * share / ((1 - slope) + root))


def plan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """One row per row of docs: id, row_key, size, source, source_size, target, taken, offset, times.

    size is the number of words (null text: 0). Within a source, documents stand in order of the MD5 of their id and
    are read over and over until the target is reached, so taken is size times the whole rounds, plus what the last
    round still takes; the last round ends inside one document, whose share is counted to the word. times has the
    training time in [0, 1] of each copy's first word. A source without words takes none. Rows of equal id stand in
    order of size and then of row_key, a hash of the text. An empty table gives an empty result; other columns are not read.

    A source may hold a third of all rows: its rows are split by the first three hexadecimal digits of the MD5 into
    4,096 buckets, whose sums (a row per source and bucket, not per document) give each bucket its start. Only
    narrow rows are shuffled.
    """
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _row_key(text_col).alias("row_key"), key.alias("key"))
    rows = scratch.put(rows.withColumn("bucket", F.substring("key", 1, 3)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    begin = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.put(buckets.select("source", "bucket", "words", begin.alias("begin")))
    per_source = targets(starts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), ((F.col("rank") - 1) % len(slopes) + 1).cast("int"))
    per_source = per_source.withColumn("slope", slope).withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = per_source.withColumn("rest", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    known = starts.alias("b").join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.bucket", "b.begin", "s.source_size", "s.target", "s.slope", "s.rounds", "s.rest")
    r, k = rows.alias("r"), known.alias("k")
    own = r.join(k, F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.bucket") == F.col("k.bucket"))).select("r.id", "r.row_key", "r.source", "r.size", "r.key", "r.bucket", *[f"k.{c}" for c in ("begin", "source_size", "target", "slope", "rounds", "rest")])
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("offset", F.col("begin") + inside - F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset")))
    own = own.withColumn("taken", (F.col("rounds") * F.col("size") + last).cast("long"))
    copies = F.col("rounds") + F.when(last > 0, 1).otherwise(0)
    at = lambda i: demand_time(F.least(F.lit(1.0), (i * F.col("source_size") + F.col("offset")) / F.col("target")), F.col("slope"))
    times = F.when((F.col("target") > 0) & (copies > 0), F.transform(F.sequence(F.lit(0), (copies - 1).cast("int")), at)).otherwise(F.array().cast("array<double>"))
    return own.select("id", "row_key", "size", "source", "source_size", "target", "taken", "offset", times.alias("times"))


def _row_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _decision_key(size: Column, source: Column, id_: Column, row_key: Column) -> Column:
    """What rows share that share a decision; nulls are told from values."""
    return F.concat_ws(":", size, row_key, F.coalesce(id_.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))


def curriculum(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents in training order, with all their columns: each as often as the plan takes it.

    Documents are not cut: the one in which a source's last round ends comes whole if the round takes half of it or
    more, else not at all. Documents without words are not taken. Rows repeated in id, source and text share the
    decision of the first of them. Rows come range-sorted by position, so the order of files, and of rows in them, is
    the training order; in_training_order() reads it back.
    """
    p = plan(docs, scratch, id_col, text_col, source_col, **options)
    whole = F.floor((F.col("taken") + F.floor((F.col("size") - 1) / 2)) / F.col("size")).cast("int")
    key = _decision_key(F.col("size"), F.col("source"), F.col("id"), F.col("row_key"))
    p = p.where("size > 0").select(key.alias("_mix_key"), "offset", F.slice("times", F.lit(1), whole).alias("times"))
    p = p.groupBy("_mix_key").agg(F.min(F.struct("offset", "times")).alias("first")).select("_mix_key", F.col("first.times").alias("_mix_times")).where(F.size("_mix_times") > 0)
    own = _decision_key(n_words(F.col(text_col)), F.col(source_col).cast("string"), F.col(id_col).cast("long"), _row_key(text_col))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), own.alias("_mix_key"))
    out = packed.join(p, "_mix_key").select("doc", "_mix_key", F.explode("_mix_times").alias("_mix_time"))
    return out.repartitionByRange(partitions(docs.sparkSession), "_mix_time", "_mix_key").sortWithinPartitions("_mix_time", "_mix_key").select("doc.*")


def in_training_order(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows (the given columns of them, or all) with two more columns, train_file and train_row, which sort them as they
    were written: the number in the name of a row's file and its place in it. Columns of docs with these names give way. Rows
    must come from files of numbered parts; else this fails, since their order is unknown. Any other names of columns do."""
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("train_file", "train_row")]
    try:
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), *[docs.metadataColumn("_metadata")[field].alias(name) for field, name in (("file_name", "name"), ("row_index", "place"))])
    except AnalysisException as unknown:
        raise ValueError("rows don't come from files, so that their order is unknown") from unknown
    number = F.regexp_extract("name", r"^part-(\d+)", 1)
    known = F.when(number != "", number.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a numbered part: "), "name")).cast("long"))
    return packed.select("doc.*", known.alias("train_file"), F.col("place").alias("train_row"))


#: Training positions are reported as whole parts of the run, so many to the whole.
POSITIONS = 1_000_000_000


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, position_2 and position_3 are the times of a document's copies, -1 for a copy that isn't taken; rows
    come range-sorted by the first."""
    p = plan(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))
    at = [F.coalesce(F.floor(F.get("times", F.lit(k)) * POSITIONS), F.lit(-1)).cast("long") for k in range(MOST_REPEATS)]
    p = p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", at[0].alias("position"), at[1].alias("position_2"), at[2].alias("position_3"))
    return p.repartitionByRange(partitions(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT level FROM l WHERE cap::DOUBLE >= level * weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, CASE (rank - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope, CASE WHEN (SELECT level FROM f) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT level FROM f) * weight) END AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS rounds,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, greatest(0, least(size, round(target - rounds * source_size)::BIGINT - begins)) AS rest FROM o),
q AS (SELECT *, CASE WHEN target > 0 THEN rounds + (rest > 0)::BIGINT ELSE 0 END AS copies FROM n),
c AS (SELECT *, least(1.0, begins::DOUBLE / target) AS s1, least(1.0, (source_size + begins)::DOUBLE / target) AS s2,
             least(1.0, (2 * source_size + begins)::DOUBLE / target) AS s3 FROM q)
SELECT doc_id, size, source_size, target, (rounds * size + rest)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN floor((CASE WHEN slope = 0 THEN s1 ELSE 2 * s1 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * s1)) END) * 1e9)::BIGINT ELSE -1 END AS position,
       CASE WHEN copies > 1 THEN floor((CASE WHEN slope = 0 THEN s2 ELSE 2 * s2 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * s2)) END) * 1e9)::BIGINT ELSE -1 END AS position_2,
       CASE WHEN copies > 2 THEN floor((CASE WHEN slope = 0 THEN s3 ELSE 2 * s3 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * s3)) END) * 1e9)::BIGINT ELSE -1 END AS position_3
FROM c
"""
