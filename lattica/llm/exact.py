"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SPACE, Scratch, row_key, rows_that_stay, table

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 256


def refine(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, single: bool = False) -> DataFrame:
    """One row per row of docs: id, row_key, n_chars, digest, keep_id, keep_key, group_size, kept.

    Texts are equal when identical without the characters of SPACE; a null text counts as empty. Of equal texts the
    row with the most code points stays, then the smallest id (null ids first), then, among rows that are alike in
    both, the least hash of the whole text. Rows repeated in all of these are all marked as kept; with single only
    the one of the least row number, which the scratch table holds, so that exactly one row of a group is kept.

    Pass 1 reads the texts and keeps lengths and prefix hashes. Rows are counted by length and prefix hash in one
    grouping: a pair that two rows share has a length that two rows share, so lengths need no table or join of their
    own, and a length that very many rows have is no task's. Pairs that one row alone has end there; only the rest is
    grouped by the full digest. Only narrow rows
    are shuffled, never a text. With digest_all the single rows get a digest too (a report may ask for it); without,
    the digest of rows that the first two steps settle is null and is never computed.

    A group may hold a third of all rows: every grouping is pre-aggregated before its shuffle, and the join that
    gives the rows their group is a left join that adaptive execution splits at a hot key. An empty table gives an
    empty result; other columns of docs, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).withColumn("norm", F.regexp_replace("t", SPACE + "+", ""))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    numbered = [F.monotonically_increasing_id().alias("row")] if single else []
    sizes = own.select("id", F.length("t").cast("long").alias("n_chars"), F.length("norm").cast("long").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"), F.xxhash64("t").alias("row_key"), *numbered, *([full.alias("digest")] if digest_all else []))
    sizes = scratch.put(sizes)
    by_prefix = sizes.groupBy("n", "prefix").agg(F.count("*").alias("same")).where("same > 1").select("n", "prefix")
    keys = ["n", "prefix"]
    alone = sizes.join(by_prefix, keys, "left_anti")
    if digest_all:
        left = sizes.join(by_prefix, keys, "left_semi")
    else:
        again = own.select("id", F.length("t").cast("long").alias("n_chars"), F.length("norm").cast("long").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"), F.xxhash64("t").alias("row_key"), *numbered, "norm")
        left = scratch.put(again.join(by_prefix, keys, "left_semi").select("id", "n_chars", "row_key", *(["row"] if single else []), full.alias("digest")))
        alone = alone.withColumn("digest", F.lit(None).cast("string"))
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("id").alias("i"), F.col("row_key").alias("k"), *([F.col("row").alias("r")] if single else []))
    groups = left.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    groups = groups.select("digest", "group_size", F.col("best.i").alias("keep_id"), F.col("best.k").alias("keep_key"), F.col("best.c").alias("keep_c"), *([F.col("best.r").alias("keep_row")] if single else []), F.lit(True).alias("grouped"))
    best = (-F.col("n_chars") == F.col("keep_c")) & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key"))
    if single:
        best = F.col("row") == F.col("keep_row")
    grouped = F.coalesce("grouped", F.lit(False))
    settled = left.join(groups, "digest", "left").select("id", "row_key", "n_chars", "digest", F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.when(grouped, F.col("keep_key")).otherwise(F.col("row_key")).alias("keep_key"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (~grouped | best).alias("kept"))
    # rows that the first two steps settle join nothing, so their missing digests never meet in one task
    return settled.unionByName(alone.select("id", "row_key", "n_chars", "digest", F.col("id").alias("keep_id"), F.col("row_key").alias("keep_key"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def drop_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated in id and text one stays."""
    found = refine(docs, scratch, id_col, text_col)
    decisions = found.select(row_key(F.col("id"), F.col("row_key")).alias("key"), "kept")
    return rows_that_stay(docs, row_key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), decisions, scratch)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refine(table(spark, sf_dir, "documents"), Scratch(spark, "exact"), digest_all=True, single=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS keep FROM d)
SELECT doc_id, keep AS keep_id, n AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""
