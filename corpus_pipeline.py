"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing and encoding of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact, mixing, pieces, quality, simhash
from lattica.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the trees reject."""
    return quality.keep_good(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays."""
    return exact.drop_copies(docs, Scratch(spark, "exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs, Scratch(spark, "simhash"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target takes them."""
    return mixing.curriculum(docs, Scratch(spark, "mixing"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids, spans and decoded text, and with train_file and train_row, by
    which the rows sort into the training order that the mixing wrote them in."""
    return pieces.encoding_digests(mixing.in_training_order(docs, ("doc_id", "text")), with_ids=True, carried=("train_file", "train_row"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Trees, SimHash and the tokenizer are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
