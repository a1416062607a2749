"""Shared pieces: table access, scratch storage, word expressions, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as 0. Needs no array of words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001")
    return F.length(F.regexp_replace(squeezed, SPACE, "")).cast("long")


class Scratch:
    """Parquet tables in the shared checkpoint folder, to cut lineage and keep results over lost executors.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session of one process (as in tests) uses
    a temporary folder, and one on a cluster fails: a folder of one machine would lose tables with an executor.
    """

    def __init__(self, spark: SparkSession, tag: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set; it names the shared folder for scratch tables")
        base = base or f"{tempfile.gettempdir()}/scratch-tables"
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table made by put() that no later result reads."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does once the driver has collected their objects.

    Python's come first, which hold the others and are handed over about a second later, some only at a second try.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark._jvm.System.gc()


#: Keys that are sent to every task, at most; of some 40 characters each, so under 10 MB.
SENT_KEYS = 100_000


def rows_that_stay(docs: DataFrame, key: Column, decisions: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs whose key the decisions (key, kept), a row for each of docs, keep; of rows of one key one.

    The verdict is reached in narrow tables, and the keys that go are written as one of their own and counted: they are
    sent to the tasks if there are few of them, and only else are texts shuffled.
    """
    keys = decisions.groupBy("key").agg(F.count("*").alias("n"), F.max("kept").alias("again"))
    gone = scratch.put(keys.where("not again or n > 1").select("key", "again"))
    if gone.count() <= SENT_KEYS:
        gone = F.broadcast(gone)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), key.alias("key"))
    out = packed.join(gone.select("key"), "key", "left_anti").select("doc")
    again = scratch.put(gone.where("again").select("key"))
    if not again.isEmpty():
        out = out.unionByName(packed.join(again, "key", "left_semi").dropDuplicates(["key"]).select("doc"))
    return out.select("doc.*")


def row_key(id_: Column, text_hash: Column) -> Column:
    """What tells rows of different ids or texts apart; a null id is none."""
    return F.concat_ws(":", text_hash.cast("string"), id_.cast("long").cast("string"))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternates two star contractions, as grouped minima and joins; each round is written to the scratch folder,
    so no lineage grows and nothing of the graph comes to the driver but a count and a checksum. Rounds, about as many as
    the logarithm of the nodes, go on until the edges are as before: each pair of contractions lowers some label. A node with very
    many links is one skewed join key, which adaptive execution splits; its minimum is pre-aggregated.
    """
    edges = scratch.put(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    nodes = scratch.put(edges.select("a").union(edges.select("b")).distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        following = scratch.put(small)
        scratch.drop(large)
        scratch.drop(edges)
        edges = following
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.select(F.col("a").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def map_rows(df: DataFrame, make, schema: str, rows: int = 2000, size: int = 16 << 20) -> DataFrame:
    """Arrow-batched map of each row of df to a tuple of schema, or to None to leave it out.

    make() runs once in a task and returns the function of a row's values. Batches go out after so many rows or so
    many characters of strings, so memory follows the longest row and not the batch.
    """
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        one, held, weight = make(), [], 0
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                got = one(*[c[i].as_py() for c in columns])
                if got is None:
                    continue
                held.append(got)
                weight += sum(len(x) for x in got if hasattr(x, "__len__"))
                if len(held) >= rows or weight >= size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
