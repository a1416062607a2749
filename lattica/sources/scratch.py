"""Tables of a run in the shared folder that the session names, so that plans stay short and results outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables under spark.checkpoint.dir. Where that is unset, a session of one process uses its temporary folder, and
    one on a cluster fails: a folder of one machine would lose tables with an executor."""

    def __init__(self, spark: SparkSession, tag: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set; it names the shared folder for tables of a run")
        self.spark, self.n = spark, 0
        self.root = f"{(base or f'{tempfile.gettempdir()}/lattica').rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Deletes all tables; no result may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
