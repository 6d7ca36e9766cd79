"""Helpers shared by the corpus operators: tables, scratch storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Ready the session for Python tasks over texts: bound the rows in one Arrow batch, so
    that a batch of long texts fits a worker, and let workers import this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Only a session on this machine alone may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/routeloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder.

    Writing cuts the lineage: a lost executor costs a re-read, not a re-run. Tables
    stay until ``drop``: results read them lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The column as a string, null as empty."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))
