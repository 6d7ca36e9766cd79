"""The decision tree on a stream: it is per record, so the batch expression runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.decide import route_columns


def route_stream(requests: DataFrame) -> DataFrame:
    return route_columns(requests)


def counts_by_window(routed: DataFrame, time_col: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Routes counted in tumbling windows; ``time_col`` may be a zone-less timestamp."""
    return routed.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, length), "route").agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, folder: str, schema, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
