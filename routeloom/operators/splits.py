"""Deterministic splits and samples by hash keys (W1, O2, SC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign(df: DataFrame, *, seed: str = "0", test: float = 0.1, val: float = 0.1, min_train: int = 2) -> DataFrame:
    """df (id, intent, grp): a split each. Inside a group the first eligible ids by key are test, the next val;
    an intent keeps at least min_train for train."""
    df = df.withColumn("k", F.md5(F.concat_ws("/", F.lit(seed), F.col("id").cast("string"))))
    own = Window.partitionBy("grp", "intent").orderBy(F.desc("k"), F.desc("id"))
    ranked = df.withColumn("eligible", F.row_number().over(own) > min_train).withColumn("bucket", F.substring("k", 1, 3))
    # a group of any size is ranked bucket by bucket of the key, on top of the counts of the buckets before
    counts = ranked.groupBy("grp", "bucket").agg(F.count_if("eligible").alias("own"), F.count("*").alias("all"))
    before = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("all").over(Window.partitionBy("grp")).alias("g"))
    inside = Window.partitionBy("grp", "bucket").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.join(counts, ["grp", "bucket"]).withColumn("e", F.col("base") + F.sum(F.col("eligible").cast("int")).over(inside))
    want = lambda share: F.greatest(F.lit(1), F.bround(F.col("g") * F.lit(share), 0).cast("int"))
    ranked = ranked.withColumns({"wt": want(test), "wv": want(val)})
    split = F.when(F.col("eligible") & (F.col("e") <= F.col("wt")), "test").when(F.col("eligible") & (F.col("e") <= F.col("wt") + F.col("wv")), "val").otherwise("train")
    return ranked.select("id", "grp", "intent", split.alias("split"))


def sample(df: DataFrame, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """n rows by key order."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string"))), id_col).limit(n)
