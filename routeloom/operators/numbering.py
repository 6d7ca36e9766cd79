"""Rows in a stable order with running numbers, and digests of what must not change.

The number of a row is its place within its range partition plus the rows of the partitions before: sorting stays
spread, and only one total a partition is summed up. A digest adds up a hash of every row, so it needs no order and
no sort; with the number in the hash it also tells rows that changed places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.operators.fills import with_paraphrases
from routeloom.sources.scratch import saved


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """The rows with ``name``, their place from 0 in the order of the columns; rows alike in these fall as they may."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    # one row a partition
    base = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = dealt.groupBy("_part").agg(F.count("*").alias("c")).select("_part", base.alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_place") - 1).drop("_part", "_base", "_place")


def row_hash(*columns: Column) -> Column:
    """60 bits of the columns' texts, null apart from empty."""
    texts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("decimal(38,0)")


def digest(rows: DataFrame, columns: list[str], below: int | None = None, number: str = "n") -> DataFrame:
    """One row (rows, digest): of the rows numbered below ``below``, or of all."""
    some = rows if below is None else rows.where(F.col(number) < below)
    return some.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_hash(F.col(number), *map(F.col, columns))), F.lit(0)).cast("string").alias("digest"))


def texts(seeds: DataFrame, lines: DataFrame, splits: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Every text of the seeds with its split, numbered: seeds in their order, each followed by its lines, then noise copies (O1).

    seeds: intent, seed_index, seed_id, text; lines: intent, seed_index, k, text, variant; splits: seed_id, split;
    copies: seed_id, k, copy, text."""
    told = with_paraphrases(seeds, lines, splits).withColumns({"source_order": F.when(F.col("source") == "seed", 0).otherwise(1), "copy": F.lit(-1)})
    if copies is not None:
        own = copies.join(seeds.select("seed_id", "intent", "seed_index"), "seed_id").join(splits.select("seed_id", "split"), "seed_id")
        told = told.unionByName(own.select("intent", "seed_index", "seed_id", F.col("k").cast("int").alias("k"), "text", F.lit("asr").alias("variant"), F.lit("asr").alias("source"), "split", F.lit(2).alias("source_order"), F.col("copy").cast("int").alias("copy")))
    return numbered(told, ["intent", "seed_index", "source_order", "k", "copy"]).drop("source_order")


def appended(rows: DataFrame, more: DataFrame, order: list[str], number: str = "n") -> DataFrame:
    """rows, then ``more`` numbered on from them in its own order: what was there keeps its number."""
    last = rows.agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("_from"))
    return rows.unionByName(numbered(more, order, number).join(F.broadcast(last)).withColumn(number, F.col(number) + F.col("_from")).select(*rows.columns))
