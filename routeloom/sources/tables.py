"""Readers with explicit schemas, writers, and the role each input table plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routeloom.operators.decide import ARRAY, route_columns
from routeloom.vocab import CONNECTIVITY, ROUTES, ROW, SPEEDS, TAGS, WORKLOADS

# Fixed values.
AUGMENT_SOURCES = ["synthetic_goal", "minimal_pair"]
DEFAULTS = {"source": "seed", "variant": "plain", "is_synthetic": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, below: int = 1 << 30) -> DataFrame:
    """A small source dealt over all cores: its file may be one row group, which only one task reads.
    Sources of ``below`` bytes or more have many and stay where they are, unshuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def in_splits(df: DataFrame, splits: str | list[str] | None) -> DataFrame:
    """Rows of the splits named, in a list or between commas; all of them for none or ``all``."""
    names = [s.strip() for s in splits.split(",") if s.strip()] if isinstance(splits, str) else splits
    return df if not names or names == ["all"] else df.where(F.col("split").isin(names))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fields that old records lack get their defaults."""
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def read_rows(spark: SparkSession, path: str, splits: str | list[str] | None = None, schema: StructType = ROW) -> DataFrame:
    """JSON lines or Parquet by suffix, a broken line fails (SC1, SC2, SC4)."""
    reader = spark.read.schema(schema)
    df = reader.option("mode", "FAILFAST").json(path) if path.endswith((".jsonl", ".json")) else reader.parquet(path)
    return in_splits(with_defaults(df), splits)


def records(rows: DataFrame, include_source: bool = True) -> DataFrame:
    """value: each row as one JSON text. Null fields are left out, and on a row that is no augmentation a false
    is_synthetic and, unless asked for, source and variant; read back, they have their defaults (P12)."""
    augmented = F.col("source").isin(AUGMENT_SOURCES)
    kept = {"is_synthetic": augmented | F.col("is_synthetic")} | ({} if include_source else {"source": augmented, "variant": augmented})
    return rows.select(F.to_json(F.struct(*[F.when(kept[c], F.col(c)).alias(c) if c in kept else F.col(c) for c in rows.columns])).alias("value"))


def from_records(lines: DataFrame, schema: StructType = ROW) -> DataFrame:
    """The rows of JSON texts; blank lines are none, a broken one fails (SC1, P12)."""
    texts = lines.where(F.trim("value") != "")
    return with_defaults(texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def with_intent_tags(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """Tags of the intent a row names; synthetic rows, and rows of no known intent, keep their own."""
    known = intents.select("intent", F.struct(*TAGS).alias("_of"))
    theirs = F.col("_of").isNotNull() & ~F.coalesce("is_synthetic", F.lit(False))
    return rows.join(known, "intent", "left").withColumns({t: F.when(theirs, F.col(f"_of.{t}")).otherwise(F.col(t)) for t in TAGS}).drop("_of")


def write_rows(df: DataFrame, path: str, by_split: bool = True) -> None:
    if path.endswith((".jsonl", ".json")):
        (records(df).write.text if {"source", "is_synthetic"} <= set(df.columns) else df.write.json)(path)
    elif by_split and "split" in df.columns:
        df.write.partitionBy("split").parquet(path)
    else:
        df.write.parquet(path)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests with a context and tags."""
    e, c = table(spark, sf_dir, "events"), F.col
    pick = lambda xs, i: F.element_at(ARRAY(xs), (i + 1).cast("int"))
    level = F.pmod(F.floor("value"), F.lit(3))
    return e.select(
        "event_id", pick(SPEEDS, c("user_id") % 4).alias("speed"), pick(CONNECTIVITY, c("event_id") % 3).alias("connectivity"), pick(WORKLOADS, level).alias("workload"),
        F.when(c("user_id") % 2 == 0, "standard").otherwise("strict").alias("privacy"), (c("event_id") % 2 == 1).alias("passenger"),
        F.when(c("user_id") % 3 == 0, "small").otherwise("tiny").alias("tier"), (c("event_id") % 7 == 0).alias("sensitive"),
        F.when(c("event_type") == "click", "local_ok").when(c("event_type") == "view", "cloud_preferred").when(c("event_type") == "signup", "needs_small_local").otherwise("needs_cloud").alias("capability"),
        F.when(c("event_id") % 5 == 0, "safety_critical").when(c("event_id") % 5 == 1, "restricted").when(c("event_id") % 5 == 2, "comfort").otherwise("none").alias("actuation"),
        F.when(c("value") < 5, "low").when(c("value") < 15, "medium").otherwise("high").alias("distraction"),
        F.when(c("user_id") % 5 == 0, "question").when(c("user_id") % 5 == 1, "indirect").otherwise("command").alias("style"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_columns(requests(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, y, p, safety, conf, split, ...): decided routes against a router that errs on two ids of eleven."""
    r = routed(spark, sf_dir)
    p = F.when(F.col("event_id") % 11 < 2, F.element_at(ARRAY(ROUTES), (F.col("event_id") % 5 + 1).cast("int"))).otherwise(F.col("route"))
    split = F.when(F.col("event_id") % 10 == 0, "test").when(F.col("event_id") % 10 == 1, "val").otherwise("train")
    return r.select("event_id", F.col("route").alias("y"), p.alias("p"), (F.col("actuation") == "safety_critical").alias("safety"), (F.col("k") / 100.0).alias("conf"), split.alias("split"), "sensitive", "capability", "distraction", "actuation")
