"""The 288 contexts, route maps, flip profiles and balanced samples (SC15, J6, J7, A5, W2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.operators.decide import route_columns
from routeloom.operators.policy import Policy
from routeloom.vocab import CONNECTIVITY, PRIVACY, SPEEDS, TAGS, TIERS, WORKLOADS

CONTEXT = ["speed", "connectivity", "workload", "privacy", "passenger", "tier"]


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of fixed value lists: nested explodes of one row, no join."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return df


def contexts(spark: SparkSession) -> DataFrame:
    return grid(spark, dict(zip(CONTEXT, (SPEEDS, CONNECTIVITY, WORKLOADS, PRIVACY, [False, True], TIERS), strict=True)))


def tag_triples(spark: SparkSession) -> DataFrame:
    return grid(spark, {t: TAGS[t] for t in ("capability", "distraction", "actuation")} | {"sensitive": [False, True]})


def route_map(spark: SparkSession, policy: Policy | None = None) -> DataFrame:
    """Every tag triple, sensitive or not, in every context: 96 x 288 rows, whatever the data."""
    axes = {t: TAGS[t] for t in ("capability", "distraction", "actuation")} | {"sensitive": [False, True]}
    axes |= dict(zip(CONTEXT, (SPEEDS, CONNECTIVITY, WORKLOADS, PRIVACY, [False, True], TIERS), strict=True))
    return route_columns(grid(spark, axes), policy)


def flip_profile(mapped: DataFrame, by: list[str]) -> DataFrame:
    routes = F.collect_set("route")
    return mapped.groupBy(*by).agg(F.array_join(F.sort_array(routes), "+").alias("profile"), (F.size(routes) == 1).alias("context_invariant"))


def key(seed: str, *parts: Column) -> Column:
    """A random-looking number in [0, 2**32) that follows from its parts."""
    text = F.concat_ws("/", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sample_contexts(mapped: DataFrame, by: list[str], k: int = 3, seed: str = "0") -> DataFrame:
    """k contexts for each group: rare routes first, dealt round-robin; groups of one route uniformly.

    Route order is by -ln(u) * count ascending: weighted sampling without replacement.
    Position j inside a route, then the route's place: the first k of that order.
    """
    ident = [F.col(c) for c in by]
    u = (key(seed, *ident, F.col("route")) + 0.5) / float(1 << 32)
    place = mapped.groupBy(*by, "route").agg(F.count("*").alias("n")).withColumn("p", F.round(-F.log(u) * F.col("n"), 9)).select(*by, "route", "p")
    own = [F.col(c) for c in CONTEXT]
    draw = key(seed, *ident, *own)
    inside = Window.partitionBy(*by, "route").orderBy(draw, *own)
    deal = Window.partitionBy(*by).orderBy("j", "p", "route")
    dealt = mapped.withColumn("j", F.row_number().over(inside)).join(place, [*by, "route"])
    return dealt.withColumn("slot", F.row_number().over(deal)).where(F.col("slot") <= k).select(*by, "slot", *CONTEXT, "route")
