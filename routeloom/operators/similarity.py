"""Set-similarity joins over an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.text import rows_of
from routeloom.operators.blocks import nearest_by_blocks
from routeloom.operators.nearest import nearest


def best_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """The most similar ref of each id with any shared token, and how many they share; the smallest ref on ties."""
    return nearest_by_blocks(a, b, matched_only=True).select("id", "best.ref", "best.score", "best.shared")


def best_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ref whose tokens an id covers best, then the one that shares more, then the first; an id that
    shares none gets the first ref at 0. Refs without tokens take no part."""
    first = b.where(F.size("toks") > 0).agg(F.min("ref").alias("first"))
    found = nearest_by_blocks(a, b, kind="overlap", more_first=True)
    out = found.join(F.broadcast(first))  # one row
    return out.select("id", F.coalesce("best.ref", "first").alias("ref"), F.coalesce("best.score", F.lit(0.0)).alias("score"))


def drift(a: DataFrame, b: DataFrame, least: int = 2, often: int = 1000) -> DataFrame:
    """Ids that another intent's ref, with ``least`` tokens shared, covers better than any of their own does.
    a: id, intent, toks; b: ref, intent, toks."""
    alien = F.col("of") != F.col("intent")
    sets = {"own": ~alien, "other": alien & (F.col("shared") >= least)}
    best = nearest(a.select("id", "intent", "toks"), b.select("ref", F.col("intent").alias("of"), "toks"), sets, kind="overlap", often=often, matched_only=True, keep=["of"])
    own = F.coalesce("own.score", F.lit(0.0))
    return best.where(F.col("other.score") > own).select("id", "other.ref", "other.score", own.alias("own"), F.col("other.of").alias("closer"))


def near_in_group(df: DataFrame, group: str, pos: str, above: float = 0.6) -> DataFrame:
    """Pairs (first, second) of a group's rows whose word sets are alike, equal normal forms aside.
    df: group, pos, norm, toks; pos is unique in its group.

    Two sets alike by more than ``above`` share a word among the first n - ceil(above * n) + 1 of each in
    any common order; words go by rarity, so rows meet on a rare word of their group and a group of any
    size is spread over its words."""
    often = rows_of(df, w=F.col("toks")).groupBy("w").agg(F.count("*").alias("often"))
    words = rows_of(df, group, F.col(pos).alias("at"), F.size("toks").alias("n"), w=F.col("toks")).join(often, "w")
    rank = F.row_number().over(Window.partitionBy(group, "at").orderBy("often", "w"))
    prefix = words.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.lit(above) * F.col("n") - 1e-9) + 1)
    a = prefix.select(group, "w", F.col("at").alias("first"), F.col("n").alias("n1"))
    b = prefix.select(group, "w", F.col("at").alias("second"), F.col("n").alias("n2"))
    sizes = (F.col("n1") >= above * F.col("n2") - 1e-9) & (F.col("n2") >= above * F.col("n1") - 1e-9)
    met = a.join(b, [group, "w"]).where((F.col("first") < F.col("second")) & sizes).select(group, "first", "second").distinct()
    side = lambda name, i: df.select(group, F.col(pos).alias(name), F.col("norm").alias(f"norm{i}"), F.col("toks").alias(f"t{i}"))
    both = met.join(side("first", 1), [group, "first"]).join(side("second", 2), [group, "second"]).where("norm1 <> norm2")
    j = F.size(F.array_intersect("t1", "t2")).cast("double") / F.size(F.array_union("t1", "t2"))
    return both.withColumn("score", F.round(j, 9)).where(F.col("score") > above).select(group, "first", "second", "score")


def repeats(df: DataFrame, norm: str, order: str) -> DataFrame:
    """Rows whose normal form came before, with the row that had it first: a join on small per-form minima,
    so a form of any size is spread. Forms that stand alone are left out of the join."""
    first = df.groupBy(norm).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(first, norm).where(F.col(order) > F.col("first")).select(order, "first")
