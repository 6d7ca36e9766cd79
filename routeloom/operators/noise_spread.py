"""Noise copies spread over a seed's plain lines.

A seed's lines are put in a keyed order and walked in turns; try ``t`` takes the line at ``t`` modulo their number.
A try that changes nothing, or whose normal form is known, gives nothing. Tries go in rounds of whole turns, twice as
many each round: tries of open seeds are drawn, forms known or drawn before are left out by an anti join, and the
first tries that a seed still needs are kept. Rounds end when no seed is open or the limit is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.noise import misheard
from routeloom.functions.text import normalize
from routeloom.sources.scratch import saved


def spread(lines: DataFrame, avoid: DataFrame, n: int, *, tries: int = 3, seed: str = "0") -> DataFrame:
    """seed_id, k, copy (from 0, by line), try, text: at most ``n`` noise copies of each seed's lines, with distinct normal forms.

    lines: seed_id, k, text, one row a place; avoid: seed_id, text that must not come again. A seed takes at
    most tries * n turns over its lines."""
    order = Window.partitionBy("seed_id").orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col("seed_id").cast("string"), F.col("k").cast("string"))), "k")
    held = lines.select("seed_id", "k", "text").withColumn("turn", (F.row_number().over(order) - 1).cast("long"))
    sizes = held.groupBy("seed_id").agg(F.count("*").alias("size"))
    held = saved(held.join(sizes, "seed_id"), "lines")
    seen = saved(avoid.select("seed_id", normalize(F.col("text")).alias("norm")).distinct(), "avoid")
    kept = held.limit(0).select("seed_id", "k", F.lit(0).cast("long").alias("try"), "text", F.lit("").alias("norm"))
    start, turns, limit = 0, 1, tries * n
    while start < limit:
        stop = min(start + turns, limit)
        have = kept.groupBy("seed_id").agg(F.count("*").alias("have"))
        open_ = held.join(have, "seed_id", "left").fillna(0, ["have"]).where(F.col("have") < n)
        if not open_.limit(1).count():
            break
        drawn = open_.withColumn("pass", F.explode(F.sequence(F.lit(start), F.lit(stop - 1)).cast("array<long>"))).withColumn("try", F.col("pass") * F.col("size") + F.col("turn"))
        key = F.concat_ws("/", F.col("seed_id").cast("string"), F.col("try").cast("string"))
        heard = drawn.withColumn("text", misheard(F.col("text"), key, seed)).where("text IS NOT NULL").withColumn("norm", normalize(F.col("text")))
        first = heard.groupBy("seed_id", "have", "norm").agg(F.min(F.struct("try", "k", "text")).alias("m")).join(seen, ["seed_id", "norm"], "left_anti")
        first = first.join(kept.select("seed_id", "norm"), ["seed_id", "norm"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("m.try"))
        new = first.withColumn("r", rank).where(F.col("r") <= n - F.col("have")).select("seed_id", "m.k", "m.try", "m.text", "norm")
        kept = saved(kept.unionByName(new), "copies")
        start, turns = stop, 2 * turns
    copy = F.row_number().over(Window.partitionBy("seed_id", "k").orderBy("try")) - 1
    return kept.select("seed_id", "k", copy.alias("copy"), "try", "text")
