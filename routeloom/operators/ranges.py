"""Joins of intervals in rows of their own.

Every interval stands in the bins it touches, and intervals meet by key and bin: a join on equal keys, never on the
document alone, so a document with very many intervals is spread over its bins. A pair that shares
several bins is reported by the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, width: int) -> DataFrame:
    """Rows once for each bin they touch; empty intervals touch none."""
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return df.where("start < end").withColumns({"first_bin": first, "bin": F.explode(F.sequence(first, last))})


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs of half-open intervals of one key that share a place: key, a and b (structs of each side's columns).

    a, b: key, start, end and any other columns. width: about the longest usual interval; longer ones are right too,
    and take a row for each bin."""
    left = _binned(a, width).select(key, "bin", F.col("first_bin").alias("fa"), F.struct(*[c for c in a.columns if c != key]).alias("a"))
    right = _binned(b, width).select(key, "bin", F.col("first_bin").alias("fb"), F.struct(*[c for c in b.columns if c != key]).alias("b"))
    met = left.join(right, [key, "bin"]).where((F.col("bin") == F.greatest("fa", "fb")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")))
    return met.select(key, "a", "b")


def first_hits(tokens: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """tokens (key, pos, start, end) with the first span (key, start, end, label) each overlaps: key, pos, span_start, label."""
    order = F.struct(F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.label").alias("label"))
    hits = overlapping(tokens.select(key, "start", "end", "pos"), spans.select(key, "start", "end", "label"), key, width)
    return hits.groupBy(key, F.col("a.pos").alias("pos")).agg(F.min(order).alias("s")).select(key, "pos", F.col("s.start").alias("span_start"), F.col("s.label").alias("label"))


def tagged(tokens: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """key, pos, tag of every token that a span touches: B- where its span begins among the tokens, I- after (T18 over rows)."""
    hits = first_hits(tokens, spans, key, width)
    begins: Column = F.row_number().over(Window.partitionBy(key, "span_start", "label").orderBy("pos")) == 1
    return hits.select(key, "pos", F.concat(F.when(begins, "B-").otherwise("I-"), "label").alias("tag"))
