"""Calibration of class scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.functions.text import softmax
from routeloom.operators.decide import critical

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)] + [0.96, 0.97, 0.98, 0.99]
GRID = [math.exp(math.log(0.05) + (math.log(20) - math.log(0.05)) * i / 199) for i in range(200)]


def with_probs(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """df (logits, y): probs, conf, pred (from 0, first on ties), correct, nll."""
    df = df.withColumn("probs", softmax(F.col("logits"), temperature)).withColumn("conf", F.array_max("probs"))
    df = df.withColumn("pred", (F.array_position("probs", F.col("conf")) - 1).cast("int"))
    return df.withColumns({"correct": F.col("pred") == F.col("y"), "nll": -F.log(F.greatest(F.get("probs", F.col("y")), F.lit(1e-12)))})


def ece_bins(df: DataFrame, bins: int = 15) -> DataFrame:
    """Rows, accuracy and confidence of each bin; the first bin is closed on both sides."""
    b = F.greatest(F.ceil(F.round(F.col("conf") * bins, 9)), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("conf").alias("confidence"))


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    b = ece_bins(df, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def temperature_scan(df: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Mean nll at every temperature of the grid. Each batch of rows gives its sums, one row; the
    logits of all rows have one length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            x = x - x.max(axis=1, keepdims=True)
            own = x[np.arange(b.num_rows), b.column(1).to_numpy()]
            nll = [np.minimum(np.log(np.exp(x / t).sum(axis=1)) - own / t, -math.log(1e-12)).sum() for t in grid]
            yield pa.RecordBatch.from_arrays([pa.array(grid, pa.float64()), pa.array(nll, pa.float64()), pa.array([b.num_rows] * len(grid), pa.int64())], names=["t", "nll", "n"])

    each = df.select(F.col("logits").cast("array<double>"), F.col("y").cast("int")).mapInArrow(sums, "t double, nll double, n long")
    return each.groupBy("t").agg((F.sum("nll") / F.sum("n")).alias("nll"))


def loss_slopes(df: DataFrame, beta: float) -> tuple[float, float]:
    """First and second derivative of the mean loss in beta, the inverse temperature: one aggregate."""
    x = F.col("x")
    weights = X.bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) * beta)))
    dot = lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    rows = df.select(F.col("logits").cast("array<double>").alias("x"), "y").withColumn("w", weights)
    rows = rows.withColumn("mean", dot(F.col("w"), x) / total(F.col("w"))).withColumn("square", dot(F.col("w"), F.transform(x, lambda v: v * v)) / total(F.col("w")))
    first, second = rows.agg(F.avg(F.col("mean") - F.get("x", F.col("y"))), F.avg(F.col("square") - F.col("mean") * F.col("mean"))).first()
    return first, second


def temperature(df: DataFrame, grid: list[float] = GRID, steps: int = 30, close: float = 1e-12) -> tuple[float, float, float]:
    """(temperature, loss, the grid's own temperature): the grid's best, then refined.

    The loss is convex in the inverse temperature. Newton steps, each one aggregate, at most halve or double it and
    stay inside the grid's range; they end when a step is ``close`` in proportion. The refined
    temperature counts if its loss, clipped like the grid's, is lower. No rows: temperature 1."""
    best = temperature_scan(df, grid).agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "t")).alias("m")).first()["m"]
    if best is None:
        return 1.0, 0.0, 1.0
    beta = 1 / best["t"]
    for _ in range(steps):
        first, second = loss_slopes(df, beta)
        if not second > 0:
            break
        new = min(max(beta - first / second, beta / 2, 1 / max(grid)), 2 * beta, 1 / min(grid))
        done, beta = abs(new - beta) <= close * beta, new
        if done:
            break
    loss = temperature_scan(df, [1 / beta]).first()["nll"]
    return (1 / beta, loss, best["t"]) if loss < best["nll"] else (best["t"], best["nll"], best["t"])


def threshold_scan(df: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """df (y, p, safety, conf): coverage, accuracy and critical misses of the rows at or above each threshold."""
    eligible, missed = critical(F.col("y"), F.col("p"), F.col("safety"))
    each = df.withColumns({"eligible": eligible, "missed": missed}).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    covered = F.col("conf") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.avg(covered.cast("double")).alias("coverage"), F.count_if(covered).alias("n_covered"),
        F.avg(F.when(covered, (F.col("y") == F.col("p")).cast("double"))).alias("accuracy"),
        F.count_if(covered & F.col("missed")).alias("critical_misses"), F.count_if(covered & F.col("eligible")).alias("n_critical"),
        F.count_if(~covered & (F.col("y") != F.col("p"))).alias("errors_avoided"), F.count_if(~covered & F.col("missed")).alias("critical_avoided"),
    )
