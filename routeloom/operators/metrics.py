"""Evaluation of predicted routes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.operators.decide import critical, true_row
from routeloom.operators.policy import COSTS, cost_table
from routeloom.vocab import ROUTES


def scored(df: DataFrame) -> DataFrame:
    """df (y, p, safety) with cost, eligible and missed."""
    eligible, missed = critical(F.col("y"), F.col("p"), F.col("safety"))
    df = df.withColumns({"true_row": true_row(F.col("y"), F.col("safety")), "eligible": eligible, "missed": missed})
    return df.join(F.broadcast(cost_table(df.sparkSession).withColumnRenamed("pred", "p")), ["true_row", "p"])


def in_subsets(df: DataFrame, subsets: dict[str, object]) -> DataFrame:
    """A row for each subset that a row belongs to; one pass, grouped once."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in subsets.items()]))
    return df.withColumn("subset", F.explode(names))


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """n of (by, y, p), at most 25 rows a group."""
    return df.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """precision, recall and F1 of each class present in truth or prediction; zero where undefined."""
    each = cells.select(*by, "n", (F.col("y") == F.col("p")).alias("hit"), F.explode(F.array(F.struct(F.col("y").alias("route"), F.lit(True).alias("truth")), F.struct(F.col("p").alias("route"), F.lit(False).alias("truth")))).alias("e")).select(*by, "n", "hit", "e.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = each.groupBy(*by, "route").agg(total(F.col("truth") & F.col("hit")).alias("tp"), total(F.col("truth")).alias("n_true"), total(~F.col("truth")).alias("n_pred"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_true")), "f1": ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))})


def cells_of(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """n of (by, y, p, safety): at most 50 rows a group."""
    return df.groupBy(*by, "y", "p", "safety").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def report(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """n, accuracy, swe, macro_f1, mcc and critical misses of each group of df (y, p, safety, and the
    number of rows each row stands for, if ``weight`` names it). Rows are read once, into cells, and each
    group's cells are summed once: every figure follows from the margins of the five routes. F1 is the mean
    over routes that occur; the correlation is 0 where undefined."""
    whole = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    # of each route: rows hit, rows that are it, rows predicted as it
    margins = [F.struct(whole((y == r) & (p == r)).cast("double").alias("tp"), whole(y == r).cast("double").alias("t"), whole(p == r).cast("double").alias("q")) for r in ROUTES]
    sums = scored(cells_of(df, by, weight)).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(n * F.col("cost")).alias("paid"), whole(F.col("missed")).alias("critical_misses"), whole(F.col("eligible")).alias("n_critical"), F.array(*margins).alias("m"),
    )
    add = lambda value: F.aggregate("m", F.lit(0.0), lambda a, m: a + value(m))
    seen = F.size(F.filter("m", lambda m: m["t"] + m["q"] > 0))
    f1 = add(lambda m: F.coalesce(F.try_divide(2 * m["tp"], m["t"] + m["q"]), F.lit(0.0))) / seen
    sums = sums.withColumns({"hits": add(lambda m: m["tp"]), "tq": add(lambda m: m["t"] * m["q"]), "tt": add(lambda m: m["t"] * m["t"]), "qq": add(lambda m: m["q"] * m["q"]), "f1": f1})
    den = F.sqrt(n * n.cast("double") - F.col("qq")) * F.sqrt(n * n.cast("double") - F.col("tt"))
    mcc_value = F.when(den > 0, (F.col("hits") * n - F.col("tq")) / den).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    return sums.select(
        *by, "n", r(F.col("hits") / n).alias("accuracy"), r(F.col("paid") / n).alias("swe"), r("f1").alias("macro_f1"), r(mcc_value).alias("mcc"), "critical_misses", "n_critical",
        r(F.try_divide(F.col("critical_misses").cast("double"), F.col("n_critical").cast("double"))).alias("critical_miss_rate"),
    )


#: Means below this are drawn by inverting the distribution, larger ones from a normal corrected for skew.
EXACT_MEAN, MOST_TERMS = 30, 120


def keyed_uniforms(*key: object) -> tuple[float, float]:
    """Two numbers strictly between 0 and 1 that follow from a key."""
    h = hashlib.md5("/".join(map(str, key)).encode()).hexdigest()
    return tuple((int(h[i : i + 13], 16) + 0.5) / 2**52 for i in (0, 13))


def binomial(m: np.ndarray, p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A draw of Binomial(m, p) for each pair of uniforms (u, v).

    The rarer side is drawn. With a mean below EXACT_MEAN it is the smallest k whose distribution
    reaches u; else u and v give a normal number z, and k = mean + z sd + (1 - 2p)(z^2 - 1) / 6, rounded."""
    q = min(p, 1 - p)
    if q == 0:
        few = np.zeros(len(m))
    else:
        m = m.astype(float)
        pmf = np.exp(m * math.log(1 - q))
        cdf, few = pmf.copy(), np.zeros(len(m))
        for _ in range(MOST_TERMS):
            more = cdf < u
            if not more.any():
                break
            pmf = np.where(more, pmf * (m - few) / (few + 1) * q / (1 - q), pmf)
            few, cdf = few + more, np.where(more, cdf + pmf, cdf)
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)
        many = np.floor(m * q + z * np.sqrt(m * q * (1 - q)) + (1 - 2 * q) * (z * z - 1) / 6 + 0.5)
        few = np.clip(np.where(m * q < EXACT_MEAN, few, many), 0, m)
    return (m - few if p > 0.5 else few).astype(np.int64)


def multinomial(counts: np.ndarray, n_boot: int, *key: object) -> np.ndarray:
    """n_boot rows of draws of as many rows as ``counts`` sums up to, cell by cell, each given those before."""
    uniforms = np.array([[keyed_uniforms(*key, b, i) for i in range(len(counts))] for b in range(n_boot)])
    out, left, weight = np.zeros((n_boot, len(counts)), np.int64), np.full(n_boot, counts.sum()), counts.sum()
    for i, n in enumerate(counts):
        out[:, i] = binomial(left, n / weight, uniforms[:, i, 0], uniforms[:, i, 1])
        left, weight = left - out[:, i], weight - n
    return out


def bootstrap(df: DataFrame, by: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """95% intervals of swe and macro_f1 from keyed multinomial draws over the at most 30 cells of a group:
    the work does not depend on the number of rows, and re-runs agree."""
    cells = scored(df).groupBy(by, "true_row", "p", "cost").agg(F.count("*").alias("n"))

    def intervals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["true_row", "p"])
        n = pdf["n"].to_numpy()
        draws = multinomial(n, n_boot, seed, pdf[by].iloc[0])
        swe = draws @ pdf["cost"].to_numpy() / n.sum()
        y = pdf["true_row"].str.replace("LOCAL_.*", "LOCAL", regex=True).to_numpy()
        p = pdf["p"].to_numpy()
        scores, seen = np.zeros(n_boot), np.zeros(n_boot)
        for r in ROUTES:
            both = draws[:, (y == r) & (p == r)].sum(axis=1)
            sides = draws[:, y == r].sum(axis=1) + draws[:, p == r].sum(axis=1)
            scores += np.where(sides > 0, 2 * both / np.maximum(sides, 1), 0)
            seen += sides > 0
        f1 = scores / np.maximum(seen, 1)
        q = lambda x: np.quantile(x, [0.025, 0.975])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "swe_low": [q(swe)[0]], "swe_high": [q(swe)[1]], "f1_low": [q(f1)[0]], "f1_high": [q(f1)[1]]})

    return cells.groupBy(by).applyInPandas(intervals, f"{by} string, swe_low double, swe_high double, f1_low double, f1_high double")


def class_weights(spark) -> DataFrame:
    """Mean cost of a wrong prediction by true route, LOCAL over its two rows, scaled to mean 1."""
    wrong = cost_table(spark, COSTS).withColumn("route", F.regexp_replace("true_row", "^LOCAL_.*$", "LOCAL")).where("route <> pred")
    raw = wrong.groupBy("route", "true_row").agg(F.avg("cost").alias("c")).groupBy("route").agg(F.avg("c").alias("w"))
    return raw.select("route", F.round(F.col("w") / F.avg("w").over(Window.partitionBy(F.lit(0))), 6).alias("weight"))


def join_predictions(rows: DataFrame, preds: DataFrame, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """(joined, problems): problems are prediction ids that repeat or match no row."""
    repeated = preds.groupBy(on).count().where("count > 1").select(F.lit("repeated").alias("problem"), on)
    unknown = preds.join(rows, on, "left_anti").select(F.lit("unknown").alias("problem"), on)
    return rows.join(preds, on), repeated.unionByName(unknown)


#: Tasks that ids are dealt to: as many as Spark writes rows for without holding them in memory.
DEALT = 200


def problem_counts(rows: DataFrame, preds: DataFrame, on: str = "id") -> DataFrame:
    """problem, n (as many as ``join_predictions`` has rows of it) and ids (how many ids those are).

    Rows and predictions meet in one grouping. They are dealt by id before anything is counted, so that no task holds the ids
    of a whole file, whatever its row groups, and an id is counted in one place alone, without a set of ids."""
    both = preds.select(on, F.lit(False).alias("row")).unionByName(rows.select(on, F.lit(True).alias("row")))
    each = both.repartition(DEALT, on).groupBy(on).agg(F.count_if(~F.col("row")).alias("m"), F.max("row").alias("known"))
    # a null id matches no row
    unknown = ~F.col("known") | F.col(on).isNull()
    kinds = {"repeated": F.when(F.col("m") > 1, F.lit(1).cast("long")), "unknown": F.when((F.col("m") > 0) & unknown, F.col("m"))}
    found = each.select(on, F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), n.alias("m")) for p, n in kinds.items()])).alias("e")).select(on, "e.*").where("m IS NOT NULL")
    return found.groupBy("problem").agg(F.sum("m").alias("n"), F.count(on).alias("ids"))


def joined(rows: DataFrame, preds: DataFrame, on: str = "id") -> DataFrame:
    """Rows that have a prediction, with it; ids that repeat or match no row end the job.

    The checks ride on the join itself: predictions are grouped by id, so one shuffle serves both, and a
    prediction that is wrong raises where its columns are made. rows: ``on`` is unique; its other columns must
    not be named as those of the predictions."""
    own = [c for c in preds.columns if c != on]
    once = preds.groupBy(on).agg(F.count("*").alias("_n"), F.first(F.struct(on, *own)).alias("_p"))
    held = once.join(rows.withColumn("_row", F.lit(True)), on, "left")
    text = F.coalesce(F.col(on).cast("string"), F.lit("null"))
    wrong = F.when(F.col("_n") > 1, F.concat(F.lit("more than one prediction for id "), text)).when(F.col("_row").isNull(), F.concat(F.lit("a prediction for an unknown id: "), text))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast(held.schema["_p"].dataType)).otherwise(F.col("_p"))
    made = held.withColumn("_p", checked)
    return made.select(F.col(f"_p.{on}").alias(on), *[c for c in rows.columns if c != on], *[F.col(f"_p.{c}").alias(c) for c in own])
