"""Scores of predictions in full (A15, A18, A19, A23, A37, P14, J17, P23, SC5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import metrics
from routeloom.operators.calibrate import THRESHOLDS
from routeloom.operators.decide import critical, route_columns, true_row
from routeloom.operators.policy import Policy, cost_table
from routeloom.vocab import DANGEROUS

CRITICAL_TARGET = 0.01


def of_splits(rows: DataFrame, preds: DataFrame, splits: list[str], on: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of some splits and the predictions that are theirs."""
    kept = rows.where(F.col("split").isin(splits))
    return kept, preds.join(kept.select(on), on, "left_semi")


def intent_scores(df: DataFrame) -> DataFrame:
    """df (split, intent, predicted): accuracy by split and over all (split null); no rows unless every
    prediction names an intent (A15)."""
    hit = (F.col("intent") == F.col("predicted")).cast("double")
    every = F.min(F.col("predicted").isNotNull()).alias("whole")
    each = df.rollup("split").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
    whole = df.agg(every)  # one row
    return each.join(F.broadcast(whole)).where("whole").select("split", "n", F.round("accuracy", 6).alias("accuracy"))


def rules_scores(df: DataFrame) -> DataFrame:
    """df (split, intent, predicted, is_synthetic, detected, sensitive): intent accuracy without synthetic rows,
    recall and precision of the detection, by split and over all (A19)."""
    rate = lambda cond, hit: F.round(F.avg(F.when(cond, hit.cast("double"))), 6)
    return df.rollup("split").agg(
        rate(~F.coalesce(F.col("is_synthetic"), F.lit(False)), F.col("intent") == F.col("predicted")).alias("intent_accuracy"),
        rate(F.col("sensitive"), F.col("detected")).alias("recall"), rate(F.col("detected"), F.col("sensitive")).alias("precision"),
    )


def tag_scores(df: DataFrame, tags: list[str], policy: Policy | None = None) -> DataFrame:
    """df (split, y, the context, each tag as true_<tag> and pred_<tag>, sensitive as predicted): for each tag, by split
    and over all, accuracy, macro-F1, errors, dangerous misses, and the errors that change the route, with
    the cost of those routes before and after that tag alone is mended (A18)."""
    routed = {"capability", "distraction", "actuation"}
    each = [
        F.struct(
            F.lit(t).alias("tag"), F.col(f"true_{t}").alias("t"), F.col(f"pred_{t}").alias("q"), (F.col(f"true_{t}").isin(DANGEROUS[t]) if DANGEROUS[t] else F.lit(False)).alias("at_risk"),
            (~F.col(f"pred_{t}").isin(DANGEROUS[t]) if DANGEROUS[t] else F.lit(False)).alias("harmless"), *[F.col(f"{'true' if t == x else 'pred'}_{x}").alias(x) for x in sorted(routed)],
        ) for t in tags
    ]
    base = route_columns(df.withColumns({x: F.col(f"pred_{x}") for x in routed}), policy).withColumnRenamed("route", "route_pred").drop("reason", "demand", *routed)
    fixed = route_columns(base.withColumn("e", F.explode(F.array(*each))).select("*", "e.*").drop("e"), policy)
    safety = F.col("true_actuation") == "safety_critical"
    fixed = fixed.withColumns({"true_row": true_row(F.col("y"), safety), "changes": (F.col("t") != F.col("q")) & (F.col("route") != F.col("route_pred"))})
    costs = lambda p, c: F.broadcast(cost_table(df.sparkSession).select("true_row", F.col("pred").alias(p), F.col("cost").alias(c)))
    priced = fixed.join(costs("route_pred", "before"), ["true_row", "route_pred"]).join(costs("route", "after"), ["true_row", "route"])
    # from here on: at most the pairs of a tag's values, by split
    cells = priced.groupBy("tag", "split", "t", "q", "at_risk", "harmless").agg(F.count("*").alias("n"), F.count_if("changes").alias("changing"), *[F.sum(F.when(F.col("changes"), F.col(c))).alias(c) for c in ("before", "after")])
    cells = cells.withColumn("split", F.explode(F.array("split", F.lit(None).cast("string"))))
    total = lambda c, cond=F.lit(True): F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    wrong, by = F.col("t") != F.col("q"), ["tag", "split"]
    sums = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), total("n", wrong).alias("errors"), total("n", F.col("at_risk")).alias("n_dangerous"), total("n", F.col("at_risk") & F.col("harmless")).alias("dangerous_misses"),
        F.sum("changing").alias("route_changing_errors"), total("before").alias("cost"), total("after").alias("cost_if_corrected"),
    )
    f1 = metrics.per_class(cells.select(F.col("tag"), F.coalesce("split", F.lit("")).alias("s"), F.col("t").alias("y"), F.col("q").alias("p"), "n"), ["tag", "s"]).groupBy("tag", "s").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    out = sums.withColumn("s", F.coalesce("split", F.lit(""))).join(f1, ["tag", "s"]).drop("s")
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return out.withColumns({"accuracy": ratio(F.col("n") - F.col("errors"), F.col("n")), "dangerous_miss_rate": ratio(F.col("dangerous_misses"), F.col("n_dangerous"))})


def threshold_table(df: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """df (y, p, safety, conf): at each threshold the covered rows' metrics and what asking again would hold
    back, with ``smallest``: the least threshold whose covered critical miss rate is below the target (A23)."""
    cuts = F.array(*map(F.lit, thresholds))
    # rows between two thresholds are alike: fold them first
    folded = df.withColumn("above", F.size(F.filter(cuts, lambda t: t <= F.col("conf")))).groupBy("y", "p", "safety", "above").agg(F.count("*").alias("m"))
    each = folded.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1)))).withColumns({"threshold": F.get(cuts, F.col("i")), "covered": F.col("above") > F.col("i")})
    covered = metrics.report(each.where("covered"), ["threshold"], weight="m")
    _, missed = critical(F.col("y"), F.col("p"), F.col("safety"))
    out = ~F.col("covered")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("m"))), F.lit(0))
    held = each.groupBy("threshold").agg(
        F.sum("m").alias("rows"), total(out).alias("n_clarify"), total(out & (F.col("y") != F.col("p"))).alias("errors_avoided"), total(out & missed).alias("critical_avoided"),
        total(out & F.col("safety") & (F.col("y") == "LOCAL")).alias("safety_delayed"), *[total(out & (F.col("y") == r)).alias(f"clarify_{r.lower()}") for r in metrics.ROUTES],
    )
    table = held.join(covered.withColumnRenamed("n", "n_covered"), "threshold", "left").fillna(0, ["n_covered", "critical_misses", "n_critical"])
    smallest = table.agg(F.min(F.when(F.col("critical_miss_rate") < CRITICAL_TARGET, F.col("threshold"))).alias("smallest"))  # one row
    return table.withColumn("coverage", F.round(F.col("n_covered") / F.col("rows"), 6)).drop("rows").join(F.broadcast(smallest))


def compared_runs(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A row for each stored score file under a path: run (the file's name) and the fields asked for, as JSON paths."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("run"), "value")
    return files.select("run", *[F.get_json_object("value", at).cast("double").alias(name) for name, at in fields.items()]).orderBy("run")


def has_all(df: DataFrame, column: Column) -> DataFrame:
    """Whether every prediction carries a block, as one row: only then is the block scored."""
    return df.agg(F.coalesce(F.min(column.isNotNull()), F.lit(False)).alias("whole"))
