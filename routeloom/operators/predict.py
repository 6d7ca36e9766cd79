"""Prediction records from model outputs, and a model over hashed words that gives such outputs (M5).

What follows the logits is column expressions: probabilities, the calibrated confidence, the three likeliest
intents, spans of tagged pieces, tags decoded with care, and the routes by model, by tags and combined. The model is an ML
pipeline, trained and applied by Spark; rows may be weighted by class.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.encode import label_index, spans_from_tags
from routeloom.functions.text import softmax
from routeloom.operators.decide import ARRAY, argmax_name, combine, decode_actuation, decode_distraction, route_columns
from routeloom.operators.policy import Policy
from routeloom.vocab import ROUTES, TAGS

SOURCES = ["e2e", "tags", "combined"]


def _rounded(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.round(p, 6))


def top(probs: Column, names: list[str], n: int = 3) -> Column:
    """(name, p) of the n likeliest, the earlier name first on ties."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: F.struct(F.element_at(ARRAY(names), s["i"] + 1).alias("intent"), F.round(-s["minus"], 6).alias("p")))


def decoded_tags(probs: dict[str, Column], conservative: bool = True) -> dict[str, Column]:
    """A value for each tag: the likeliest, or with care the dangerous one from its threshold on."""
    careful = {"actuation": decode_actuation, "distraction": decode_distraction} if conservative else {}
    return {t: careful[t](p) if t in careful else argmax_name(p, TAGS[t]) for t, p in probs.items()}


def record(outputs: DataFrame, intents: list[str], *, temperature: float | None = None, route_source: str = "e2e", conservative: bool = True, policy: Policy | None = None) -> DataFrame:
    """Predictions of outputs (id, the context, utterance, offsets, piece_tags, route_logits, intent_logits and, for all tags or none, <tag>_logits).

    id, route, route_probs, intent, intent_probs_top3, spans, confidence and, with tags, tags, tag_probs and the routes by
    source; ``route_source`` says which of them is ``route``. The confidence alone is tempered."""
    tags = [t for t in TAGS if f"{t}_logits" in outputs.columns]
    if route_source not in SOURCES:
        raise ValueError(f"route_source must be one of {SOURCES}: {route_source}")
    if route_source != "e2e" and not tags:
        raise ValueError(f"route_source {route_source} needs tag logits")
    df = outputs.withColumns({"_route": softmax(F.col("route_logits")), "_intent": softmax(F.col("intent_logits")), "_sure": F.array_max(softmax(F.col("route_logits"), temperature or 1.0)), **{f"_{t}": _rounded(softmax(F.col(f"{t}_logits"))) for t in tags}})
    df = df.withColumns({
        "route_e2e": argmax_name(F.col("_route"), ROUTES), "route_probs": _rounded(F.col("_route")), "intent_probs_top3": top(F.col("_intent"), intents), "confidence": F.round("_sure", 6),
        "spans": spans_from_tags(F.col("offsets"), F.col("piece_tags"), F.col("utterance")),
    })
    df = df.withColumn("intent", F.get("intent_probs_top3", F.lit(0))["intent"])
    base = ["id", "route", "route_probs", "intent", "intent_probs_top3", "spans", "confidence"]
    if not tags:
        return df.withColumn("route", F.col("route_e2e")).select(*base)
    decoded = df.withColumns({**decoded_tags({t: F.col(f"_{t}") for t in tags}, conservative), "sensitive": F.size("spans") > 0})
    routed = route_columns(decoded, policy).withColumnRenamed("route", "route_tags").withColumn("route_combined", combine(F.col("route_e2e"), F.col("route_tags"), F.col("actuation")))
    named = lambda pairs: F.create_map(*[x for t, v in pairs for x in (F.lit(t), v)])
    probs = {t: F.map_from_arrays(ARRAY(TAGS[t]), F.col(f"_{t}")) for t in tags}
    made = routed.withColumns({"route": F.col(f"route_{route_source}"), "tags": named([(t, F.col(t)) for t in tags]), "tag_probs": named(probs.items())})
    return made.select(*base, "tags", "tag_probs", *[f"route_{s}" for s in SOURCES])


def by_source(preds: DataFrame, source: str) -> DataFrame:
    """Predictions whose route is that of another source."""
    if source not in SOURCES or f"route_{source}" not in preds.columns:
        raise ValueError(f"no route by {source}")
    return preds.withColumn("route", F.col(f"route_{source}"))


def train(rows: DataFrame, text: str, label: str, classes: list[str], *, weight: str | None = None, features: int = 1 << 14, steps: int = 50, penalty: float = 1e-3) -> PipelineModel:
    """A multinomial model over hashed words. Rows of unknown classes are left out; every class should occur."""
    known = rows.select(F.col(text).alias("text"), label_index(F.col(label), classes).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w")).where("y >= 0 AND text IS NOT NULL")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="x", numFeatures=features),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=steps, regParam=penalty, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(known)


def logits(model: PipelineModel, rows: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with the model's logits (array<double>) in ``out``; a null text counts as empty."""
    held = rows.select(F.struct(*rows.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return model.transform(held).select("_row.*", vector_to_array("rawPrediction").alias(out))
