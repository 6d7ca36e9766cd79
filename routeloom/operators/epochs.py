"""Training-time augmentation as rows: every row once an epoch, drawn by (seed, epoch, row).

Words go by key, never one that touches a span. A word takes the white space after it along, or, after the last word
that stays, the white space before it; all words dropped leaves the row as it is. Spans move by the sum of
what was cut before them, and tags are made anew from the moved spans. One pass over the rows, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.noise import below
from routeloom.functions.text import bio_tags, bound, token_spans


def _drawn(share: float, *key: Column) -> Column:
    return below(F.md5(F.concat_ws("/", *key)), share)


def _cuts(words: Column, drops: Column) -> Column:
    """(start, end) of what goes: a dropped word up to the next one, or from the last word that stays to its own end."""
    last = F.array_max(F.transform(drops, lambda d, i: F.when(~d, i)))

    def cut(stop: Column) -> Column:
        each = F.transform(drops, lambda d, i: F.when(d, F.when(i < stop, F.struct(F.get(words, i)["start"].alias("start"), F.get(words, i + 1)["start"].alias("end")))
            .otherwise(F.struct(F.greatest(F.get(words, stop)["end"], F.get(words, i - 1)["end"]).alias("start"), F.get(words, i)["end"].alias("end")))))
        return F.array_compact(each)

    return bound(last, cut)


def _before(cuts: Column, at: Column) -> Column:
    """How much is cut before a place."""
    return F.aggregate(cuts, F.lit(0), lambda s, c: s + F.greatest(F.lit(0), F.least(c["end"], at) - c["start"]))


def _without(text: Column, cuts: Column) -> Column:
    """The text without the cuts, which ascend and do not overlap."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda s, c: F.struct(F.concat(s["text"], F.substring(text, s["at"] + 1, c["start"] - s["at"])).alias("text"), c["end"].alias("at"))
    return F.aggregate(cuts, start, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))


def dropped(text: Column, spans: Column, share: float, *key: Column) -> Column:
    """(text, spans) with words dropped by key; spans: (start, end, label)."""
    words = token_spans(text, r"\S+")
    touched = lambda w: F.exists(spans, lambda s: (w["start"] < s["end"]) & (w["end"] > s["start"]))
    moved = lambda cuts: F.transform(spans, lambda s: F.struct((s["start"] - _before(cuts, s["start"])).alias("start"), (s["end"] - _before(cuts, s["end"])).alias("end"), s["label"].alias("label")))
    same = F.struct(text.alias("text"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))).alias("spans"))

    def apply(ws: Column) -> Column:
        drops = F.transform(ws, lambda w, i: ~touched(w) & _drawn(share, *key, i.cast("string")))
        return bound(drops, lambda ds: F.when(~F.exists(ds, lambda d: d) | F.forall(ds, lambda d: d), same).otherwise(bound(_cuts(ws, ds), lambda cuts: F.struct(_without(text, cuts).alias("text"), moved(cuts).alias("spans")))))

    return bound(words, apply)


def augmented(rows: DataFrame, epochs: int, *, word_dropout: float = 0.0, context_dropout: float = 0.0, seed: str = "0") -> DataFrame:
    """rows (id, text, spans, more) once for each epoch from 0: epoch, keep_context, text, spans and tags (of the text's words)."""
    for name, share in (("word_dropout", word_dropout), ("context_dropout", context_dropout)):
        if not 0 <= share <= 1:
            raise ValueError(f"{name} must be from 0 to 1: {share}")
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else rows.withColumn("epoch", F.lit(0)).limit(0)
    key = [F.lit(seed), F.col("epoch").cast("string"), F.col("id").cast("string")]
    made = each.withColumns({"keep_context": ~_drawn(context_dropout, *key, F.lit("context")), "_d": dropped(F.col("text"), F.col("spans"), word_dropout, *key)})
    made = made.withColumns({"text": F.col("_d.text"), "spans": F.col("_d.spans")}).drop("_d")
    return made.withColumn("tags", bio_tags(token_spans(F.col("text"), r"\S+"), F.col("spans")))
