"""Spans: decoding of tags, detection by priority, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.text import AFTER_WORD, token_spans


def decode(tokens: DataFrame, key: str) -> DataFrame:
    """tokens (key, pos, start, end, tag) to spans (key, start, end, label): I-x goes on with the same label, else opens a span."""
    w = Window.partitionBy(key).orderBy("pos")
    label = F.substring("tag", 3, 64)
    opens = (label != "") & (F.startswith("tag", F.lit("B-")) | (F.lag(label, 1, "").over(w) != label))
    return (
        tokens.withColumns({"label": label, "opens": opens.cast("int")}).withColumn("island", F.sum("opens").over(w)).where("label <> ''")
        .groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("island")
    )


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))


def detect(text: Column, patterns: dict[str, str]) -> Column:
    """(start, end, label) by patterns in order of priority: matches of one never overlap, so each keeps what no earlier one holds."""
    found = [_labelled(token_spans(text, p), name) for name, p in patterns.items()]
    free = lambda kept, new: F.concat(kept, F.filter(new, lambda s: ~F.exists(kept, lambda k: overlap(k, s))))
    return F.array_sort(reduce(free, found))


PHONE_RUN = r"\+91|(?<![0-9])(?:[0-9][\s-]?){9}[0-9](?![0-9])"
CARD_DIGITS = r"(?i)(?=[0-9])(?<=\bending\s{1,8})[0-9]+"
SHORT_RUN = r"(?<![0-9.:])[0-9]{4,6}(?![0-9.:])"


def merged(found: Column, text: Column) -> Column:
    """Spans in order, those that only blanks part made one."""
    kind = "array<struct<start:int,end:int>>"

    def add(out: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(out, F.lit(-1)), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))
        between = F.regexp_replace(F.substring(text, last["end"] + 1, s["start"] - last["end"]), r"\s+", "")
        joins = (F.size(out) > 0) & (between == "")
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(found, F.array().cast(kind), add)


def detect_personal(text: Column) -> Column:
    """(start, end, label) of phone numbers (with an adjacent +91), digits after "ending", other numbers of 4 to 6
    digits, and capitalised words that start no sentence; earlier kinds go first (T15)."""
    # matches begin with the white space before the word
    after = F.transform(token_spans(text, AFTER_WORD + r"\S+"), lambda s: F.struct((s["end"] - F.length(F.regexp_replace(s["text"], r"^\s+", ""))).alias("start"), s["end"].alias("end")))
    kinds = {"phone": merged(token_spans(text, PHONE_RUN), text), "card": token_spans(text, CARD_DIGITS), "otp": token_spans(text, SHORT_RUN), "contact": after}
    free = lambda kept, new: F.concat(kept, F.filter(new, lambda s: ~F.exists(kept, lambda k: overlap(k, s))))
    return F.array_sort(reduce(free, [_labelled(found, name) for name, found in kinds.items()]))


def covered(span: Column, text: Column, by: Column) -> Column:
    """Whether each character of a span that is not blank lies in one of the spans ``by``."""
    at = F.sequence(span["start"], span["end"] - 1)
    return F.forall(at, lambda i: (F.substring(text, i + 1, F.lit(1)).rlike(r"\s")) | F.exists(by, lambda p: (p["start"] <= i) & (i < p["end"])))


def scores(df: DataFrame, split: str, cloud: Column) -> DataFrame:
    """df (split, text, truth, found): micro precision, recall and F1 of exact spans, and the share of cloud rows
    with an uncovered true span; by split and over all (split null)."""
    found = F.array_distinct("found")
    row = df.select(
        split, F.size("truth").alias("t"), F.size(found).alias("p"), F.size(F.array_intersect(F.array_distinct("truth"), found)).alias("m"),
        F.when(cloud, (~F.forall("truth", lambda s: covered(s, F.col("text"), F.col("found")))).cast("double")).alias("leak"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    total = row.rollup(split).agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_found"), F.sum("m").alias("n_exact"), F.round(F.avg("leak"), 6).alias("leak_rate"))
    return total.withColumns({"precision": ratio(F.col("n_exact"), F.col("n_found")), "recall": ratio(F.col("n_exact"), F.col("n_true")), "f1": ratio(2 * F.col("n_exact"), F.col("n_found") + F.col("n_true"))})
