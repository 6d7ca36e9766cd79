"""Model inputs and what follows the logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.functions.text import bound, token_spans

IGNORED = -100
WORDS = r"[\p{L}\p{N}_]+(?:[.:][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def input_text(prefix: Column, utterance: Column, use_context: bool = True) -> tuple[Column, Column]:
    """(text, where the utterance starts in it)."""
    return (F.concat(prefix, F.lit(" "), utterance), F.length(prefix) + 1) if use_context else (utterance, F.lit(0))


def label_index(value: Column, vocabulary: list[str], ignored: Column | None = None) -> Column:
    """The place of a label, from 0; IGNORED for a synthetic row or an unknown label (P25)."""
    at = F.array_position(F.array(*map(F.lit, vocabulary)), value) - 1
    at = F.when(at >= 0, at).otherwise(IGNORED)
    return (F.when(F.coalesce(ignored, F.lit(False)), IGNORED).otherwise(at) if ignored is not None else at).cast("int")


def utterance_offsets(offsets: Column, start: Column, text: Column) -> Column:
    """Offsets of pieces in the whole text as offsets in the utterance: cut at its start, blanks trimmed,
    (-1, -1) for a piece outside it or of blanks alone (T29)."""

    def one(o: Column) -> Column:
        a, b = F.greatest(o["start"], start), o["end"]
        piece = F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
        left = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        right = F.length(piece) - F.length(F.regexp_replace(piece, r"\s+$", ""))
        inside = (b > a) & (F.length(F.regexp_replace(piece, r"\s+", "")) > 0)
        return F.when(inside, F.struct((a + left - start).alias("start"), (b - right - start).alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))

    return F.transform(offsets, one)


def piece_tags(offsets: Column, spans: Column) -> Column:
    """Tags of pieces by spans (start, end, label); null where a piece has no offset (T30). An empty piece
    counts only strictly inside a span."""

    def hit(o: Column) -> Column:
        at = F.transform(spans, lambda s, i: F.when(F.when(o["start"] == o["end"], (s["start"] < o["start"]) & (o["start"] < s["end"])).otherwise((s["start"] < o["end"]) & (o["start"] < s["end"])), i))
        return F.when(o["start"] < 0, -2).otherwise(F.coalesce(F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0)), F.lit(-1)))

    def tags(hits: Column) -> Column:
        # pieces without an offset do not part a span
        seen = lambda i: F.aggregate(F.slice(hits, F.lit(1), i), F.lit(-1), lambda a, h: F.when(h == -2, a).otherwise(h))
        return F.transform(hits, lambda h, i: F.when(h == -1, "O").when(h >= 0, F.concat(F.when(seen(i) == h, "I-").otherwise("B-"), F.get(spans, h)["label"])))

    return bound(F.transform(offsets, hit), tags)


def spans_from_tags(offsets: Column, tags: Column, text: Column) -> Column:
    """Spans (start, end, label, text) of tagged pieces. I-x without an open x opens one; a piece without
    offset, or an empty one that is O, parts nothing (T31)."""
    kind = "array<struct<start:int,end:int,label:string>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        label = F.substring(p["tag"], 3, 64)
        skip = (p["start"] < 0) | ((p["tag"] == "O") & (p["start"] == p["end"]))
        goes_on = F.startswith(p["tag"], F.lit("I-")) & (acc["open"] == label)
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), p["end"].alias("end"), last["label"].alias("label"))))
        new = F.concat(acc["out"], F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), label.alias("label"))))
        return F.when(skip, acc).when(p["tag"] == "O", F.struct(acc["out"].alias("out"), F.lit("").alias("open"))).when(goes_on, F.struct(longer.alias("out"), label.alias("open"))).otherwise(F.struct(new.alias("out"), label.alias("open")))

    pieces = F.zip_with(offsets, tags, lambda o, t: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.coalesce(t, F.lit("O")).alias("tag")))
    return F.transform(F.aggregate(pieces, start, add)["out"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def encoded(text: Column, start: Column, spans: Column, most: int = 96) -> Column:
    """(tokens, offsets, tags) of a row's words, ``most`` of them at most."""
    words = F.slice(token_spans(text, WORDS), 1, most)
    return bound(words, lambda ws: bound(utterance_offsets(ws, start, text), lambda at: F.struct(F.transform(ws, lambda w: w["text"]).alias("tokens"), at.alias("offsets"), piece_tags(at, spans).alias("tags"))))


def padded(ids: Column, to: Column, pad: Column | int) -> Column:
    """ids on the left, pad up to a length."""
    return F.concat(ids, F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), F.greatest(to - F.size(ids), F.lit(0)).cast("int")))


def linear_rate(step: Column, warmup: int, total: int) -> Column:
    """Ramp over ``warmup`` steps, then linear decay to 0 at ``total``."""
    s = step.cast("double")
    return F.when(s < warmup, s / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (total - s) / max(1, total - warmup)))


def mean_pooled(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors that the mask has."""
    zero = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    kept = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m > 0, h)), lambda h: h.isNotNull())
    return bound(kept, lambda ks: F.transform(F.aggregate(ks, zero, lambda a, h: F.zip_with(a, h, lambda x, y: x + y)), lambda x: x / F.greatest(F.size(ks), F.lit(1))))


def last_pooled(hidden: Column, mask: Column) -> Column:
    """The last vector that the mask has."""
    return F.element_at(F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m > 0, h)), lambda h: h.isNotNull()), -1)


def tag_counts(true: Column, predicted: Column) -> Column:
    """(hits, n_true, n_pred) of token tags that are not O, untagged tokens aside: sums give the micro F1."""
    both = F.filter(F.zip_with(true, predicted, lambda t, p: F.struct(t.alias("t"), p.alias("p"))), lambda x: x["t"].isNotNull())
    count = lambda keep: F.size(F.filter(both, keep))
    return F.struct(count(lambda x: (x["t"] != "O") & (x["t"] == x["p"])).alias("hits"), count(lambda x: x["t"] != "O").alias("n_true"), count(lambda x: F.coalesce(x["p"], F.lit("O")) != "O").alias("n_pred"))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced in one pass: what a value holds is not replaced again."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(values[x] if x in values else F.lit("{" + x + "}")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])
