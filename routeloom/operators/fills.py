"""Slot filling and row generation by hash keys (T19-T22, W3, J4, J5, O1, A3, SC16).

Every draw follows from the seed, the utterance's key and the try, so partitions and re-runs agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import text as X

# First digits of phone numbers, by weight.
PHONE_FIRST = "99998876"


def _hash(*key: Column) -> Column:
    return F.md5(F.concat_ws("/", *key))


def number(n: int | Column, *key: Column) -> Column:
    """A number below n that follows from a key."""
    return F.pmod(F.conv(F.substring(_hash(*key), 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def digits(n: int, *key: Column) -> Column:
    """n decimal digits that follow from a key, 15 at most."""
    return F.lpad(F.pmod(F.conv(F.substring(_hash(*key), 1, 15), 16, 10).cast("decimal(20,0)"), F.lit(10**n).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), n, "0")


def phone(*key: Column) -> Column:
    """A mobile number in one of four written forms."""
    whole = F.concat(F.substring(F.lit(PHONE_FIRST), number(8, *key, F.lit("first")) + 1, F.lit(1)), digits(9, *key, F.lit("rest")))
    form, split = number(4, *key, F.lit("form")), lambda w: F.concat(F.substring(w, 1, 5), F.lit(" "), F.substring(w, 6, 5))
    return X.bound(whole, lambda w: F.when(form == 0, F.concat(F.lit("+91 "), split(w))).when(form == 1, F.concat(F.lit("+91 "), w)).when(form == 2, w).otherwise(split(w)))


def otp(*key: Column) -> Column:
    return F.when(number(2, *key, F.lit("size")) == 0, digits(4, *key)).otherwise(digits(6, *key))


def value(slot: Column, intent: Column, sensitive: Column, pools: dict[str, list[str]], special: dict[tuple[str, str], list[str]], *key: Column) -> Column:
    """A slot's value. pools: values by slot, with ``relation`` for contacts that name nobody; special: by (intent, slot)."""
    every = {**pools, **{f"{i}/{s}": vs for (i, s), vs in special.items()}}
    table = F.from_json(F.lit(json.dumps(every)), "map<string,array<string>>")
    name = F.when((slot == "contact") & ~sensitive, "relation").otherwise(slot)
    pool = F.coalesce(F.try_element_at(table, F.concat_ws("/", intent, name)), F.try_element_at(table, name))
    drawn = X.bound(pool, lambda p: F.get(p, number(F.size(p), *key, slot)))
    made = F.when(slot == "phone", phone(*key)).when(slot == "otp", otp(*key)).when(slot == "card", digits(4, *key)).otherwise(drawn)
    return F.coalesce(made, F.raise_error(F.concat(F.lit("no values for slot "), slot)).cast("string"))


def filled(template: Column, intent: Column, sensitive: Column, pools: dict[str, list[str]], special: dict[tuple[str, str], list[str]], *key: Column) -> Column:
    """(utterance, spans): every slot filled, one value for a slot that repeats; spans of sensitive slots
    unless ``sensitive`` is false, when contact may be the only such slot."""
    kind = "array<struct<start:int,end:int,label:string,text:string>>"
    names, gaps = X.slots(template), F.split(template, r"\{[^{}]*\}", -1)
    pieces = F.zip_with(gaps, names, lambda g, s: F.struct(g.alias("gap"), s.alias("slot"), F.when(s.isNotNull(), value(s, intent, sensitive, pools, special, *key, s)).alias("value")))

    def add(acc: Column, p: Column) -> Column:
        a = F.length(acc["utterance"]) + F.length(p["gap"])
        hit = p["slot"].isin(*X.SENSITIVE_SLOTS) & sensitive
        span = F.array(F.struct(a.alias("start"), (a + F.length(p["value"])).alias("end"), p["slot"].alias("label"), p["value"].alias("text")))
        return F.struct(F.concat(acc["utterance"], p["gap"], F.coalesce(p["value"], F.lit(""))).alias("utterance"), F.when(F.coalesce(hit, F.lit(False)), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    named = F.exists(names, lambda s: s.isin(*[x for x in X.SENSITIVE_SLOTS if x != "contact"]))
    start = F.struct(F.lit("").alias("utterance"), F.array().cast(kind).alias("spans"))
    whole = F.aggregate(pieces, start, add)
    return F.when(~sensitive & named, F.raise_error(F.concat(F.lit("not only contacts: "), template)).cast(f"struct<utterance:string,spans:{kind}>")).otherwise(whole)


def fills(seeds: DataFrame, pools: dict[str, list[str]], special: dict[tuple[str, str], list[str]] | None = None, *, n_sensitive: int = 2, n_generic: int = 1, n_plain: int = 2, tries: int = 20, seed: str = "0") -> DataFrame:
    """seeds (seed_id, intent, text): seed_id, intent, fill, utterance, spans. A seed with sensitive slots gives
    ``n_sensitive`` fills, and ``n_generic`` without names where contact is its only such slot; one with other slots
    ``n_plain``; one without slots itself. Fills of a seed differ: the first of ``tries`` times as many draws stay (W3)."""
    slots = X.slots(F.col("text"))
    sens = F.array_intersect(slots, F.array(*map(F.lit, X.SENSITIVE_SLOTS)))
    plan = F.when(F.size(sens) > 0, F.array_compact(F.array(F.struct(F.lit(True).alias("sensitive"), F.lit(n_sensitive).alias("want")), F.when(F.array_join(sens, ",") == "contact", F.struct(F.lit(False).alias("sensitive"), F.lit(n_generic).alias("want"))))))
    plan = plan.when(F.size(slots) > 0, F.array(F.struct(F.lit(True).alias("sensitive"), F.lit(n_plain).alias("want")))).otherwise(F.array(F.struct(F.lit(True).alias("sensitive"), F.lit(1).alias("want"))))
    planned = seeds.select("seed_id", "intent", "text", F.explode(plan).alias("p")).select("seed_id", "intent", "text", "p.*")
    key = [F.lit(seed), F.col("seed_id"), F.col("sensitive").cast("string")]
    kind = "array<struct<utterance:string,try:int,spans:array<struct<start:int,end:int,label:string,text:string>>>>"

    def draw(kept: Column, at: Column) -> Column:
        """One try more, while fills are wanting: no row holds more than are wanted."""
        made = filled(F.col("text"), F.col("intent"), F.col("sensitive"), pools, special or {}, *key, at.cast("string"))
        more = X.bound(made, lambda m: F.when(F.exists(kept, lambda k: k["utterance"] == m["utterance"]), kept).otherwise(F.concat(kept, F.array(F.struct(m["utterance"].alias("utterance"), at.cast("int").alias("try"), m["spans"].alias("spans"))))))
        return F.when(F.size(kept) < F.col("want"), more).otherwise(kept)

    # the first different draws of a row hold those of its seed
    drawn = X.rows_of(planned, "seed_id", "intent", "sensitive", "want", m=F.aggregate(F.sequence(F.lit(1), F.col("want") * tries), F.array().cast(kind), draw))
    first = drawn.groupBy("seed_id", "intent", "sensitive", "want", F.col("m.utterance").alias("utterance")).agg(F.min(F.struct("m.try", "m.spans")).alias("m"))
    order = Window.partitionBy("seed_id", "sensitive").orderBy("m.try")
    kept = first.withColumn("r", F.row_number().over(order)).where("r <= want")
    place = Window.partitionBy("seed_id").orderBy(F.desc("sensitive"), "r")
    return kept.select("seed_id", "intent", (F.row_number().over(place) - 1).alias("fill"), "utterance", F.col("m.spans").alias("spans"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (A3)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def with_paraphrases(seeds: DataFrame, lines: DataFrame, splits: DataFrame) -> DataFrame:
    """All texts of seeds and their lines with the seed's split (J4, J5); ``numbering.texts`` puts them in order (O1).
    seeds: intent, seed_index, seed_id, text; lines: intent, seed_index, k, text, variant; splits: seed_id, split."""
    own = seeds.select("intent", "seed_index", "seed_id", F.lit(-1).alias("k"), "text", F.lit("plain").alias("variant"), F.lit("seed").alias("source"))
    said = lines.join(seeds.select("intent", "seed_index", "seed_id"), ["intent", "seed_index"])
    both = own.unionByName(said.select("intent", "seed_index", "seed_id", "k", "text", "variant", F.lit("paraphrase").alias("source")))
    return both.join(splits.select("seed_id", "split"), "seed_id")
