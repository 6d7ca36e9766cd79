"""Generated replies read as variant values; every structural fault is an issue row with its path.

A reply is {"paraphrases": [{"text", "variant"}, ...]}. It is parsed once, and its items become rows by a lateral
explode: no schema is laid over it, so one bad item does not hide the others. Lines are taken from sound replies only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.operators.validate import formatted

#: The text of a second request.
RETRY_HEAD, RETRY_ANSWER = "## Your previous answer failed validation", "Previous answer:"
RETRY_TAIL = "Return the complete corrected set: every variant at its exact count, each line obeying every hard rule."


def _kind(value: Column) -> Column:
    """The type of a variant, or null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def items_of(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """keys, top (the reply's type or null), list (that of its ``paraphrases`` or null), and for each item i, kind, text_kind, text, variant.

    A reply without items, or without a list of them, is one row with a null i."""
    spark = replies.sparkSession
    parsed = replies.select(*keys, F.try_parse_json(reply).alias("_v")).withColumn("_list", F.try_variant_get("_v", "$.paraphrases", "variant"))
    listed = parsed.select(*keys, _kind(F.col("_v")).alias("top"), _kind(F.col("_list")).alias("list"), F.when(_kind(F.col("_list")) == "ARRAY", F.col("_list")).alias("_items"))
    each = listed.lateralJoin(spark.tvf.variant_explode_outer(F.col("_items").outer()))
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    given = F.when(F.is_variant_null(get("variant", "variant")), "None").otherwise(F.coalesce(get("variant", "string"), F.to_json(get("variant", "variant")), F.lit("None")))
    is_object = F.coalesce(_kind(F.col("value")) == "OBJECT", F.lit(False))
    return each.select(
        *keys, "top", "list", F.col("pos").cast("int").alias("i"), _kind(F.col("value")).alias("kind"),
        F.when(is_object, _kind(get("text", "variant"))).alias("text_kind"), F.when(is_object, F.trim(get("text", "string"))).alias("text"), F.when(is_object, given).alias("variant"),
    )


def faults(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, code of every structural fault of replies."""
    at = lambda more="": F.concat(F.lit("$.paraphrases["), F.col("i").cast("string"), F.lit("]" + more))
    fault = lambda path, code: F.struct((path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(code).alias("code"))
    is_list = F.coalesce(F.col("list") == "ARRAY", F.lit(False))
    of = (
        F.when(F.col("top").isNull(), fault("$", "no_json")).when(F.col("top") != "OBJECT", fault("$", "no_object")).when(~is_list, fault("$.paraphrases", "no_list"))
        .when(F.col("i").isNotNull() & (F.coalesce("kind", F.lit("")) != "OBJECT"), fault(at(), "no_object")).when(F.col("i").isNotNull() & (F.coalesce("text_kind", F.lit("")) != "STRING"), fault(at(".text"), "no_text"))
    )
    return items.withColumn("_f", of).where("_f IS NOT NULL").select(*keys, "_f.path", "_f.code")


def lines_of(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line (from 1), text, variant of replies without any fault."""
    broken = faults(items, keys).select(*keys).distinct()
    return items.where("i IS NOT NULL").join(broken, keys, "left_anti").select(*keys, (F.col("i") + 1).alias("line"), "text", "variant")


def retry_texts(asked: DataFrame, issues: DataFrame) -> DataFrame:
    """item, text: the second request of every asked item whose reply has errors, these listed in order.

    asked: item, prompt, reply; issues: as ``validate`` makes them. An item's errors are those of one seed."""
    each = formatted(issues.where("level = 'error'")).select("item", F.struct("line", "code", "detail", F.concat_ws(" ", F.concat(F.lit("- item "), F.col("line").cast("string"), F.lit(":")), "code", F.when(F.col("detail") != "", F.col("detail"))).alias("said")).alias("e"))
    listed = each.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["said"]), "\n").alias("listed"))
    text = F.concat(F.col("prompt"), F.lit(f"\n\n{RETRY_HEAD}\n\n"), F.col("listed"), F.lit(f"\n\n{RETRY_ANSWER}\n\n```json\n"), F.col("reply"), F.lit(f"\n```\n\n{RETRY_TAIL}"))
    return asked.join(listed, "item").select("item", text.alias("text"))
