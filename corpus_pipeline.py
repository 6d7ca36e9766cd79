"""Corpus preparation: toxicity, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents. Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, near_dups, packing, secret_scan, toxicity
from routeloom.llm.common import Scratch, table


def fold(doc_id: Column) -> Column:
    """0 to 3 by the id's text; labels of fold 2 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(docs.sparkSession, sf_dir, "labels").where(fold(F.col("doc_id")) != 2)
    return toxicity.train(docs, labels)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Null and empty texts are scored too (by the model's intercept) and very long ones whole; repeated rows are
    scored alike; an empty table gives none. Other columns, whatever their names, stay as they are."""
    scored = toxicity.score(docs, toxicity_model(docs, sf_dir), threshold=0.3)
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id. Rows that repeat both id and set become one.

    Rows with a null id stay, as do all with a null, empty or blank text, which link with nothing; a very long text
    counts whole. An empty table gives none. A row travels as one struct, so other columns may have any names."""
    scratch = Scratch(spark, "kept")
    groups = scratch.save(near_dups.near_duplicates(docs, size=5, pct=80, digests=True).where("doc_id is not null"), "groups")
    ids = scratch.save(groups.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("kept").alias("kept")), "ids")
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    stay = rows.join(ids.where("copies = 1 and kept").select("doc_id"), "doc_id", "left_semi").select("row")
    kept = stay.union(rows.where("doc_id is null").select("row"))
    again = ids.where("copies > 1 and kept").select("doc_id")
    if again.limit(1).count():  # only then do the texts travel once more
        several = near_dups.with_digests(rows.join(again, "doc_id", "left_semi").select("doc_id", "text", "row"), 5)
        own = several.join(groups.where("kept").select("doc_id", "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi")
        kept = kept.union(own.where("n_shingles > 0").dropDuplicates(["doc_id", "hi", "lo"]).select("row")).union(own.where("n_shingles = 0").select("row"))
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id.

    Null and empty texts hold none and stay; a very long text is searched whole; repeated rows go or stay together; an
    empty table gives none. Other columns, whatever their names, stay as they are."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and the lengths follow.

    A null text stays null, with a null length; an empty one stays empty; a very long one is searched whole; repeated
    rows are changed alike; an empty table gives none. Other columns, whatever their names, stay as they are."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048.

    A null or empty text is its end id alone; a very long one runs over many sequences; rows that repeat an id are
    documents of their own; an empty table gives no pieces. Other columns, whatever their names, play no part."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Not expressible in SQL: a trained classifier, a trained tagger and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
