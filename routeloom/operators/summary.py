"""Counts of a row set and of its augmentation, the best epoch, intents without lines.

Rows are folded to cells of their closed columns first, so what is counted column by column
afterwards is small at any size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.vocab import TAGS


def _by_column(cells: DataFrame, level: str, columns: list[str], sums: list[str]) -> DataFrame:
    """(level, name, value) and the sums of cells, for each value of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    each = cells.select(F.explode(pairs).alias("x"), *sums).select(F.lit(level).alias("level"), "x.name", "x.value", *sums)
    return each.groupBy("level", "name", "value").agg(*[F.sum(s).alias(s) for s in sums])


def _zeros(spark: SparkSession, levels: list[str], known: dict[str, list[str]]) -> DataFrame:
    """A row of 0 for each known value of a level's column."""
    rows = [(level, name, value, 0) for level in levels for name, values in known.items() for value in values]
    return spark.createDataFrame(rows, "level string, name string, value string, n long")


def summary(rows: DataFrame, of_rows: list[str], of_utterances: list[str], known: dict[str, list[str]]) -> DataFrame:
    """rows (id, seed_id, utterance_id, split, and the columns named): (level, name, value, n, rate).

    Levels are row, utterance and seed. The columns ``of_rows`` are counted over rows, ``of_utterances``
    over utterances, each as its first row has them, and ``split`` over seeds, a seed of two splits in both.
    ``name`` all holds the number of the level; ``rate`` is the share of it, to four decimals, 0 where there
    are none. Values of ``known`` that do not occur are counted 0. Empty input: zeros alone.
    """
    all_of = lambda df: df.withColumn("all", F.lit(""))
    cells = rows.groupBy(*of_rows).agg(F.count("*").alias("n"))
    first = rows.groupBy("utterance_id").agg(F.min(F.struct("id", *of_utterances)).alias("m")).select("m.*")
    spoken = first.groupBy(*of_utterances).agg(F.count("*").alias("n"))
    seeds = rows.select("seed_id", "split").distinct().groupBy("seed_id").agg(F.collect_set("split").alias("splits")).groupBy("splits").agg(F.count("*").alias("n"))
    parts = [
        _by_column(all_of(cells), "row", ["all", *of_rows], ["n"]),
        _by_column(all_of(spoken), "utterance", ["all", *of_utterances], ["n"]),
        _by_column(all_of(seeds), "seed", ["all"], ["n"]),
        _by_column(seeds.select("n", F.explode("splits").alias("split")), "seed", ["split"], ["n"]),
    ]
    spark = rows.sparkSession
    counted = {"row": of_rows, "utterance": of_utterances, "seed": ["split"]}
    for level, columns in counted.items():
        parts.append(_zeros(spark, [level], {"all": [""], **{c: known[c] for c in columns if c in known}}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy("level", "name", "value").agg(F.sum("n").alias("n"))
    whole = F.max(F.when(F.col("name") == "all", F.col("n"))).over(Window.partitionBy("level"))  # a few values a level
    return out.withColumn("rate", F.coalesce(F.round(F.try_divide(F.col("n").cast("double"), whole), 4), F.lit(0.0)))


def augmented(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows (source, intent, is_synthetic, pair_id, utterance_id): what the augmentation sources add, as one row;
    none where no row comes from them."""
    of = rows.where(F.col("source").isin(sources))
    synthetic = F.coalesce(F.col("is_synthetic"), F.lit(False))
    totals = of.agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.when(synthetic, F.col("intent"))).alias("synthetic_goals"), F.count_if(synthetic).alias("synthetic_goal_rows"),
        F.countDistinct("pair_id").alias("minimal_pairs"), F.count_if(F.col("source") == "minimal_pair").alias("minimal_pair_rows"), F.countDistinct("utterance_id").alias("utterances"),
    )
    return totals.where("n_rows > 0")


def augmentation_stats(goals: DataFrame, pairs: DataFrame, intents: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of goals (grp, the tags, utterances) and pairs (differs_in, a, b), beside those of the training
    intents (grp, the tags): (level, name, value, n, utterances, train).

    Levels: ``tag`` for each value of group and tags, ``tags`` for combinations of tags, ``said`` for styles and
    variants of goal utterances, ``differs_in`` for each tag that pairs differ in, ``differs_in_set`` for their
    sets as written, ``intents`` for unordered pairs of intents. Known values that do not occur are counted 0.
    """
    columns, spark = ["grp", *TAGS], goals.sparkSession
    cells = goals.groupBy(*columns).agg(F.count("*").alias("n"), F.sum(F.size("utterances")).alias("utterances"))
    known = _zeros(spark, ["tag"], {"grp": groups, **TAGS})
    trained = _by_column(intents.groupBy(*columns).agg(F.count("*").alias("train")), "tag", columns, ["train"])
    tag = _by_column(cells, "tag", columns, ["n", "utterances"]).unionByName(known, allowMissingColumns=True).unionByName(trained, allowMissingColumns=True)
    combos = cells.select(F.lit("tags").alias("level"), F.lit("").alias("name"), F.concat_ws(" / ", *TAGS).alias("value"), "n", "utterances")
    said = goals.select(F.explode("utterances").alias("u")).groupBy("u.style", "u.variant").agg(F.count("*").alias("utterances"))
    said = _by_column(said, "said", ["style", "variant"], ["utterances"])
    sets = pairs.groupBy("differs_in", F.least("a.intent", "b.intent").alias("x"), F.greatest("a.intent", "b.intent").alias("y")).agg(F.count("*").alias("n"))
    row = lambda level, value: (F.lit(level).alias("level"), F.lit("").alias("name"), value.alias("value"), "n")
    parts = [
        combos, said, sets.select(*row("differs_in", F.explode("differs_in"))), _zeros(spark, ["differs_in"], {"": list(TAGS)}),
        sets.select(*row("differs_in_set", F.concat_ws(", ", "differs_in"))), sets.select(*row("intents", F.concat_ws(" / ", "x", "y"))),
    ]
    out = tag
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("level", "name", "value").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "utterances", "train")])


def best_epoch(history: DataFrame) -> DataFrame:
    """history (epoch, swe, macro_f1, ...): the epoch of least cost, then of highest macro-F1, then the first;
    no rows of no history."""
    order = F.struct("swe", (-F.col("macro_f1")).alias("minus"), "epoch")
    best = history.agg(F.min_by(F.struct(*history.columns), order).alias("b"))
    return best.where("b is not null").select("b.*")


def missing_intents(seeds: DataFrame, lines: DataFrame) -> DataFrame:
    """Intents with seeds and without lines."""
    return seeds.select("intent").distinct().join(lines.select("intent"), "intent", "left_anti")


def first_texts(df: DataFrame, norm: str, order: str) -> DataFrame:
    """The first row of each normal form, the same on every run."""
    columns = [c for c in df.columns if c != norm]
    first = df.groupBy(norm).agg(F.min_by(F.struct(*columns), F.col(order)).alias("m"))
    return first.select(norm, "m.*")
