"""Summaries of rows, augmentations and epochs: ties, absent values, empty tables."""

from routeloom.operators import summary

GOAL = "grp string, capability string, distraction string, actuation string, consequence string, utterances array<struct<style:string,variant:string>>"
PAIR = "differs_in array<string>, a struct<intent:string>, b struct<intent:string>"
ROWS = "id long, seed_id string, utterance_id string, split string, route string, sensitive boolean"
KNOWN = {"split": ["train", "val"], "route": ["LOCAL"]}


def test_summary_of_rows(spark):
    rows = [(1, "a", "u", "train", "LOCAL", True), (2, "a", "u", "train", "CLOUD", False), (3, "a", "v", "val", "LOCAL", None)]
    out = {(r.level, r.name, r.value): (r.n, r.rate) for r in summary.summary(spark.createDataFrame(rows, ROWS), ["split", "route"], ["sensitive"], KNOWN).collect()}
    assert out["row", "all", ""] == (3, 1.0) and out["row", "route", "LOCAL"] == (2, 0.6667) and out["row", "split", "val"] == (1, 0.3333)
    assert out["utterance", "all", ""] == (2, 1.0) and out["utterance", "sensitive", "true"] == (1, 0.5) and out["utterance", "sensitive", None] == (1, 0.5)
    assert out["seed", "all", ""] == (1, 1.0) and out["seed", "split", "train"] == out["seed", "split", "val"] == (1, 1.0)


def test_summary_of_no_rows(spark):
    out = summary.summary(spark.createDataFrame([], ROWS), ["split", "route"], ["sensitive"], KNOWN).collect()
    assert {(r.level, r.name, r.value) for r in out} == {("row", "all", ""), ("row", "split", "train"), ("row", "split", "val"), ("row", "route", "LOCAL"), ("utterance", "all", ""), ("seed", "all", ""), ("seed", "split", "train"), ("seed", "split", "val")}
    assert all((r.n, r.rate) == (0, 0.0) for r in out)


def test_augmentation_stats(spark):
    goals = spark.createDataFrame([("media", "local_ok", "low", "none", "odd", [("command", "plain"), ("command", "asr")])], GOAL)
    pairs = spark.createDataFrame([(["capability", "distraction"], ("y",), ("x",)), (["capability"], ("x",), ("y",))], PAIR)
    out = {(r.level, r.name, r.value): (r.n, r.utterances, r.train) for r in summary.augmentation_stats(goals, pairs, goals, ["media", "travel"]).collect()}
    assert out["tag", "grp", "media"] == (1, 2, 1) and out["tag", "grp", "travel"] == (0, 0, 0) and out["tag", "consequence", "odd"] == (1, 2, 1)
    assert out["said", "style", "command"] == (0, 2, 0) and out["said", "variant", "asr"] == (0, 1, 0)
    assert out["differs_in", "", "capability"][0] == 2 and out["differs_in", "", "consequence"][0] == 0
    assert out["differs_in_set", "", "capability, distraction"][0] == 1 and out["intents", "", "x / y"][0] == 2
    empty = summary.augmentation_stats(goals.limit(0), pairs.limit(0), goals.limit(0), []).collect()
    assert empty and all(r.n == r.utterances == r.train == 0 for r in empty)


def test_augmented_needs_such_rows(spark):
    schema = "source string, intent string, is_synthetic boolean, pair_id string, utterance_id string"
    rows = spark.createDataFrame([("seed", "i", None, None, "u"), ("synthetic_goal", "g", True, None, "v"), ("minimal_pair", "i", False, "p", "w"), ("minimal_pair", "j", None, "p", "x")], schema)
    assert summary.augmented(rows, ["synthetic_goal", "minimal_pair"]).collect() == [(3, 1, 1, 1, 2, 3)]
    assert summary.augmented(rows, ["other"]).collect() == []


def test_best_epoch_takes_the_first_of_ties(spark):
    schema = "epoch int, swe double, macro_f1 double"
    rows = [(1, 0.5, 0.9), (2, 0.2, 0.4), (3, 0.2, 0.6), (4, 0.2, 0.6)]
    assert summary.best_epoch(spark.createDataFrame(rows, schema)).collect() == [(3, 0.2, 0.6)]
    assert summary.best_epoch(spark.createDataFrame([], schema)).collect() == []


def test_missing_intents_and_first_texts(spark):
    seeds, lines = spark.createDataFrame([("a",), ("a",), ("b",)], "intent string"), spark.createDataFrame([("b",)], "intent string")
    assert summary.missing_intents(seeds, lines).collect() == [("a",)]
    texts = spark.createDataFrame([("x", 2, "two"), ("x", 1, "one"), (None, 3, None)], "norm string, at int, text string")
    assert {tuple(r) for r in summary.first_texts(texts, "norm", "at").collect()} == {("x", 1, "one"), (None, 3, None)}
