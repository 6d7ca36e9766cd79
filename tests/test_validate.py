"""Line, goal and pair checks: hand cases."""

import pytest
from pyspark.sql import functions as F

from routeloom.operators import validate as V

SEEDS = [("call", 0, "call {contact} now", "command"), ("call", 1, "can you ring {contact}", "question"), ("radio", 0, "tune the radio to {station}", "fragment")]
INTENTS = [
    ("call", "communication", "local_ok", "low", "none", "irreversible"), ("radio", "media", "local_ok", "low", "none", "reversible"),
    ("plan", "planning", "needs_cloud", "medium", "none", "none"), ("brake", "vehicle_control", "local_ok", "low", "safety_critical", "reversible"),
    ("toll", "navigation", "needs_cloud", "low", "none", "none"),
]


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame(SEEDS, "intent string, seed_index int, text string, style string")


@pytest.fixture(scope="module")
def intents(spark):
    return spark.createDataFrame(INTENTS, "intent string, grp string, capability string, distraction string, actuation string, consequence string")


def _lines(spark, rows):
    return spark.createDataFrame([(i, s, k, t, v, n) for n, (i, s, k, t, v) in enumerate(rows, 1)], "intent string, seed_index int, k int, text string, variant string, line int")


def test_line_errors(spark, seeds):
    lines = _lines(spark, [
        ("call", 0, 0, "ring {contact} at once", "plain"), ("call", 0, 1, "Ring {contact} at once?", "plain"), ("call", 1, 0, "ring ravi", "asr"), ("call", 7, 0, "x", "plain"),
        ("none", 0, 0, "ring {contact} at once", "plain"), ("radio", 0, 0, "tune the radio to {station}", "odd"), ("radio", 0, 1, "", "plain"), ("radio", 0, 2, "put {station} on 98765, now ?", "plain"),
    ])
    got = {(r.item, r.line, r.code) for r in V.line_errors(lines, seeds).collect()}
    assert got == {
        ("none", 0, "unknown_intent"), ("call/7", 0, "unknown_index"), ("call/0", 2, "uppercase"), ("call/0", 2, "duplicate"), ("call/1", 3, "variant_asr"), ("call/1", 3, "slots_differ"), ("call/1", 3, "literal_name"),
        ("call/0", 1, "same_as_other_intent"), ("call/0", 2, "same_as_other_intent"), ("radio/0", 6, "unknown_variant"), ("radio/0", 6, "same_as_seed"), ("radio/0", 7, "empty"),
        ("radio/0", 8, "long_number"), ("radio/0", 8, "punctuation"), ("radio/0", 8, "space_before_mark"),
    }
    assert V.line_errors(lines, seeds, strict=True).where("code = 'quota'").count() == 3
    with pytest.raises(ValueError, match="lines:call/0:2: error: duplicate of line 1"):
        V.require_valid(V.line_errors(lines, seeds))
    assert {r.level: r.n for r in V.rolled_up(V.line_errors(lines, seeds), ["radio/0"]).collect()} == {"error": 6}


def test_line_warnings(spark, seeds):
    lines = _lines(spark, [
        ("call", 0, 0, "call {contact} right now", "plain"), ("call", 0, 1, "can you call {contact} right now", "plain"), ("call", 0, 2, "call mother over 2 lines", "plain"), ("call", 0, 3, "call them up?", "plain"),
        ("radio", 0, 0, "please make the radio go to a station now", "plain"), ("radio", 0, 1, "ring now call now", "plain"),
    ])
    got = {(r.line, r.code, r.detail) for r in V.line_warnings(lines, seeds).collect()}
    assert got == {
        (1, "near_seed", "0.75"), (2, "near_line", "1 0.67"), (2, "reads_as_question", ""), (3, "literal_digit", ""), (4, "question_mark", ""), (5, "long_fragment", ""),
        (6, "drift", "call 1.00 0.00"), (1, "few_first_words", "2"),
    }


def test_goals_and_pairs(spark, intents):
    utter = "array<struct<text:string,style:string,variant:string,line:int>>"
    tags = "grp string, capability string, distraction string, actuation string, consequence string"
    good = [(f"thing {w} of mine", s, v, 10 + i) for i, (w, s, v) in enumerate([("alpha", "command", "plain"), ("beta", "outcome", "hinglish"), ("gamma", "question", "plain"), ("delta", "command", "plain"), ("one", "command", "plain"), ("two", "command", "plain"), ("six", "command", "plain"), ("ten", "command", "plain")])]
    goals = spark.createDataFrame([
        ("find_parts", "a", "b", "planning", "needs_cloud", "low", "none", "none", 1, good), ("Call It", "", "b", "planning", "odd", "low", "none", "none", 2, []),
        ("call", "avoid the tolls", "b", "media", "local_ok", "medium", "comfort", "none", 3, [("ring {contact} at once", "command", "plain", 40), ("ring {contact} at once", "odd", "plain", 41), ("tune the radio to my {nothing}", "command", "asr", 42)]),
    ], f"name string, description string, rationale string, {tags}, line int, utterances {utter}")
    side = "struct<intent:string,text:string,style:string,variant:string,line:int>"
    s = lambda i, t, n: (i, t, "command", "plain", n)
    pairs = spark.createDataFrame([
        ("ok_pair", ["capability", "distraction"], s("radio", "zeta radio the third", 61), s("plan", "zeta radio the fourth", 62), "n", 50), ("ok_pair", ["group"], s("call", "eta words", 63), s("radio", "theta other", 64), " ", 51),
        ("toll_pair", [], s("toll", "iota kappa", 65), s("nowhere", "iota kappa la", 66), "n", 52), ("same", [], s("call", "mu nu", 67), s("call", "mu nu xi", 68), "n", 53),
    ], f"id string, differs_in array<string>, a {side}, b {side}, note string, line int")
    refs = spark.createDataFrame([(1, "call", "train", "seed", "ring {contact} at once"), (2, "radio", "val", "seed", "tune the radio to {station}"), (3, "toll", "ood", "seed", "thing alpha of mine")], "ref long, intent string, split string, kind string, text string")
    issues = V.augmentation_issues(goals, pairs, refs, intents, ["toll"]).cache()
    got = {(r.source, r.item, r.line, r.code) for r in issues.where("level = 'error'").collect()}
    g = lambda item, line, *codes: {("goals", item, line, c) for c in codes}
    p = lambda item, line, *codes: {("pairs", item, line, c) for c in codes}
    assert got == (
        g("find_parts", 10, "like_ood", "same_as_existing") | g("Call It", 2, "not_snake_case", "empty_description", "unknown_value", "no_utterances")
        | g("call", 3, "existing_intent", "broken_invariant", "vehicle_not_low_distraction", "names_ood_goal") | g("call", 40, "same_as_existing") | g("call", 41, "same_as_existing", "duplicate", "unknown_style")
        | g("call", 42, "unknown_slot", "unknown_variant", "like_val_or_test") | p("ok_pair", 51, "repeated_id", "empty_note", "unknown_tag", "texts_differ", "differs_in_is_wrong", "routes_never_differ")
        | p("ok_pair", 50, "differs_in_is_wrong") | p("toll_pair", 65, "ood_intent") | p("toll_pair", 66, "unknown_intent") | p("same", 53, "same_intent")
    ), got
    warned = {(r.item, r.line, r.code) for r in issues.where("level = 'warning'").collect()}
    assert {("Call It", 2, "utterances"), ("Call It", 2, "few_styles"), ("Call It", 2, "no_code_mixed"), ("call", 3, "few_styles")} <= warned
    risk = {(r.source, r.item): r for r in V.item_risk(V.reviewed(goals, pairs, refs, intents), issues).collect()}
    assert risk["goals", "call"].nearest == "call" and risk["goals", "find_parts"].risk == 4.0


def test_intent_invariants(intents):
    bad = intents.withColumn("actuation", F.when(F.col("intent") == "radio", "comfort").when(F.col("intent") == "brake", "none").otherwise(F.col("actuation")))
    assert V.intent_violations(intents).isEmpty()
    assert {(r.intent, r.rule) for r in V.intent_violations(bad).collect()} == {("radio", "only vehicle_control has an actuation"), ("brake", "vehicle_control needs an actuation")}
