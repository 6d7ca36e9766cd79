"""Replies against a plain parser, second requests, prediction records and the hashed model."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from routeloom.operators import predict, replies
from routeloom.vocab import ROUTES, TAGS

REPLIES = [
    '{"paraphrases": [{"text": " a ", "variant": "plain"}, {"text": "b"}, {"text": "c", "variant": 3}, {"text": "d", "variant": null}]}', "no", '{"x": 1}', "[]", "3", '"s"', "null", "", None, '{"paraphrases": null}', '{"paraphrases": "x"}',
    '{"paraphrases": []}', '{"paraphrases": [{"text": "a"}, 5, null, {"variant": "plain"}, {"text": null}, {"text": 1}, {"text": ["a"]}, []]}', '{"paraphrases": [{"text": "a"}', '{"paraphrases": [{"text": "a", "more": {"deep": [1, 2]}}], "else": 1}',
]


def _plain(reply):
    """(faults, lines) as a plain parser sees them."""
    try:
        data = json.loads(reply)
    except (TypeError, json.JSONDecodeError):
        return [("$", "no_json")], []
    if not isinstance(data, dict):
        return [("$", "no_object")], []
    items = data.get("paraphrases")
    if not isinstance(items, list):
        return [("$.paraphrases", "no_list")], []
    found = [(f"$.paraphrases[{i}]", "no_object") if not isinstance(x, dict) else (f"$.paraphrases[{i}].text", "no_text") for i, x in enumerate(items) if not isinstance(x, dict) or not isinstance(x.get("text"), str)]
    return found, [] if found else [(i + 1, x["text"].strip(), str(x.get("variant"))) for i, x in enumerate(items)]


def test_replies_against_a_plain_parser(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "k int, reply string")
    items = replies.items_of(df, ["k"])
    got, lines = replies.faults(items, ["k"]).collect(), replies.lines_of(items, ["k"]).collect()
    for k, reply in enumerate(REPLIES):
        want = _plain(reply)
        assert sorted((r.path, r.code) for r in got if r.k == k) == sorted(want[0]), reply
        assert sorted((r.line, r.text, r.variant) for r in lines if r.k == k) == sorted(want[1]), reply
    assert replies.items_of(df.limit(0), ["k"]).count() == 0


def test_second_requests_list_the_errors_in_order(spark):
    asked = spark.createDataFrame([("i/0", "ask", "{}"), ("i/1", "ask", "{}")], "item string, prompt string, reply string")
    issues = spark.createDataFrame([("error", "lines", "i/0", 10, "b", ""), ("error", "lines", "i/0", 2, "a", "of 1"), ("warning", "lines", "i/1", 1, "w", "")], "level string, source string, item string, line long, code string, detail string")
    (r,) = replies.retry_texts(asked, issues).collect()
    assert r.item == "i/0" and r.text.startswith("ask\n\n" + replies.RETRY_HEAD) and "- item 2: a of 1\n- item 10: b\n" in r.text and r.text.endswith(replies.RETRY_TAIL)


def _outputs(spark, tags=True):
    context = {"speed": "parked", "connectivity": "good", "workload": "low", "privacy": "standard", "passenger": False, "tier": "tiny"}
    rows = [(1, [3.0, 1.0, 0.0, 0.0, 0.0], [0.0, 2.0, 2.0], ["B-contact", "I-contact"]), (2, [0.0] * 5, [1.0, 0.0, 0.0], ["O", "O"])]
    df = spark.createDataFrame(rows, "id long, route_logits array<double>, intent_logits array<double>, piece_tags array<string>").withColumns({k: F.lit(v) for k, v in context.items()})
    df = df.withColumns({"utterance": F.lit("ravi kumar"), "offsets": F.expr("array(struct(0 AS start, 4 AS end), struct(5 AS start, 10 AS end))")})
    cold = {"capability": [0.0, 0.0, 4.0, 0.0], "distraction": [5.0, 0.0, 0.0], "actuation": [2.0, 1.5, 0.0, 0.0], "consequence": [0.0, 1.0, 0.0]}
    return df.withColumns({f"{t}_logits": F.array(*map(F.lit, v)) for t, v in cold.items()}) if tags else df


def test_records_by_hand(spark):
    a, b = predict.record(_outputs(spark), ["x", "y", "z"], temperature=2.0, route_source="combined").orderBy("id").collect()
    soft = lambda xs, t=1.0: [math.exp(x / t) / sum(math.exp(y / t) for y in xs) for x in xs]
    assert a.route_probs == [round(p, 6) for p in soft([3, 1, 0, 0, 0])] and a.confidence == round(max(soft([3, 1, 0, 0, 0], 2)), 6)
    assert [tuple(x) for x in a.intent_probs_top3] == [("y", round(soft([0, 2, 2])[1], 6)), ("z", round(soft([0, 2, 2])[1], 6)), ("x", round(soft([0, 2, 2])[0], 6))] and a.intent == "y"
    assert [tuple(s) for s in a.spans] == [(0, 10, "contact", "ravi kumar")] and b.spans == []
    # the safe reading of the actuation decides: 0.3 of safety_critical is enough
    assert a.tags == {"capability": "needs_cloud", "distraction": "low", "actuation": "safety_critical", "consequence": "reversible"} and a.route_tags == "LOCAL" == a.route and a.route_e2e == "LOCAL"
    assert set(a.tag_probs["actuation"]) == set(TAGS["actuation"])
    c = predict.record(_outputs(spark), ["x", "y", "z"], conservative=False).where("id = 1").first()
    assert c.tags["actuation"] == "none" and c.route_tags == "CLOUD_MASKED" and c.route == c.route_e2e == "LOCAL"
    plain = predict.record(_outputs(spark, tags=False), ["x", "y", "z"])
    assert "tags" not in plain.columns and plain.where("id = 2").first().route == ROUTES[0]
    assert predict.by_source(predict.record(_outputs(spark), ["x", "y", "z"]), "tags").where("id = 1").first().route == "LOCAL"
    for bad in (lambda: predict.record(_outputs(spark, tags=False), ["x"], route_source="tags"), lambda: predict.record(_outputs(spark), ["x"], route_source="?"), lambda: predict.by_source(plain, "tags")):
        with pytest.raises(ValueError):
            bad()


def test_hashed_model_gives_logits(spark):
    rng = random.Random(1)
    words = {"LOCAL": "window seat fan", "CLOUD": "news weather score", "REFUSE": "disable airbag brakes"}
    rows = [(i, " ".join(rng.choice((words[c] + " please now the").split()) for _ in range(6)) + " " + rng.choice(words[c].split()), c, 1.0 + (c == "REFUSE")) for i, c in enumerate(rng.choice(list(words)) for _ in range(400))]
    df = spark.createDataFrame([*rows, (900, None, "LOCAL", 1.0), (901, "x", "ELSE", 1.0)], "id long, text string, y string, w double")
    classes = ["LOCAL", "CLOUD", "REFUSE"]
    model = predict.train(df.where("id < 300 OR id >= 900"), "text", "y", classes, weight="w", features=1 << 10)
    scored = predict.logits(model, df.where("id >= 300"), "text", "route_logits")
    assert scored.columns == [*df.columns, "route_logits"] and scored.count() == 102
    hits = scored.where("id < 900").select(F.element_at(F.array(*map(F.lit, classes)), F.array_position("route_logits", F.array_max("route_logits")).cast("int")).alias("p"), "y").where("p = y").count()
    assert hits >= 90
