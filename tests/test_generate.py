"""Fills, encoding, stored files and scores: properties, round trips and plain versions."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from routeloom.functions import encode
from routeloom.functions import text as X
from routeloom.operators import fills, policy, scoring, spans
from routeloom.sources import files

POOLS = {"contact": ["Ravi Kumar", "Asha"], "relation": ["mom", "dad"], "address": ["12 Hill Road"], "place": ["the office", "home", "school"], "duration": ["an hour"]}


def test_fills(spark):
    seeds = spark.createDataFrame([("a/0", "a", "call {contact} and {contact}"), ("a/1", "a", "text {phone} the {otp} of {card}"), ("b/0", "b", "go to {place}"), ("b/1", "b", "stop"), ("c/0", "c", "for {duration}")], "seed_id string, intent string, text string")
    got = {}
    for r in fills.fills(seeds, POOLS, {("c", "duration"): ["two days", "a week"]}).orderBy("seed_id", "fill").collect():
        got.setdefault(r.seed_id, []).append((r.utterance, [tuple(s) for s in r.spans]))
    assert [len(got[k]) for k in ("a/0", "a/1", "b/0", "b/1", "c/0")] == [3, 2, 2, 1, 2]
    for text, found in got["a/0"][:2]:
        assert len(found) == 2 and found[0][3] == found[1][3] and all(text[a:b] == t and label == "contact" for a, b, label, t in found)
    assert got["a/0"][2][0] in ("call mom and mom", "call dad and dad") and got["a/0"][2][1] == []
    for text, found in got["a/1"]:
        assert [s[2] for s in found] == ["phone", "otp", "card"] and all(text[a:b] == t for a, b, _, t in found)
        assert re.fullmatch(r"(?:\+91 )?[6-9]\d{4} ?\d{5}", found[0][3]) and len(found[1][3]) in (4, 6) and len(found[2][3]) == 4
    assert got["b/1"] == [("stop", [])] and {t for t, _ in got["c/0"]} == {"for two days", "for a week"} and len({t for t, _ in got["b/0"]}) == 2
    again = {(r.seed_id, r.fill, r.utterance) for r in fills.fills(seeds.repartition(3), POOLS, {("c", "duration"): ["two days", "a week"]}).collect()}
    assert again == {(k, i, t) for k, v in got.items() for i, (t, _) in enumerate(v)}
    with pytest.raises(Exception, match="no values for slot"):
        fills.fills(spark.createDataFrame([("x", "x", "{song}")], seeds.schema), POOLS).collect()


def test_encoding(spark):
    df = spark.createDataFrame([("[a=b]", "call Ravi at 5.30 now", [(5, 9, "contact")])], "prefix string, u string, spans array<struct<start:int,end:int,label:string>>")
    text, start = encode.input_text(F.col("prefix"), F.col("u"))
    r = df.select(encode.encoded(text, start, F.col("spans")).alias("e"), text.alias("t")).first()
    assert r.e.tokens == ["[", "a", "=", "b", "]", "call", "Ravi", "at", "5.30", "now"] and r.t == "[a=b] call Ravi at 5.30 now"
    assert [tuple(o) for o in r.e.offsets] == [(-1, -1)] * 5 + [(0, 4), (5, 9), (10, 12), (13, 17), (18, 21)] and r.e.tags == [None] * 5 + ["O", "B-contact", "O", "O", "O"]
    at = "array<struct<start:int,end:int>>"
    cases = [([(0, 2), (2, 2), (3, 5), (5, 5), (6, 7), (-1, -1), (8, 9)], ["I-a", "O", "I-a", "I-a", "B-a", None, "I-a"]), ([(0, 1), (1, 2), (2, 3)], ["B-a", "I-b", "O"])]
    back = spark.createDataFrame(cases, f"o {at}, t array<string>").select(encode.spans_from_tags(F.col("o"), F.col("t"), F.lit("abcdefghij")).alias("s")).collect()
    assert [[tuple(s) for s in x.s] for x in back] == [[(0, 5, "a", "abcde"), (6, 9, "a", "ghi")], [(0, 1, "a", "a"), (1, 2, "b", "b")]]
    one = spark.range(1)
    v = one.select(
        encode.label_index(F.lit("b"), ["a", "b"]).alias("i"), encode.label_index(F.lit("b"), ["a", "b"], F.lit(True)).alias("s"), encode.label_index(F.lit("z"), ["a"]).alias("u"),
        encode.padded(F.array(F.lit(1)), F.lit(3), -100).alias("p"), encode.linear_rate(F.lit(5), 10, 100).alias("w"), encode.linear_rate(F.lit(55), 10, 100).alias("d"),
        encode.mean_pooled(F.expr("array(array(1D, 2D), array(3D, 6D), array(9D, 9D))"), F.expr("array(1, 1, 0)")).alias("m"), encode.last_pooled(F.expr("array(array(1D, 2D), array(3D, 6D), array(9D, 9D))"), F.expr("array(1, 1, 0)")).alias("l"),
        encode.tag_counts(F.expr("array('B-a', null, 'O', 'I-a')"), F.expr("array('B-a', 'B-a', 'I-a', 'O')")).alias("c"), encode.rendered("{x} and {y} {z}", {"x": F.lit("{y}"), "y": F.lit("1")}).alias("r"),
    ).first()
    assert (v.i, v.s, v.u, v.p, v.w, v.d, v.m, v.l, tuple(v.c), v.r) == (1, -100, -100, [1, -100, -100], 0.5, 0.5, [2.0, 4.0], [3.0, 6.0], (1, 2, 2), "{y} and 1 {z}")


def _plain_spans(text):
    found = []

    def add(a, b, label):
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, label))

    runs = []
    for m in re.finditer(r"\+91|(?<![0-9])(?:[0-9][\s-]?){9}[0-9](?![0-9])", text):
        if runs and not text[runs[-1][1] : m.start()].strip():
            runs[-1][1] = m.end()
        else:
            runs.append([*m.span()])
    for a, b in runs:
        add(a, b, "phone")
    for m in re.finditer(r"(?i)\bending\s+([0-9]+)", text):
        add(*m.span(1), "card")
    for m in re.finditer(r"(?<![0-9.:])[0-9]{4,6}(?![0-9.:])", text):
        add(*m.span(), "otp")
    words = list(re.finditer(r"\S+", text))
    for p, w in zip(words, words[1:], strict=False):
        if w[0][:1].isupper() and w[0] != "I" and p[0][-1] not in ".!?":
            add(*w.span(), "contact")
    return sorted(found)


def test_detected_spans_match_a_plain_version(spark):
    import random

    r = random.Random(4)
    bits = ["+91", "98765", "43210", "9876543210", "1234", "12.30", "card ending", "ending", " ", " ", " ", "-", "Ravi", "call", "I", "Asha.", "ok?", "é", "55"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 12))) for _ in range(800)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans.detect_personal(F.col("t")).alias("s"), X.detect_sensitive(F.col("t")).alias("d")).collect()
    for x in got:
        want = _plain_spans(texts[x.i])
        assert [tuple(s) for s in x.s] == want, texts[x.i]
        assert x.d == bool(want or re.search(r"(?i)\bcard ending\b", texts[x.i])), texts[x.i]


def test_stored_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "seeds.yaml").write_text("call:\n  - {text: call {contact}, style: command}\n".replace("call {contact}", '"call {contact}"') + 'stop:\n  - {text: "stop", style: fragment}\n')
    (tmp_path / "l" / "call.yaml").write_text('# head\n"0":\n  - {text: "ring \\"{contact}\\"", variant: disfluent}\n  - {text: "b", variant: plain}\n"2":\n  - {text: "c", variant: plain}\n')
    u = lambda p: f"file://{tmp_path}/{p}"
    assert [tuple(r) for r in files.read_seeds(spark, u("seeds.yaml")).orderBy("ord").collect()] == [(0, "call", 0, "call {contact}", "command"), (1, "stop", 0, "stop", "fragment")]
    lines = files.read_lines(spark, u("l"))
    assert sorted(map(tuple, lines.collect())) == [("call", 0, 0, 'ring "{contact}"', "disfluent", 3), ("call", 0, 1, "b", "plain", 4), ("call", 2, 0, "c", "plain", 6)]
    assert files.read_lines(spark, u("nowhere")).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "call.yaml").write_text(files.line_files(lines).first().text)
    assert sorted(tuple(r)[:1] + (r.seed_index, r.text) for r in files.read_lines(spark, u("m")).collect()) == [("call", 0, "b"), ("call", 0, 'ring "{contact}"'), ("call", 2, "c")]
    for bad, why in (('"0":\n  - {text: a}\n', "line 2: keys"), ('"0": []\n"0": []\n', "repeats"), ("x: []\n", "no seed's number")):
        (tmp_path / "m" / "call.yaml").write_text(bad)
        with pytest.raises(Exception, match=why):
            files.read_lines(spark, u("m")).collect()
    (tmp_path / "goals.yaml").write_text("- name: g\n  description: d\n  rationale: r\n  group: planning\n  capability: local_ok\n  distraction: low\n  actuation: none\n  consequence: none\n  utterances:\n    - {text: x, style: command, variant: plain}\n")
    g = files.read_goals(spark, u("goals.yaml")).first()
    assert (g.name, g.grp, g.line, [tuple(x) for x in g.utterances]) == ("g", "planning", 1, [("x", "command", "plain", 10)])
    (tmp_path / "pairs.yaml").write_text("- id: p\n  differs_in: [capability]\n  note: n\n  a: {intent: i, text: x, style: command, variant: plain}\n  b: {intent: j, text: y, style: command, variant: plain}\n")
    p = files.read_pairs(spark, u("pairs.yaml")).first()
    assert (p.id, p.differs_in, tuple(p.a), tuple(p.b)) == ("p", ["capability"], ("i", "x", "command", "plain", 4), ("j", "y", "command", "plain", 5))
    (tmp_path / "policy.json").write_text(policy.Policy().to_json())
    (tmp_path / "costs.json").write_text(json.dumps({"costs": policy.COSTS}))
    (tmp_path / "labels.json").write_text('{"routes": ["A"]}')
    assert files.read_policy(spark, u("policy.json")) == policy.Policy() and files.read_costs(spark, u("costs.json")) == policy.COSTS
    assert files.read_labels(spark, u("labels.json"), {"tags": ["t"], "routes": []}) == {"tags": ["t"], "routes": ["A"]}
    preds = spark.createDataFrame([("1", "LOCAL", "CLOUD", "CLOUD_MASKED")], "id string, route_e2e string, route_tags string, route_combined string").withColumn("route", F.lit("x"))
    files.write_predictions(files.with_route_sources(preds), u("preds"), by_source=True)
    assert {(r.route_source, r.route) for r in spark.read.json(u("preds")).collect()} == {("e2e", "LOCAL"), ("tags", "CLOUD"), ("combined", "CLOUD_MASKED")}
    assert files.read_predictions(spark, u("preds/*")).select("id", "confidence").first() == ("1", None)
    m = files.manifest(lines.withColumn("split", F.lit("train")), {"seed": 1})
    assert m["rows"] == 3 and m["digest"] == files.manifest(lines.withColumn("split", F.lit("train")).repartition(3), {})["digest"] and m["counts"] == {"split": {"train": 3}}


def test_rows_are_read_back_with_defaults(spark, tmp_path):
    from routeloom.sources.tables import read_rows, write_rows
    from routeloom.vocab import ROW

    rows = spark.createDataFrame([{"id": "a", "split": "train", "source": "asr"}, {"id": "b", "split": "test", "is_synthetic": True}], ROW)
    for name in ("rows.jsonl", "rows.parquet"):
        write_rows(rows, f"file://{tmp_path}/{name}")
        got = {r.id: (r.split, r.source, r.variant, r.is_synthetic) for r in read_rows(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {"a": ("train", "asr", "plain", False), "b": ("test", "seed", "plain", True)}
        assert [r.id for r in read_rows(spark, f"file://{tmp_path}/{name}", ["test"]).collect()] == ["b"]
        assert [r.id for r in read_rows(spark, f"file://{tmp_path}/{name}", " test , ood").collect()] == ["b"]
        assert read_rows(spark, f"file://{tmp_path}/{name}", "all").count() == 2


def test_records_leave_out_defaults(spark):
    from routeloom.sources.tables import from_records, records, with_intent_tags
    from routeloom.vocab import ROW, TAGS

    rows = spark.createDataFrame([{"id": "a", "source": "asr", "variant": "asr", "is_synthetic": False}, {"id": "b", "source": "minimal_pair", "variant": "plain", "is_synthetic": False, "pair_id": "p"}], ROW)
    texts = [json.loads(r.value) for r in records(rows, include_source=False).collect()]
    assert texts == [{"id": "a"}, {"id": "b", "source": "minimal_pair", "variant": "plain", "is_synthetic": False, "pair_id": "p"}]
    blank = spark.createDataFrame([("",), ("  ",), ('{"id": "c"}',)], "value string")
    assert [(r.id, r.source, r.is_synthetic) for r in from_records(blank).collect()] == [("c", "seed", False)]
    with pytest.raises(Exception, match="MALFORMED"):
        from_records(spark.createDataFrame([('{"id": ',)], "value string")).collect()
    intents = spark.createDataFrame([("stop", *["x"] * len(TAGS))], ["intent", *TAGS])
    own = [("stop", False), ("stop", True), ("other", False), ("stop", None)]
    tagged = with_intent_tags(spark.createDataFrame([(n, i, s, *["y"] * len(TAGS)) for n, (i, s) in enumerate(own)], ["n", "intent", "is_synthetic", *TAGS]), intents)
    assert [r.actuation for r in tagged.orderBy("n").collect()] == ["x", "y", "y", "x"]


def test_cost_matrix_checks(spark):
    assert policy.cost_violations(spark, policy.COSTS).isEmpty()
    bad = {t: dict(r) for t, r in policy.COSTS.items()}
    del bad["DEFER"]["CLOUD"]
    bad["CLOUD"] |= {"CLOUD": 1, "LOCAL": -2, "DEFER": True, "EXTRA": 0}
    assert {(r.rule, r.cell) for r in policy.cost_violations(spark, bad).collect()} == {
        ("missing", "DEFER|CLOUD"), ("unexpected", "CLOUD|EXTRA"), ("no number of 0 or more", "CLOUD|LOCAL"), ("no number of 0 or more", "CLOUD|DEFER"), ("a right route has a cost", "CLOUD|CLOUD"),
    }


def test_intents_are_scored_only_when_all_are_named(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "a"), ("train", "a", "b"), ("test", "b", "b")], "split string, intent string, predicted string")
    assert {(r.split, r.n, r.accuracy) for r in scoring.intent_scores(df).collect()} == {(None, 3, 0.666667), ("train", 2, 0.5), ("test", 1, 1.0)}
    assert scoring.intent_scores(df.union(spark.createDataFrame([("test", "b", None)], df.schema))).isEmpty()
    for run, x in (("r2", 0.5), ("r1", 0.25)):
        (tmp_path / f"{run}.json").write_text(json.dumps({"route": {"overall": {"swe": x}}}, indent=1))
    assert [tuple(r) for r in scoring.compared_runs(spark, f"file://{tmp_path}", {"swe": "$.route.overall.swe"}).collect()] == [("r1", 0.25), ("r2", 0.5)]


def test_fills_are_drawn_only_while_they_are_wanting(spark):
    seeds = spark.range(200).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("seed_id"), F.lit("x").alias("intent"), F.lit("call {contact} on {phone} with {otp}").alias("text"))
    few = {(r.seed_id, r.fill): r.utterance for r in fills.fills(seeds, POOLS).collect()}
    began = time.monotonic()
    many = {(r.seed_id, r.fill): r.utterance for r in fills.fills(seeds, POOLS, tries=10_000).collect()}
    assert time.monotonic() - began < 30 and many == few and len(few) == 400
