"""Decision, metric and text rules: hand cases, exhaustive invariants and partition independence."""

import time

from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import contexts, metrics, policy, similarity
from routeloom.plans import queries
from routeloom.vocab import REASONS


def test_invariants_hold_on_every_tag_triple_and_context(spark):
    m = contexts.route_map(spark).cache()
    assert m.count() == 96 * 288
    assert m.where("actuation = 'safety_critical' and route <> 'LOCAL'").isEmpty()
    assert m.where("sensitive and route = 'CLOUD'").isEmpty()
    assert m.where("capability = 'cloud_preferred' and route = 'DEFER'").isEmpty()
    assert m.where("connectivity = 'none' and route like 'CLOUD%'").isEmpty()
    assert {r.reason for r in m.select("reason").distinct().collect()} == set(REASONS)


def test_default_policy_is_valid_and_a_broken_one_is_not(spark):
    assert policy.violations(spark, policy.Policy()).isEmpty()
    bad = policy.Policy(actuation_gate=policy.Policy().actuation_gate | {"safety_critical|high": False}, passenger_relax_steps=-1, strict_privacy_route="CLOUD")
    rules = {r.rule.split(":")[0] for r in policy.violations(spark, bad).collect()}
    assert {"actuation_gate", "passenger_relax_steps", "strict_privacy_route"} <= rules
    assert policy.Policy.from_json(policy.Policy().to_json()) == policy.Policy()


def test_six_row_metric_case(spark):
    rows = [("LOCAL", "CLOUD", True), ("LOCAL", "REFUSE", False), ("CLOUD_MASKED", "CLOUD", False), ("REFUSE", "LOCAL", False), ("REFUSE", "DEFER", False), ("REFUSE", "REFUSE", False)]
    df = spark.createDataFrame([("all", *r) for r in rows], "g string, y string, p string, safety boolean")
    r = metrics.report(df, ["g"]).first()
    assert (r.n, r.critical_misses, r.n_critical) == (6, 2, 4)
    assert abs(r.macro_f1 - 2 / 5 / 5) < 1e-6
    assert abs(r.swe - (10 + 3 + 8 + 6 + 4 + 0) / 6) < 1e-6 and abs(r.accuracy - 1 / 6) < 1e-6


def test_mcc_of_diagonal_swapped_and_single(spark):
    rows = [("d", "LOCAL", "LOCAL"), ("d", "CLOUD", "CLOUD"), ("s", "LOCAL", "CLOUD"), ("s", "CLOUD", "LOCAL"), ("o", "LOCAL", "LOCAL")]
    df = spark.createDataFrame([(*r, False) for r in rows], "g string, y string, p string, safety boolean")
    assert {r.g: r.mcc for r in metrics.report(df, ["g"]).collect()} == {"d": 1.0, "s": -1.0, "o": 0.0}


def test_route_class_weights(spark):
    got = {r.route: round(r.weight, 3) for r in metrics.class_weights(spark).collect()}
    assert got == {"LOCAL": 1.207, "CLOUD": 0.517, "CLOUD_MASKED": 0.920, "DEFER": 0.632, "REFUSE": 1.724}


def test_text_rules(spark):
    df = spark.createDataFrame([("Call  Ravi at the Café?",), ("it's {slot} 1234 a b",), ("",)], "t string")
    got = [tuple(r) for r in df.select(X.normalize(F.col("t")), X.content_tokens(F.col("t")), X.format_errors(F.col("t"))).collect()]
    assert got[0][0] == "call ravi at the café" and "non_ascii" in got[0][2] and "uppercase" in got[0][2]
    assert got[1][1] == ["its", "<num>", "b"] or got[1][1] == ["<num>", "b"]
    assert got[1][2] == ["long_number"] and got[2][2] == ["empty"]


def test_two_jaccards_differ_on_empty_sets(spark):
    df = spark.sql("select cast(array() as array<string>) a, cast(array() as array<string>) b")
    assert tuple(df.select(X.jaccard(F.col("a"), F.col("b")), X.token_jaccard(F.col("a"), F.col("b"))).first()) == (1.0, 0.0)


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([("é1😀22",)], "t string")
    assert [tuple(s) for s in df.select(X.token_spans(F.col("t"), "[0-9]+")).first()[0]] == [(1, 2, "1"), (3, 5, "22")]


def test_best_overlap_falls_back_to_the_first(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["q"])], "id long, toks array<string>")
    b = spark.createDataFrame([(5, ["z"]), (7, ["x"]), (8, ["y"])], "ref long, toks array<string>")
    assert {r.id: (r.ref, r.score) for r in similarity.best_overlap(a, b).collect()} == {1: (7, 1.0), 2: (5, 0.0)}


def test_bootstrap_interval_holds_the_point(spark):
    d = "/root/testdata/sf0.001"
    wide = {r.split: r for r in queries()["bootstrap_intervals"](spark, d).collect()}
    point = {r.subset.removeprefix("split:"): r for r in queries()["route_report"](spark, d).collect() if r.subset.startswith("split:")}
    for s, w in wide.items():
        assert w.swe_low <= point[s].swe <= w.swe_high


def test_stream_equals_batch(spark, tmp_path):
    from routeloom.operators.decide import route_columns
    from routeloom.sources.tables import requests
    from routeloom.streaming.routes import file_stream, route_stream

    rows = requests(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "in"))
    q = route_stream(file_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    batch = route_columns(rows)
    assert batch.exceptAll(spark.table("streamed")).isEmpty() and spark.table("streamed").count() == batch.count()


def test_noise_edits_are_from_the_table_and_keep_slots(spark):
    from routeloom.functions import noise

    rows = [(1, "call {the} heater ?"), (2, "{call}"), (3, "the"), (4, ""), (5, None), (6, "play list"), (7, "call the heater two please")]
    df = spark.createDataFrame(rows, "id long, t string")
    found = {r.id: {tuple(e) for e in r.e} for r in df.where("t is not null").select("id", noise.candidate_edits(noise.spoken(F.col("t"))).alias("e")).collect()}
    assert found[1] == {("homophone", 0, 1, "cool"), ("homophone", 2, 1, "eater")}
    assert found[2] == found[3] == found[4] == set()
    assert found[6] == {("homophone", 0, 1, "pray"), ("merge_split", 0, 2, "playlist")}
    out = {r.id: r.h for r in df.select("id", noise.misheard(F.col("t"), F.col("id").cast("string")).alias("h")).collect()}
    assert out[1] in {"cool {the} heater", "call {the} eater", "cool {the} eater"} and out[6] in {"pray list", "playlist"}
    assert [out[i] for i in (2, 3, 4, 5)] == [None] * 4 and out[7] != rows[6][1]


def test_dropped_words_keep_numbers_and_move_offsets(spark):
    from routeloom.functions import noise

    df = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("w", F.array(*map(F.lit, ["go", "to", "{x}", "12", "now"])))
    every = df.select(noise.drop_words(F.col("w"), F.col("id"), 1.0).alias("o")).select("o.*").collect()
    assert [(r.text, r.starts) for r in every] == [("{x} 12", [0, 4])] * 2
    assert df.select(noise.drop_words(F.array(F.lit("go")), F.col("id"), 1.0).alias("o")).first().o.text == "go"


def test_spans_decode_detect_and_score(spark):
    from routeloom.operators import spans

    tags = ["B-a", "I-a", "B-a", "O", "I-b", "I-a", "I-a"]
    toks = spark.createDataFrame([(1, i, i, i + 1, t) for i, t in enumerate(tags)], "id int, pos int, start int, end int, tag string")
    assert sorted((r.start, r.end, r.label) for r in spans.decode(toks, "id").collect()) == [(0, 2, "a"), (2, 3, "a"), (4, 5, "b"), (5, 7, "a")]
    found = spark.createDataFrame([("x 12345 67890 and 4321",)], "t string").select(spans.detect(F.col("t"), {"long": "[0-9]{5} [0-9]{5}", "code": "[0-9]{4,6}"}).alias("s")).first().s
    assert [tuple(s) for s in found] == [(2, 13, "long"), (18, 22, "code")]
    kind = "array<struct<start:int,end:int>>"
    rows = spark.createDataFrame([("k", "ab cd", [(0, 5)], [(0, 2), (3, 5)]), ("k", "ab", [(0, 2)], []), ("k", "ab", [(0, 2)], [(0, 2)])], f"s string, text string, truth {kind}, found {kind}")
    r = spans.scores(rows, "s", F.lit(True)).where("s = 'k'").first()
    assert (r.n_true, r.n_found, r.n_exact, round(r.leak_rate, 3)) == (3, 3, 1, 0.333)


def test_tags_take_time_by_tokens_not_by_their_square(spark):
    n = 3000
    at = lambda i, size: F.struct((i * 10).cast("int").alias("start"), (i * 10 + size).cast("int").alias("end"), F.lit("x").alias("label"))
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(i, 5)).alias("tokens"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: at(i * 2, 15)).alias("spans"))
    began = time.monotonic()
    tags = df.select(X.bio_tags(F.col("tokens"), F.col("spans"))).first()[0]
    assert time.monotonic() - began < 20
    assert tags == ["B-x", "I-x"] * 50 + ["O"] * (n - 100)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_searched_once_for_each_part(spark):
    plan = _optimized(queries()["sensitive_flags"](spark, "/root/testdata/sf0.001"))
    assert plan.count("RLIKE") == 4
    heard = _optimized(queries()["misheard"](spark, "/root/testdata/sf0.001"))
    assert not [x for x in heard.splitlines() if "Filter" in x and "md5" in x], "a filter mishears every utterance again"
    tokens = _optimized(queries()["span_tokens"](spark, "/root/testdata/sf0.001"))
    assert "CASE WHEN RLIKE" in tokens or "CASE WHEN text" in tokens, "texts without runs of digits are not cut into words"


def test_names_after_line_marks_and_white_space(spark):
    from routeloom.operators import spans

    texts = {"a A": [(2, 3)], "a. A": [], "a I Bo": [(4, 6)], " A": [], "x\n\t Él.": [(4, 7)], "a.  A": [], "  A": [(2, 3)], "a Ib I c": [(2, 4), (5, 8)], "Bo": [], "": []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.detect_personal(F.col("t")).alias("s"), X.detect_sensitive(F.col("t")).alias("d")).collect()
    for r in rows:
        assert [(s.start, s.end) for s in r.s] == texts[r.t] and r.d == bool(texts[r.t]), r
    plan = _optimized(spark.createDataFrame([("a",)], "t string").select(spans.detect_personal(F.col("t"))))
    assert ", \\S+, 0)" not in plan, "no list of all words is made"
