"""Queries over metrics, calibration and post-logit decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.functions.text import softmax
from routeloom.operators import calibrate, decide, metrics, predict
from routeloom.operators.policy import COSTS
from routeloom.plans.routing import DECIDED, REQUESTS
from routeloom.plans.routing import decided as decided_sql
from routeloom.sources.tables import predictions, requests, table
from routeloom.vocab import DANGEROUS, ROUTES, TAGS

PRED = DECIDED + """, p AS (
    SELECT event_id, route AS y, CASE WHEN event_id % 11 < 2 THEN (['LOCAL','CLOUD','CLOUD_MASKED','DEFER','REFUSE'])[event_id % 5 + 1] ELSE route END AS p,
        actuation = 'safety_critical' AS safety, k / 100.0::DOUBLE AS conf, CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, sensitive FROM d)"""
COST = "cost(true_row, p, cost) AS (VALUES " + ", ".join(f"('{t}', '{p}', {float(c)}::DOUBLE)" for t, row in COSTS.items() for p, c in row.items()) + ")"
SCORED = PRED + f""", {COST}, s AS (
    SELECT p.*, cost.cost, (y = 'LOCAL' AND safety) OR y = 'REFUSE' AS eligible,
        (y = 'LOCAL' AND safety AND p.p IN ('CLOUD','CLOUD_MASKED')) OR (y = 'REFUSE' AND p.p IN ('CLOUD','CLOUD_MASKED','LOCAL')) AS missed
    FROM p JOIN cost ON cost.p = p.p AND cost.true_row = CASE WHEN y <> 'LOCAL' THEN y WHEN safety THEN 'LOCAL_SAFETY_CRITICAL' ELSE 'LOCAL_OTHER' END),
    u AS (SELECT *, unnest(list_filter(['overall', 'split:' || split, CASE WHEN sensitive THEN 'sensitive' END], lambda x: x IS NOT NULL)) AS subset FROM s)"""


def _subsets() -> dict:
    s = F.col("split")
    return {"overall": F.lit(True), "split:train": s == "train", "split:val": s == "val", "split:test": s == "test", "sensitive": F.col("sensitive")}


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return metrics.confusion(predictions(spark, d), ["split"])


def class_report(spark: SparkSession, d: str) -> DataFrame:
    """A7, A17."""
    cells = metrics.confusion(metrics.in_subsets(predictions(spark, d), _subsets()), ["subset"])
    c = metrics.per_class(cells, ["subset"])
    return c.select("subset", "route", "tp", "n_true", "n_pred", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def route_report(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of all subsets."""
    cells = metrics.cells_of(predictions(spark, d), ["split", "sensitive"])
    return metrics.report(metrics.in_subsets(cells, _subsets()), ["subset"], weight="n")


def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from 1000 keyed resamples."""
    b = metrics.bootstrap(predictions(spark, d), "split")
    return b.select("split", *[F.round(c, 6).alias(c) for c in ("swe_low", "swe_high", "f1_low", "f1_high")])


def joined_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels as predictions; a repeated or unknown id would end the job."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return metrics.joined(rows, table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"))


def prediction_problems(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions of orders; ids that repeat or match no order."""
    rows = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))
    preds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return metrics.problem_counts(rows, preds)


def tag_report(spark: SparkSession, d: str) -> DataFrame:
    """Decoded tags against true ones, dangerous misses counted."""
    r = requests(spark, d)
    wrong = lambda name, i: F.when(F.col("k") < 20 + 10 * i, F.element_at(decide.ARRAY(TAGS[name]), (F.col("k") % len(TAGS[name]) + 1).cast("int"))).otherwise(F.col(name))
    names = ("capability", "distraction", "actuation")
    each = r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tag"), F.col(n).alias("y"), wrong(n, i).alias("p"), (F.col(n).isin(DANGEROUS[n]) if DANGEROUS[n] else F.lit(False)).alias("danger")) for i, n in enumerate(names)])).alias("e")).select("e.*")
    bad = F.col("y") != F.col("p")
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg((~bad).cast("double")), 6).alias("accuracy"), F.count_if(bad).alias("errors"), F.count_if(F.col("danger")).alias("n_dangerous"), F.count_if(F.col("danger") & bad).alias("dangerous_misses"))


def decode_tags(spark: SparkSession, d: str) -> DataFrame:
    """Conservative decoding of tag probabilities."""
    e = _logits(spark, d).withColumn("a", softmax(F.slice("logits", 1, 4))).withColumn("b", softmax(F.slice("logits", 2, 3)))
    return e.select("vec_id", decide.decode_actuation(F.col("a")).alias("actuation"), decide.decode_distraction(F.col("b")).alias("distraction"))


def combined_routes(spark: SparkSession, d: str) -> DataFrame:
    """Two routes arbitrated."""
    p = predictions(spark, d)
    return p.select("event_id", decide.combine(F.col("p"), F.col("y"), F.col("actuation")).alias("route"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 5), lambda v: F.round(v.cast("double") * 10, 6))
    return table(spark, d, "embeddings").select("vec_id", x.alias("logits"), (F.col("label") % 5).alias("y"))


INTENTS = [f"i{i}" for i in range(10)]
#: Where the logits of each output stand in a vector: first place and number.
PLACES = {"route": (1, 5), "intent": (6, 10), "capability": (16, 4), "distraction": (20, 3), "actuation": (23, 4), "consequence": (27, 3)}
TEMPERATURE = 1.5


def prediction_records(spark: SparkSession, d: str) -> DataFrame:
    """Records from logits of vectors and contexts of requests."""
    cut = {f"{n}_logits": F.transform(F.slice("embedding", a, k), lambda v: F.round(v.cast("double") * 10, 6)) for n, (a, k) in PLACES.items()}
    e = table(spark, d, "embeddings").withColumns(cut).select(F.col("vec_id").alias("event_id"), *cut)
    at = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    named = F.col("event_id") % 3 == 0
    pieces = {"utterance": F.lit("call ravi kumar now"), "offsets": F.array(at(0, 4), at(5, 9), at(10, 15), at(16, 19)), "piece_tags": F.array(F.lit("O"), *[F.when(named, "I-contact").otherwise("O")] * 2, F.lit("O"))}
    context = requests(spark, d).select("event_id", "speed", "connectivity", "workload", "privacy", "passenger", "tier")
    p = predict.record(context.join(e, "event_id").withColumns(pieces).withColumnRenamed("event_id", "id"), INTENTS, temperature=TEMPERATURE, route_source="combined")
    joined = lambda xs: F.array_join(xs, ",")
    spans = joined(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"], s["text"])))
    return p.select(
        "id", "route", "intent", "confidence", "route_e2e", "route_tags", "route_combined", F.round(F.get("route_probs", F.lit(1)), 6).alias("p_cloud"), F.get("intent_probs_top3", F.lit(2))["p"].alias("p_third"),
        joined("intent_probs_top3.intent").alias("top3"), spans.alias("spans"), *[F.col("tags")[t].alias(t) for t in TAGS], F.col("tag_probs")["actuation"]["restricted"].alias("p_restricted"),
    )


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Bins of calibrated confidence."""
    b = calibrate.ece_bins(calibrate.with_probs(_logits(spark, d)))
    return b.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """A20, A21 at two temperatures."""
    parts = []
    for t in (1.0, 2.0):
        p = calibrate.with_probs(_logits(spark, d), t)
        parts.append(calibrate.ece(p).join(p.agg(F.avg("nll").alias("nll"))).select(F.lit(t).alias("t"), F.round("ece", 6).alias("ece"), F.round("nll", 6).alias("nll")))
    return parts[0].unionByName(parts[1])


def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    """The grid temperature of least loss."""
    best = calibrate.temperature_scan(_logits(spark, d)).agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "t")).alias("m"))
    return best.select(F.round("m.t", 6).alias("t"), F.round("m.nll", 6).alias("nll"))


def temperature_refined(spark: SparkSession, d: str) -> DataFrame:
    """The grid's best temperature refined by Newton steps."""
    t, nll, grid = calibrate.temperature(_logits(spark, d))
    return table(spark, d, "embeddings").agg(F.count("*").alias("n")).select("n", F.lit(round(t, 6)).alias("t"), F.lit(round(nll, 6)).alias("nll"), F.lit(round(grid, 6)).alias("grid_t"))


def top3(spark: SparkSession, d: str) -> DataFrame:
    """The three likeliest classes, lower class first on ties."""
    ranked = F.array_sort(F.transform("logits", lambda v, i: F.struct((-v).alias("minus"), i.alias("i"))))
    return _logits(spark, d).select("vec_id", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["i"].cast("string")), ",").alias("top"))


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    """A23, J20."""
    s = calibrate.threshold_scan(predictions(spark, d))
    return s.withColumns({"coverage": F.round("coverage", 6), "accuracy": F.round("accuracy", 6)})


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """A32."""
    return metrics.class_weights(spark)


def tag_weights(spark: SparkSession, d: str) -> DataFrame:
    """Danger over the root of frequency, unseen classes counted once, mean 1."""
    r = requests(spark, d)
    names = ("capability", "distraction", "actuation")
    seen = r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tag"), F.col(n).alias("value")) for n in names])).alias("e")).groupBy("e.tag", "e.value").agg(F.count("*").alias("n"))
    danger = {("actuation", "safety_critical"): 2.0, ("actuation", "restricted"): 2.0, ("distraction", "high"): 1.5}
    vocab = spark.createDataFrame([(n, v, danger.get((n, v), 1.0)) for n in names for v in TAGS[n]], "tag string, value string, danger double")
    raw = vocab.join(seen, ["tag", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("tag"))
    raw = raw.withColumn("w", F.col("danger") / F.sqrt(F.greatest(F.col("n"), F.lit(1)) / F.greatest(total, F.lit(1))))
    return raw.select("tag", "value", F.round(F.col("w") / F.avg("w").over(Window.partitionBy("tag")), 6).alias("weight"))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    """Linear warm-up and decay."""
    s = F.col("id").cast("double")
    return spark.range(0, 101).select(F.col("id").alias("step"), F.round(F.when(s < 10, s / 10).otherwise(F.greatest(F.lit(0.0), (100 - s) / 90)), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (confusion, class_report, route_report, bootstrap_intervals, joined_predictions, prediction_problems, tag_report, decode_tags, prediction_records, combined_routes, calibration, calibration_error, temperature_fit, temperature_refined, top3, threshold_scan, class_weights, tag_weights, schedule)}

LOGITS = "WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: round(v::DOUBLE * 10, 6)) AS x, label % 5 AS y FROM embeddings)"
_SOFT = lambda x, t="1": f"list_transform({x}, lambda v: exp((v - list_max({x})) / {t}))"
_CLASS = """c AS (SELECT subset, route, sum(tp) AS tp, sum(t) AS n_true, sum(q) AS n_pred FROM (
    SELECT subset, y AS route, (y = p)::INT AS tp, 1 AS t, 0 AS q FROM u UNION ALL SELECT subset, p, 0, 0, 1 FROM u) GROUP BY ALL)"""
_NAMES = {"capability": TAGS["capability"], "distraction": TAGS["distraction"], "actuation": TAGS["actuation"]}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_THRESHOLDS = ", ".join(f"{t}::DOUBLE" for t in calibrate.THRESHOLDS)
ORACLE = {
    "confusion": f"{PRED} SELECT split, y, p, count(*) AS n FROM p GROUP BY ALL",
    "class_report": f"{SCORED}, {_CLASS} SELECT subset, route, tp::BIGINT AS tp, n_true::BIGINT AS n_true, n_pred::BIGINT AS n_pred, round(coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(n_true, 0)::DOUBLE, 0), 6) AS recall, round(2 * tp / (n_true + n_pred)::DOUBLE, 6) AS f1 FROM c",
    "route_report": f"""{SCORED}, {_CLASS}, f AS (SELECT subset, avg(2 * tp / (n_true + n_pred)::DOUBLE) AS f1, sum(tp)::DOUBLE AS c, sum(n_true * n_pred)::DOUBLE AS tp2, sum(n_true * n_true)::DOUBLE AS t2, sum(n_pred * n_pred)::DOUBLE AS p2 FROM c GROUP BY subset),
        b AS (SELECT subset, count(*) AS n, avg((y = p)::INT) AS accuracy, avg(cost) AS swe, count(*) FILTER (missed) AS critical_misses, count(*) FILTER (eligible) AS n_critical FROM u GROUP BY subset),
        m AS (SELECT *, sqrt(n::DOUBLE * n - p2) * sqrt(n::DOUBLE * n - t2) AS den FROM b JOIN f USING (subset))
        SELECT subset, n, round(accuracy, 6) AS accuracy, round(swe, 6) AS swe, round(f1, 6) AS macro_f1, round(CASE WHEN den > 0 THEN (c * n - tp2) / den ELSE 0 END, 6) AS mcc, critical_misses, n_critical, round(critical_misses / nullif(n_critical, 0)::DOUBLE, 6) AS critical_miss_rate FROM m""",
    "bootstrap_intervals": SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
        cells AS (SELECT split, CASE WHEN y <> 'LOCAL' THEN y WHEN safety THEN 'LOCAL_SAFETY_CRITICAL' ELSE 'LOCAL_OTHER' END AS true_row, y, p, cost, count(*) AS n FROM s GROUP BY ALL),
        ix AS (SELECT *, row_number() OVER w - 1 AS i, sum(n) OVER (PARTITION BY split ORDER BY true_row, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight, sum(n) OVER (PARTITION BY split) AS total
            FROM cells WINDOW w AS (PARTITION BY split ORDER BY true_row, p)),
        draw AS (
            SELECT split, b, -1::BIGINT AS i, total::BIGINT AS rest, 0::BIGINT AS k FROM (SELECT DISTINCT split, total FROM ix), range(1000) t(b)
            UNION ALL
            SELECT split, b, i, rest - k, k FROM (
                SELECT split, b, i, rest, CASE WHEN p > 0.5 THEN rest - few ELSE few END::BIGINT AS k FROM (
                    SELECT *, CASE WHEN q = 0 THEN 0 WHEN rest * q < {metrics.EXACT_MEAN} THEN least(rest, list_reduce(range(0, {metrics.MOST_TERMS}),
                            lambda a, j: CASE WHEN a.cdf >= u THEN a ELSE {{'k': a.k + 1, 'pmf': a.pmf * (rest - a.k) / (a.k + 1) * q / (1 - q), 'cdf': a.cdf + a.pmf * (rest - a.k) / (a.k + 1) * q / (1 - q)}} END,
                            {{'k': 0::DOUBLE, 'pmf': exp(rest * ln(1 - q)), 'cdf': exp(rest * ln(1 - q))}}).k)
                        ELSE greatest(0, least(rest, floor(rest * q + z * sqrt(rest * q * (1 - q)) + (1 - 2 * q) * (z * z - 1) / 6 + 0.5))) END AS few FROM (
                        SELECT *, least(p, 1 - p) AS q, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM (
                            SELECT draw.split, draw.b, ix.i, draw.rest, ix.n / ix.weight::DOUBLE AS p, (('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u, (('0x' || substr(h, 14, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS v
                            FROM (SELECT *, md5('0/' || split || '/' || b || '/' || (i + 1)) AS h FROM draw) draw JOIN ix ON ix.split = draw.split AND ix.i = draw.i + 1))))),
        drawn AS (SELECT ix.split, b, y, p, cost, k, total FROM draw JOIN ix ON ix.split = draw.split AND ix.i = draw.i),
        swe AS (SELECT split, b, sum(k * cost) / any_value(total) AS swe FROM drawn GROUP BY ALL),
        sides AS (SELECT split, b, route, sum(tp) AS tp, sum(k) AS k FROM (SELECT split, b, y AS route, CASE WHEN y = p THEN k ELSE 0 END AS tp, k FROM drawn UNION ALL SELECT split, b, p, 0, k FROM drawn) GROUP BY ALL),
        f AS (SELECT split, b, avg(2 * tp / k::DOUBLE) FILTER (k > 0) AS f1 FROM sides GROUP BY ALL)
        SELECT split, round(quantile_cont(swe, 0.025), 6) AS swe_low, round(quantile_cont(swe, 0.975), 6) AS swe_high, round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high
        FROM swe JOIN f USING (split, b) GROUP BY split""",
    "joined_predictions": "SELECT doc_id AS id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "prediction_problems": """WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), q AS (SELECT l_orderkey AS id FROM lineitem),
        x AS (SELECT 'repeated' AS problem, id FROM q GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown', id FROM q WHERE id NOT IN (SELECT id FROM r))
        SELECT problem, count(*) AS n, count(DISTINCT id) AS ids FROM x GROUP BY problem""",
    "tag_report": DECIDED + ", e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS tag, {n} AS y, CASE WHEN k < {20 + 10 * i} THEN ({_LIST(vs)})[k % {len(vs)} + 1] ELSE {n} END AS p, {n} IN ({', '.join(repr(x) for x in DANGEROUS[n]) or repr('-')}) AS danger FROM r" for i, (n, vs) in enumerate(_NAMES.items())) + ") SELECT tag, count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy, count(*) FILTER (y <> p) AS errors, count(*) FILTER (danger) AS n_dangerous, count(*) FILTER (danger AND y <> p) AS dangerous_misses FROM e GROUP BY tag",
    "decode_tags": f"""{LOGITS}, a AS (SELECT vec_id, {_SOFT('x[1:4]')} AS ea, {_SOFT('x[2:4]')} AS eb FROM l),
        q AS (SELECT vec_id, list_transform(ea, lambda v: v / list_sum(ea)) AS a, list_transform(eb, lambda v: v / list_sum(eb)) AS b FROM a)
        SELECT vec_id, CASE WHEN a[2] >= 0.3 THEN 'safety_critical' WHEN a[4] >= 0.3 THEN 'restricted' ELSE ({_LIST(TAGS['actuation'])})[list_position(a, list_max(a))] END AS actuation,
            CASE WHEN b[3] >= 0.3 THEN 'high' WHEN b[2] + b[3] >= 0.5 THEN 'medium' ELSE ({_LIST(TAGS['distraction'])})[list_position(b, list_max(b))] END AS distraction FROM q""",
    "prediction_records": f"""WITH {REQUESTS}, x AS (SELECT event_id, """ + ", ".join(f"list_transform(embedding[{a}:{a + k - 1}], lambda v: round(v::DOUBLE * 10, 6)) AS {n}" for n, (a, k) in PLACES.items()) + f""", r.speed, r.connectivity, r.workload, r.privacy, r.passenger, r.tier FROM embeddings JOIN r ON event_id = vec_id),
        s AS (SELECT * EXCLUDE ({', '.join(PLACES)}), """ + ", ".join(f"{_SOFT(n)} AS {n}" for n in PLACES) + f""", list_max({_SOFT('route', TEMPERATURE)}) / list_sum({_SOFT('route', TEMPERATURE)}) AS sure FROM x),
        q AS (SELECT * EXCLUDE ({', '.join(PLACES)}), """ + ", ".join(f"list_transform({n}, lambda v: v / list_sum({n})) AS {n}" for n in ("route", "intent")) + ", " + ", ".join(f"list_transform({n}, lambda v: round(v / list_sum({n}), 6)) AS {n}" for n in TAGS) + f""" FROM s),
        t AS (SELECT event_id, speed, connectivity, workload, privacy, passenger, tier, event_id % 3 = 0 AS sensitive, route AS rp, sure, actuation AS ap, list_sort(list_transform(range(1, 11), lambda i: {{'m': -intent[i], 'i': i - 1}}))[1:3] AS best,
            ({_LIST(ROUTES)})[list_position(route, list_max(route))] AS route_e2e, ({_LIST(TAGS['capability'])})[list_position(capability, list_max(capability))] AS capability, ({_LIST(TAGS['consequence'])})[list_position(consequence, list_max(consequence))] AS consequence,
            CASE WHEN actuation[2] >= 0.3 THEN 'safety_critical' WHEN actuation[4] >= 0.3 THEN 'restricted' ELSE ({_LIST(TAGS['actuation'])})[list_position(actuation, list_max(actuation))] END AS actuation,
            CASE WHEN distraction[3] >= 0.3 THEN 'high' WHEN distraction[2] + distraction[3] >= 0.5 THEN 'medium' ELSE ({_LIST(TAGS['distraction'])})[list_position(distraction, list_max(distraction))] END AS distraction FROM q), {decided_sql('t')},
        c AS (SELECT *, CASE WHEN actuation = 'safety_critical' THEN route WHEN 'REFUSE' IN (route, route_e2e) THEN 'REFUSE' WHEN 'DEFER' IN (route, route_e2e) THEN 'DEFER' WHEN 'CLOUD' IN (route, route_e2e) AND 'CLOUD_MASKED' IN (route, route_e2e) THEN 'CLOUD_MASKED' ELSE route END AS combined FROM d)
        SELECT event_id AS id, combined AS route, 'i' || best[1].i AS intent, round(sure, 6) AS confidence, route_e2e, route AS route_tags, combined AS route_combined, round(rp[2], 6) AS p_cloud, round(-best[3].m, 6) AS p_third,
            array_to_string(list_transform(best, lambda b: 'i' || b.i), ',') AS top3, CASE WHEN sensitive THEN '5:15:contact:ravi kumar' ELSE '' END AS spans, capability, distraction, actuation, consequence, ap[4] AS p_restricted FROM c""",
    "combined_routes": f"{PRED} SELECT event_id, CASE WHEN safety THEN y WHEN 'REFUSE' IN (y, p) THEN 'REFUSE' WHEN 'DEFER' IN (y, p) THEN 'DEFER' WHEN 'CLOUD' IN (y, p) AND 'CLOUD_MASKED' IN (y, p) THEN 'CLOUD_MASKED' ELSE y END AS route FROM p",
    "calibration": f"""{LOGITS}, a AS (SELECT *, {_SOFT('x')} AS e FROM l), q AS (SELECT y, list_max(e) / list_sum(e) AS conf, list_position(e, list_max(e)) - 1 = y AS ok FROM a)
        SELECT greatest(ceil(round(conf * 15, 9)), 1)::INT AS bin, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg(conf), 6) AS confidence FROM q GROUP BY 1""",
    "calibration_error": f"""{LOGITS}, t AS (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS t), a AS (SELECT t, y, {_SOFT('x', 't')} AS e FROM l, t),
        q AS (SELECT t, y, list_max(e) / list_sum(e) AS conf, list_position(e, list_max(e)) - 1 = y AS ok, -ln(greatest(e[y + 1] / list_sum(e), 1e-12)) AS nll FROM a),
        b AS (SELECT t, greatest(ceil(round(conf * 15, 9)), 1) AS bin, count(*) AS n, avg(ok::INT) AS acc, avg(conf) AS conf, sum(nll) AS nll FROM q GROUP BY ALL)
        SELECT t, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(sum(nll) / sum(n), 6) AS nll FROM b GROUP BY t""",
    "temperature_fit": f"""{LOGITS}, t AS (SELECT exp(ln(0.05::DOUBLE) + (ln(20::DOUBLE) - ln(0.05::DOUBLE)) * i / 199) AS t FROM range(200) r(i)), a AS (SELECT t, y, {_SOFT('x', 't')} AS e FROM l, t),
        g AS (SELECT t, round(avg(-ln(greatest(e[y + 1] / list_sum(e), 1e-12))), 9) AS nll FROM a GROUP BY t)
        SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM g ORDER BY g.nll, g.t LIMIT 1""",
    "temperature_refined": LOGITS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", t AS (SELECT exp(ln(0.05::DOUBLE) + (ln(20::DOUBLE) - ln(0.05::DOUBLE)) * i / 199) AS t FROM range(200) r(i)), a AS (SELECT t, y, {_SOFT('x', 't')} AS e FROM l, t),
        g AS (SELECT t, round(avg(-ln(greatest(e[y + 1] / list_sum(e), 1e-12))), 9) AS nll FROM a GROUP BY t), best AS (SELECT t, nll FROM g ORDER BY nll, t LIMIT 1),
        step AS (
            SELECT 0 AS i, 1 / t AS beta FROM best
            UNION ALL
            SELECT i + 1, least(greatest(any_value(beta) - avg(mean - x[y + 1]) / avg(square - mean * mean), any_value(beta) / 2, 1 / 20.0::DOUBLE), 2 * any_value(beta), 1 / 0.05::DOUBLE) FROM (
                SELECT i, beta, x, y, list_inner_product(w, x) / list_sum(w) AS mean, list_inner_product(w, list_transform(x, lambda v: v * v)) / list_sum(w) AS square
                FROM (SELECT i, beta, x, y, list_transform(x, lambda v: exp((v - list_max(x)) * beta)) AS w FROM step, l WHERE i < 30)) GROUP BY i
        ), refined AS (SELECT 1 / beta AS t FROM step WHERE i = 30),
        r AS (SELECT refined.t, avg(-ln(greatest(e[y + 1] / list_sum(e), 1e-12))) AS nll FROM (SELECT t, y, {_SOFT('x', 't')} AS e FROM refined, l) refined GROUP BY refined.t)
        SELECT (SELECT count(*) FROM embeddings) AS n, round(CASE WHEN r.nll < best.nll THEN r.t ELSE best.t END, 6) AS t, round(least(r.nll, best.nll), 6) AS nll, round(best.t, 6) AS grid_t FROM r, best""",
    "top3": f"{LOGITS} SELECT vec_id, array_to_string(list_transform((list_sort(list_transform(range(1, 6), lambda i: {{'m': -x[i], 'i': i - 1}})))[1:3], lambda s: s.i::VARCHAR), ',') AS top FROM l",
    "threshold_scan": f"""{SCORED}, t AS (SELECT unnest([{_THRESHOLDS}]) AS threshold)
        SELECT threshold, round(avg((conf >= threshold)::INT), 6) AS coverage, count(*) FILTER (conf >= threshold) AS n_covered, round(avg((y = p)::INT) FILTER (conf >= threshold), 6) AS accuracy,
            count(*) FILTER (conf >= threshold AND missed) AS critical_misses, count(*) FILTER (conf >= threshold AND eligible) AS n_critical,
            count(*) FILTER (conf < threshold AND y <> p) AS errors_avoided, count(*) FILTER (conf < threshold AND missed) AS critical_avoided FROM s, t GROUP BY threshold""",
    "class_weights": f"WITH {COST}, w AS (SELECT regexp_replace(true_row, '^LOCAL_.*$', 'LOCAL') AS route, true_row, p, cost FROM cost), m AS (SELECT route, avg(c) AS w FROM (SELECT route, true_row, avg(cost) AS c FROM w WHERE p <> route GROUP BY ALL) GROUP BY route) SELECT route, round(w / avg(w) OVER (), 6) AS weight FROM m",
    "tag_weights": DECIDED + ", v(tag, value, danger) AS (VALUES " + ", ".join(f"('{n}', '{v}', {2.0 if n == 'actuation' and v in DANGEROUS[n] else 1.5 if v in DANGEROUS[n] else 1.0}::DOUBLE)" for n, vs in _NAMES.items() for v in vs) + "), e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS tag, {n} AS value FROM r" for n in _NAMES) + "), c AS (SELECT tag, value, count(*) AS n FROM e GROUP BY ALL), j AS (SELECT tag, value, danger, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY tag) AS total FROM v LEFT JOIN c USING (tag, value)), w AS (SELECT tag, value, danger / sqrt(greatest(n, 1) / greatest(total, 1)::DOUBLE) AS w FROM j) SELECT tag, value, round(w / avg(w) OVER (PARTITION BY tag), 6) AS weight FROM w",
    "schedule": "SELECT i AS step, round(CASE WHEN i < 10 THEN i / 10.0::DOUBLE ELSE greatest(0, (100 - i) / 90.0::DOUBLE) END, 6) AS rate FROM range(101) r(i)",
}
