"""Queries over validators, full scores, fills and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import encode
from routeloom.functions import text as X
from routeloom.operators import calibrate, fills, policy, scoring, similarity, spans, validate
from routeloom.operators.decide import ARRAY
from routeloom.plans.evaluation import COST, PRED
from routeloom.plans.routing import REQUESTS, decided
from routeloom.plans.texts import _content, _norm, _set
from routeloom.sources.tables import predictions, requests, spread, table
from routeloom.vocab import DANGEROUS, TAGS

TEXTS = [
    "turn the cabin heat up a bit", "turn the cabin heat up a bit please", "Turn the heat up", "call {contact} at home now", "call {contact} from home now", "can you call {contact} now", "call ravi at 98765 43210",
    "is there any fuel left?", "what is  on at {time}", "radio", "tune in to {station} for me if you find that one on the air at all now", "play it at volume 7", "note: buy milk, bread", "", "open the {window ?", "heat up",
]
SEED_TEXTS = ["turn the cabin heat up", "call {contact} at home", "is there any fuel left"]
STYLES = ["command", "fragment", "question"]
VARIANTS = ["plain", "plain", "hinglish", "disfluent", "asr", "odd"]
TAG_LIST = ["capability", "distraction", "actuation"]
POOLS = {"contact": ["Ravi Kumar", "Asha", "Meena"], "relation": ["mom", "dad"], "address": ["12 Hill Road"], "place": ["the office", "home", "school"]}
TEMPLATES = ["call {contact} and then {contact}", "text {phone} the code {otp}", "go to {place}", "stop here", "take {contact} to {address} with card {card}"]


def written_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lines, seeds) made of events: each text once a seed and variant, at its first event."""
    e = table(spark, d, "events")
    intent = F.concat(F.lit("i"), (F.col("user_id") % 40).cast("string"))
    pick = lambda xs, i: F.element_at(ARRAY(xs), (i % len(xs) + 1).cast("int"))
    rows = e.select(intent.alias("intent"), (F.col("event_id") % 4).cast("int").alias("seed_index"), pick(TEXTS, F.floor(F.col("event_id") / 3) + F.col("user_id")).alias("text"), pick(VARIANTS, F.floor(F.col("event_id") / 5)).alias("variant"), F.col("event_id").cast("int").alias("line"))
    lines = rows.groupBy("intent", "seed_index", "text", "variant").agg(F.min("line").alias("line")).withColumn("k", F.col("line"))
    seeds = e.select(intent.alias("intent"), (F.col("user_id") % 40).alias("u")).distinct().where("u % 9 <> 0").withColumn("seed_index", F.explode(F.array(*map(F.lit, range(3)))))
    return lines, seeds.select("intent", "seed_index", pick(SEED_TEXTS, F.col("u") + F.col("seed_index")).alias("text"), pick(STYLES, F.col("u") + 2 * F.col("seed_index")).alias("style"))


def line_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of written lines, the quota included."""
    return validate.line_errors(*written_lines(spark, d), strict=True)


def line_warnings(spark: SparkSession, d: str) -> DataFrame:
    """V2, J11, J12, T11, A26."""
    return validate.line_warnings(*written_lines(spark, d))


def line_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issues by level and code, most first."""
    lines, seeds = written_lines(spark, d)
    return validate.line_errors(lines, seeds).groupBy("level", "code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def near_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike lines of one seed."""
    lines, _ = written_lines(spark, d)
    g = F.concat_ws("/", "intent", F.col("seed_index").cast("string"), "variant")
    return similarity.near_in_group(lines.select(g.alias("g"), "line", X.normalize(F.col("text")).alias("norm"), X.word_set(F.col("text")).alias("toks")), "g", "line")


def seed_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each seed and variant against the quota."""
    return validate.quota_shortfall(*written_lines(spark, d))


def intent_violations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as intents, tags by their keys."""
    k = F.col("s_suppkey")
    pick = lambda xs, i: F.element_at(ARRAY(xs), (i % len(xs) + 1).cast("int"))
    s = table(spark, d, "supplier").select(k.alias("intent"), pick(["vehicle_control", "media", "planning"], k).alias("grp"), pick(TAGS["capability"], F.floor(k / 3)).alias("capability"), pick(TAGS["actuation"], F.floor(k / 2)).alias("actuation"), pick(TAGS["consequence"], F.floor(k / 5)).alias("consequence"))
    return validate.intent_violations(s)


BROKEN = policy.Policy(
    demand_table=policy.DEMAND_OF | {"parked|low": "low", "high|high": "low"}, distraction_gate={k: v for k, v in policy.DISTRACTION_ALLOWED.items() if k != "low|low"},
    actuation_gate=policy.ACTUATION_ALLOWED | {"safety_critical|high": False}, passenger_relax_steps=-1, strict_privacy_route="CLOUD",
)


def broken_policy(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a broken policy."""
    return policy.violations(spark, BROKEN)


def broken_costs(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a broken cost matrix."""
    bad = {t: {p: c for p, c in r.items() if (t, p) != ("DEFER", "LOCAL")} for t, r in policy.COSTS.items()}
    bad["CLOUD"] |= {"CLOUD": 1, "LOCAL": -2, "OTHER": 0}
    return policy.cost_violations(spark, bad)


def tag_scores(spark: SparkSession, d: str) -> DataFrame:
    """Predicted tags against true ones, and the routes that wrong tags change."""
    r = requests(spark, d)
    wrong = lambda t, i: F.when(F.col("k") < 20 + 10 * i, F.element_at(ARRAY(TAGS[t]), (F.col("k") % len(TAGS[t]) + 1).cast("int"))).otherwise(F.col(t))
    true = predictions(spark, d).select("event_id", "y", "split")
    df = r.select("event_id", "speed", "connectivity", "workload", "privacy", "passenger", "tier", "sensitive", *[F.col(t).alias(f"true_{t}") for t in TAG_LIST], *[wrong(t, i).alias(f"pred_{t}") for i, t in enumerate(TAG_LIST)])
    return scoring.tag_scores(df.join(true, "event_id"), TAG_LIST)


def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    """Covered metrics and what asking again holds back."""
    return scoring.threshold_table(predictions(spark, d))


def personal_spans(spark: SparkSession, d: str) -> DataFrame:
    """T15, W9, W10."""
    s = spread(table(spark, d, "documents").select("doc_id", "text"))
    return X.rows_of(s, "doc_id", s=spans.detect_personal(F.col("text"))).select("doc_id", "s.start", "s.end", "s.label")


def filled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Templates of customers filled."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    seeds = c.select(F.concat_ws("/", F.lit("c"), F.col("c_custkey").cast("string")).alias("seed_id"), F.col("c_mktsegment").alias("intent"), F.element_at(ARRAY(TEMPLATES), (F.col("c_custkey") % len(TEMPLATES) + 1).cast("int")).alias("text"))
    out = fills.fills(seeds, POOLS)
    return out.select("seed_id", "fill", "utterance", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",").alias("spans"))


def label_indices(spark: SparkSession, d: str) -> DataFrame:
    """P25: labels by their place, ignored where synthetic or unknown."""
    o = table(spark, d, "orders")
    at = encode.label_index(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"], F.col("o_orderkey") % 7 == 0)
    return o.select("o_orderkey", at.alias("label"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Micro scores of token tags, untagged tokens aside."""
    n = lambda w: F.length(w) % 4
    words = F.split("text", " ")
    true = F.transform(words, lambda w: F.when(n(w) == 0, "B-otp").when(n(w) == 1, "I-otp").when(n(w) == 2, "O"))
    pred = F.transform(words, lambda w, i: F.when((n(w) == 0) | (i % 3 == 0), "B-otp").otherwise("O"))
    c = table(spark, d, "benchmark").select(encode.tag_counts(true, pred).alias("c"))
    return c.agg(F.sum("c.hits").alias("hits"), F.sum("c.n_true").alias("n_true"), F.sum("c.n_pred").alias("n_pred")).withColumn("f1", F.round(2 * F.col("hits") / (F.col("n_true") + F.col("n_pred")), 6))


_ALL = (line_errors, line_warnings, line_issue_counts, near_lines, seed_quotas, intent_violations, broken_policy, broken_costs, tag_scores, threshold_table, personal_spans, filled_rows, label_indices, token_f1)
QUERIES = {f.__name__: f for f in _ALL}

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PICK = lambda xs, i: f"({_LIST(xs)})[({i}) % {len(xs)} + 1]"
_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_SLOTS = lambda t: f"list_sort(list_distinct(regexp_extract_all({t}, '\\{{([^{{}}]*)\\}}', 1)))"
_LINES = f"""lines AS (SELECT 'i' || user_id % 40 AS intent, (event_id % 4)::INT AS seed_index, {_PICK(TEXTS, 'event_id // 3 + user_id')} AS text, {_PICK(VARIANTS, 'event_id // 5')} AS variant, min(event_id)::INT AS line FROM events GROUP BY ALL),
    seeds AS (SELECT 'i' || u AS intent, i::INT AS seed_index, {_PICK(SEED_TEXTS, 'u + i')} AS text, {_PICK(STYLES, 'u + 2 * i')} AS style FROM (SELECT DISTINCT user_id % 40 AS u FROM events), range(3) r(i) WHERE u % 9 <> 0),
    own AS (SELECT l.*, s.text AS seed, s.style, {_norm('l.text')} AS norm, {_set('l.text')} AS toks, regexp_replace(l.text, '\\{{[^{{}}]*\\}}', ' ', 'g') AS bare FROM lines l JOIN seeds s USING (intent, seed_index))"""
_CODES = f"""list_filter([CASE WHEN regexp_matches(bare, '[{{}}]') THEN 'unbalanced_brace' END, CASE WHEN {_WORDS} > 24 THEN 'too_many_words' END, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'non_ascii' END,
    CASE WHEN text <> lower(text) THEN 'uppercase' END, CASE WHEN regexp_matches(text, '^\\s|\\s$') OR contains(text, '  ') THEN 'bad_space' END,
    CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') AND regexp_matches(lower(regexp_replace(bare, '\\?$', '')), '[^a-z0-9'' ]') THEN 'punctuation' END, CASE WHEN text LIKE '% ?' THEN 'space_before_mark' END,
    CASE WHEN regexp_matches(bare, '[0-9]{{4}}') THEN 'long_number' END, CASE WHEN len(list_intersect(string_split({_norm('bare')}, ' '), {_LIST(X.FIRST_NAMES)})) > 0 THEN 'literal_name' END,
    CASE WHEN {_SLOTS('text')} <> {_SLOTS('seed')} THEN 'slots_differ' END], lambda x: x IS NOT NULL)"""
_COUNTS = "n AS (SELECT intent, seed_index, " + ", ".join(f"count(*) FILTER (variant = '{v}') AS {v}" for v in validate.QUOTA) + " FROM lines GROUP BY ALL)"
_QUOTAS = f"""{_COUNTS}, q AS (SELECT s.intent, s.seed_index, {', '.join(f'coalesce({v}, 0) AS {v}' for v in validate.QUOTA)} FROM seeds s LEFT JOIN n USING (intent, seed_index)),
    quotas AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {v} <> {q} THEN '{v} ' || {v} || '/{q}' END" for v, q in validate.QUOTA.items())}], lambda x: x IS NOT NULL), ', ') AS short, {' + '.join(f'greatest({q} - {v}, 0)' for v, q in validate.QUOTA.items())} AS to_go FROM q)"""
_ERRORS = f"""WITH {_LINES}, {_QUOTAS},
    f AS (SELECT intent, norm, min({{'s': seed_index, 'k': line}}) AS first, count(*) AS n FROM own GROUP BY ALL),
    o AS (SELECT {_norm('text')} AS norm, min({{'i': intent, 's': seed_index}}).i AS owner FROM seeds GROUP BY 1),
    u AS (SELECT {_norm('text')} AS norm, list_sort(list(DISTINCT intent)) AS users FROM lines GROUP BY 1),
    e AS (SELECT intent AS item, 0 AS line, 'unknown_intent' AS code, '' AS detail FROM lines ANTI JOIN seeds USING (intent) GROUP BY ALL
        UNION ALL SELECT intent || '/' || seed_index, 0, 'unknown_index', '' FROM lines SEMI JOIN seeds USING (intent) ANTI JOIN seeds s2 USING (intent, seed_index) GROUP BY ALL
        UNION ALL SELECT intent || '/' || seed_index, line, unnest(CASE WHEN trim(text) = '' THEN ['empty'] ELSE {_CODES} END), '' FROM own
        UNION ALL SELECT intent || '/' || seed_index, line, CASE variant WHEN 'asr' THEN 'variant_asr' ELSE 'unknown_variant' END, CASE variant WHEN 'asr' THEN '' ELSE variant END FROM own WHERE variant NOT IN ({', '.join(repr(v) for v in validate.QUOTA)})
        UNION ALL SELECT intent || '/' || seed_index, line, 'duplicate', 'of line ' || first.k FROM own JOIN f USING (intent, norm) WHERE {{'s': seed_index, 'k': line}} > first
        UNION ALL SELECT intent || '/' || seed_index, line, 'same_as_seed', 'of ' || owner FROM own JOIN o USING (norm)
        UNION ALL SELECT intent || '/' || seed_index, line, 'same_as_other_intent', 'of ' || array_to_string(list_filter(users, lambda x: x <> intent), ', ') FROM own JOIN u USING (norm) WHERE len(users) > 1)"""
_BARE_TAGS = ", ".join(f"CASE WHEN k < {20 + 10 * i} THEN {_PICK(TAGS[t], 'k')} ELSE {t} END AS pred_{t}, {t} AS true_{t}" for i, t in enumerate(TAG_LIST))
_CTX = "event_id, speed, connectivity, workload, privacy, passenger, tier, sensitive"
_TRUE_ROW = lambda: "CASE WHEN y <> 'LOCAL' THEN y WHEN true_actuation = 'safety_critical' THEN 'LOCAL_SAFETY_CRITICAL' ELSE 'LOCAL_OTHER' END"
_DANGER = lambda c: "CASE tag " + " ".join(f"WHEN '{t}' THEN {c} IN ({', '.join(repr(x) for x in DANGEROUS[t]) or repr('-')})" for t in TAG_LIST) + " END"
def _number(n: str, key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 12))::BIGINT % {n})"


def _digits(n: int, key: str) -> str:
    return f"lpad((('0x' || substr(md5({key}), 1, 15))::BIGINT % {10**n})::VARCHAR, {n}, '0')"


_PHONE = f"substr('{fills.PHONE_FIRST}', ({_number('8', "key || '/first'")} + 1)::INT, 1) || {_digits(9, "key || '/rest'")}"
_FILLED = f"""WITH seed AS (SELECT 'c/' || c_custkey AS seed_id, {_PICK(TEMPLATES, 'c_custkey')} AS text FROM customer),
    plan AS (SELECT *, regexp_extract_all(text, '\\{{([^{{}}]*)\\}}', 1) AS names, string_split_regex(text, '\\{{[^{{}}]*\\}}') AS gaps, list_distinct(list_filter(names, lambda x: list_contains({_LIST(X.SENSITIVE_SLOTS)}, x))) AS sens,
        unnest(CASE WHEN sens = ['contact'] THEN [{{'s': true, 'want': 2}}, {{'s': false, 'want': 1}}] WHEN len(names) > 0 THEN [{{'s': true, 'want': 2}}] ELSE [{{'s': true, 'want': 1}}] END) AS p FROM seed),
    tries AS (SELECT seed_id, names, gaps, p.s AS sensitive, p.want AS want, try FROM plan, range(1, 61) r(try) WHERE try <= p.want * 20),
    piece AS (SELECT seed_id, sensitive, want, try, i, gaps[i] AS gap, names[i] AS slot, '0/' || seed_id || '/' || sensitive || '/' || try || '/' || names[i] AS key FROM tries, range(1, 5) q(i) WHERE i <= len(gaps)),
    said AS (SELECT *, {_PHONE} AS phone, {_number('4', "key || '/form'")} AS form, CASE slot {' '.join(f"WHEN '{n}' THEN {_LIST(v)}" for n, v in POOLS.items() if n not in ('contact', 'relation'))} WHEN 'contact' THEN CASE WHEN sensitive THEN {_LIST(POOLS['contact'])} ELSE {_LIST(POOLS['relation'])} END END AS pool FROM piece),
    val AS (SELECT *, CASE slot WHEN 'phone' THEN CASE form WHEN 0 THEN '+91 ' || phone[1:5] || ' ' || phone[6:10] WHEN 1 THEN '+91 ' || phone WHEN 2 THEN phone ELSE phone[1:5] || ' ' || phone[6:10] END
        WHEN 'otp' THEN CASE {_number('2', "key || '/size'")} WHEN 0 THEN {_digits(4, 'key')} ELSE {_digits(6, 'key')} END WHEN 'card' THEN {_digits(4, 'key')} ELSE pool[{_number('len(pool)', "key || '/' || slot")} + 1] END AS value FROM said),
    put AS (SELECT *, sum(length(gap) + coalesce(length(value), 0)) OVER (PARTITION BY seed_id, sensitive, try ORDER BY i) AS stop FROM val),
    made AS (SELECT seed_id, sensitive, want, try, string_agg(gap || coalesce(value, ''), '' ORDER BY i) AS utterance,
        coalesce(string_agg((stop - length(value))::BIGINT || ':' || stop::BIGINT || ':' || slot, ',' ORDER BY i) FILTER (sensitive AND slot IN ({', '.join(repr(x) for x in X.SENSITIVE_SLOTS)})), '') AS spans FROM put GROUP BY ALL),
    uniq AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY seed_id, sensitive, utterance ORDER BY try) = 1),
    kept AS (SELECT *, row_number() OVER (PARTITION BY seed_id, sensitive ORDER BY try) AS r FROM uniq QUALIFY r <= want)"""
ORACLE = {
    "filled_rows": f"{_FILLED} SELECT seed_id, (row_number() OVER (PARTITION BY seed_id ORDER BY sensitive DESC, r) - 1)::INT AS fill, utterance, spans FROM kept",
    "line_errors": f"{_ERRORS} SELECT 'error' AS level, 'lines' AS source, item, line::BIGINT AS line, code, detail FROM e UNION ALL SELECT 'error', 'lines', intent || '/' || seed_index, 0, 'quota', short FROM quotas WHERE short <> ''",
    "line_issue_counts": f"{_ERRORS} SELECT 'error' AS level, code, count(*) AS n FROM e GROUP BY code",
    "line_warnings": f"""WITH {_LINES}, sc AS (SELECT intent, seed_index, {_content('text')} AS toks FROM seeds), oc AS (SELECT intent, seed_index, line, unnest({_content('text')}) AS tok FROM own),
        hit AS (SELECT o.intent, o.seed_index, o.line, c.intent AS of, c.seed_index AS i, count(*) AS shared, round(count(*) / any_value(len(toks))::DOUBLE, 9) AS s FROM oc o JOIN (SELECT *, unnest(toks) AS tok FROM sc) c USING (tok) GROUP BY ALL),
        far AS (SELECT intent, seed_index, line, coalesce(max(s) FILTER (of = intent), 0) AS own, max(s) FILTER (of <> intent AND shared >= {validate.LEAST_SHARED}) AS other FROM hit GROUP BY ALL),
        closer AS (SELECT f.*, min((of, i))[1] AS of FROM far f JOIN hit h ON h.intent = f.intent AND h.seed_index = f.seed_index AND h.line = f.line AND h.of <> f.intent AND shared >= {validate.LEAST_SHARED} AND h.s = f.other WHERE f.other > f.own GROUP BY ALL), j AS (SELECT *, len(list_intersect(toks, st))::DOUBLE / len(list_distinct(list_concat(toks, st))) AS s FROM (SELECT *, {_set('seed')} AS st FROM own) WHERE len(toks) + len(st) > 0),
        p AS (SELECT y.intent, y.seed_index, y.line, x.line AS first, round(len(list_intersect(x.toks, y.toks))::DOUBLE / len(list_distinct(list_concat(x.toks, y.toks))), 9) AS s FROM own x JOIN own y ON x.intent = y.intent AND x.seed_index = y.seed_index AND x.line < y.line AND x.norm <> y.norm),
        w AS (SELECT intent, seed_index, line, 'near_seed' AS code, format('{{:.2f}}', s) AS detail FROM j WHERE round(s, 9) > 0.6
            UNION ALL SELECT intent, seed_index, line, 'near_line', first || ' ' || format('{{:.2f}}', s) FROM p WHERE s > 0.6
            UNION ALL SELECT intent, seed_index, line, unnest(list_filter([CASE WHEN style <> 'question' AND text LIKE '%?' THEN 'question_mark' END,
                CASE WHEN style <> 'question' AND text NOT LIKE '%?' AND regexp_matches(text, '^(?:(?:uh|um|er|so|hey|okay|ok)\\s+)*(?:(?:can|could|would|will|shall)\\s+(?:you|we|i)|is\\s+there|are\\s+there|do\\s+you)\\b') THEN 'reads_as_question' END,
                CASE WHEN style = 'fragment' AND {_WORDS} > CASE variant WHEN 'disfluent' THEN 9 ELSE 6 END THEN 'long_fragment' END, CASE WHEN regexp_matches(bare, '[0-9]') AND NOT regexp_matches(text, '[0-9]{{4}}') THEN 'literal_digit' END], lambda x: x IS NOT NULL)), '' FROM own
            UNION ALL SELECT intent, seed_index, line, 'drift', of || ' ' || format('{{:.2f}}', other) || ' ' || format('{{:.2f}}', own) FROM closer
            UNION ALL SELECT intent, seed_index, min(line), 'few_first_words', count(DISTINCT nullif(string_split(text, ' ')[1], ''))::VARCHAR FROM own WHERE variant = 'plain' GROUP BY intent, seed_index HAVING count(*) >= 4 AND count(DISTINCT nullif(string_split(text, ' ')[1], '')) < 4)
        SELECT 'warning' AS level, 'lines' AS source, intent || '/' || seed_index AS item, line::BIGINT AS line, code, detail FROM w""",
    "near_lines": f"""WITH {_LINES}, g AS (SELECT intent || '/' || seed_index || '/' || variant AS g, line, {_norm('text')} AS norm, {_set('text')} AS toks FROM lines),
        p AS (SELECT x.g, x.line AS first, y.line AS second, round(len(list_intersect(x.toks, y.toks))::DOUBLE / len(list_distinct(list_concat(x.toks, y.toks))), 9) AS score FROM g x JOIN g y ON x.g = y.g AND x.line < y.line AND x.norm <> y.norm) SELECT * FROM p WHERE score > 0.6""",
    "seed_quotas": f"WITH {_LINES}, {_QUOTAS} SELECT * FROM quotas",
    "intent_violations": f"""WITH i AS (SELECT s_suppkey AS intent, {_PICK(['vehicle_control', 'media', 'planning'], 's_suppkey')} AS grp, {_PICK(TAGS['capability'], 's_suppkey // 3')} AS capability, {_PICK(TAGS['actuation'], 's_suppkey // 2')} AS actuation, {_PICK(TAGS['consequence'], 's_suppkey // 5')} AS consequence FROM supplier)
        SELECT intent, 'a vehicle command has a side effect' AS rule FROM i WHERE actuation <> 'none' AND consequence = 'none' UNION ALL SELECT intent, 'only vehicle_control has an actuation' FROM i WHERE actuation <> 'none' AND grp <> 'vehicle_control'
        UNION ALL SELECT intent, 'vehicle_control needs an actuation' FROM i WHERE actuation = 'none' AND grp = 'vehicle_control' UNION ALL SELECT intent, 'vehicle commands are local_ok' FROM i WHERE actuation <> 'none' AND capability <> 'local_ok'""",
    "broken_policy": """SELECT * FROM (VALUES ('demand_table: falls along b', 'parked|medium'), ('demand_table: falls along b', 'high|high'), ('demand_table: falls along a', 'high|high'), ('demand_table: parked car has demand', 'parked|low'),
        ('distraction_gate: missing', 'low|low'), ('actuation_gate: safety blocked', 'safety_critical|high'), ('passenger_relax_steps: negative', ''), ('strict_privacy_route: a cloud route', '')) v(rule, cell)""",
    "broken_costs": "SELECT * FROM (VALUES ('missing', 'DEFER|LOCAL'), ('unexpected', 'CLOUD|OTHER'), ('no number of 0 or more', 'CLOUD|LOCAL'), ('a right route has a cost', 'CLOUD|CLOUD')) v(rule, cell)",
    "tag_scores": f"""WITH {REQUESTS}, {decided('r')}, b AS (SELECT {_CTX}, {_BARE_TAGS} FROM r), bp AS (SELECT *, pred_capability AS capability, pred_distraction AS distraction, pred_actuation AS actuation FROM b), {decided('bp', 'm')},
        x AS (SELECT m.* EXCLUDE (capability, distraction, actuation, route, reason, demand), m.route AS route_pred, d.route AS y, CASE m.event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM m JOIN d USING (event_id)),
        e AS ({' UNION ALL '.join(f"SELECT x.*, '{t}' AS tag, true_{t} AS t, pred_{t} AS q, " + ", ".join(f"{'true' if t == z else 'pred'}_{z} AS {z}" for z in TAG_LIST) + " FROM x" for t in TAG_LIST)}), {decided('e', 'h')}, {COST},
        s AS (SELECT tag, unnest([split, NULL]) AS split, t, q, {_DANGER('t')} AS risk, NOT ({_DANGER('q')}) AS harmless, t <> q AND route <> route_pred AS changes, c1.cost AS c1, c2.cost AS c2
            FROM h JOIN cost c1 ON c1.true_row = {_TRUE_ROW()} AND c1.p = route_pred JOIN cost c2 ON c2.true_row = {_TRUE_ROW()} AND c2.p = route),
        k AS (SELECT tag, split, v, sum(tp) AS tp, sum(a) AS a, sum(b) AS b FROM (SELECT tag, split, t AS v, (t = q)::INT AS tp, 1 AS a, 0 AS b FROM s UNION ALL SELECT tag, split, q, 0, 0, 1 FROM s) GROUP BY ALL),
        f AS (SELECT tag, split, round(avg(2 * tp / (a + b)::DOUBLE), 6) AS macro_f1 FROM k GROUP BY ALL),
        g AS (SELECT tag, split, count(*) AS n, count(*) FILTER (t <> q) AS errors, count(*) FILTER (risk) AS n_dangerous, count(*) FILTER (risk AND harmless) AS dangerous_misses, count(*) FILTER (changes) AS route_changing_errors, coalesce(sum(c1) FILTER (changes), 0) AS cost, coalesce(sum(c2) FILTER (changes), 0) AS cost_if_corrected FROM s GROUP BY ALL)
        SELECT g.*, macro_f1, round((n - errors) / n::DOUBLE, 6) AS accuracy, round(dangerous_misses / nullif(n_dangerous, 0)::DOUBLE, 6) AS dangerous_miss_rate FROM g JOIN f ON f.tag = g.tag AND f.split IS NOT DISTINCT FROM g.split""",
    "threshold_table": f"""{PRED}, {COST}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in calibrate.THRESHOLDS)}]) AS threshold),
        s AS (SELECT p.*, cost.cost, (y = 'LOCAL' AND safety) OR y = 'REFUSE' AS eligible, (y = 'LOCAL' AND safety AND p.p IN ('CLOUD','CLOUD_MASKED')) OR (y = 'REFUSE' AND p.p IN ('CLOUD','CLOUD_MASKED','LOCAL')) AS missed
            FROM p JOIN cost ON cost.p = p.p AND cost.true_row = CASE WHEN y <> 'LOCAL' THEN y WHEN safety THEN 'LOCAL_SAFETY_CRITICAL' ELSE 'LOCAL_OTHER' END),
        u AS (SELECT threshold, y, p, cost, eligible, missed FROM s, t WHERE conf >= threshold),
        k AS (SELECT threshold, v, sum(tp) AS tp, sum(a) AS a, sum(b) AS b FROM (SELECT threshold, y AS v, (y = p)::INT AS tp, 1 AS a, 0 AS b FROM u UNION ALL SELECT threshold, p, 0, 0, 1 FROM u) GROUP BY ALL),
        f AS (SELECT threshold, avg(2 * tp / (a + b)::DOUBLE) AS f1, sum(tp)::DOUBLE AS c, sum(a * b)::DOUBLE AS ab, sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb FROM k GROUP BY threshold),
        b AS (SELECT threshold, count(*) AS n_covered, avg((y = p)::INT) AS accuracy, avg(cost) AS swe, count(*) FILTER (missed) AS critical_misses, count(*) FILTER (eligible) AS n_critical FROM u GROUP BY threshold),
        m AS (SELECT *, sqrt(n_covered::DOUBLE * n_covered - bb) * sqrt(n_covered::DOUBLE * n_covered - aa) AS den FROM b JOIN f USING (threshold)),
        h AS (SELECT threshold, count(*) AS n, {', '.join(f"count(*) FILTER (conf < threshold{c}) AS {n}" for n, c in {'n_clarify': '', 'errors_avoided': ' AND y <> p', 'critical_avoided': ' AND missed', 'safety_delayed': " AND safety AND y = 'LOCAL'", **{f'clarify_{r.lower()}': f" AND y = '{r}'" for r in ('LOCAL', 'CLOUD', 'CLOUD_MASKED', 'DEFER', 'REFUSE')}}.items())} FROM s, t GROUP BY threshold),
        z AS (SELECT threshold, round(accuracy, 6) AS accuracy, round(swe, 6) AS swe, round(f1, 6) AS macro_f1, round(CASE WHEN den > 0 THEN (c * n_covered - ab) / den ELSE 0 END, 6) AS mcc, critical_misses, n_critical, round(critical_misses / nullif(n_critical, 0)::DOUBLE, 6) AS critical_miss_rate, n_covered FROM m)
        SELECT h.* EXCLUDE (n), coalesce(n_covered, 0) AS n_covered, accuracy, swe, macro_f1, mcc, coalesce(critical_misses, 0) AS critical_misses, coalesce(n_critical, 0) AS n_critical, critical_miss_rate, round(coalesce(n_covered, 0) / n::DOUBLE, 6) AS coverage,
            (SELECT min(threshold) FROM z WHERE critical_miss_rate < 0.01) AS smallest FROM h LEFT JOIN z USING (threshold)""",
    "label_indices": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -100 ELSE coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) - 1, -100) END::INT AS label FROM orders",
    "token_f1": """WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark), g AS (SELECT w, unnest(range(len(w))) AS i FROM w), t AS (SELECT length(w[i + 1]) % 4 AS n, i FROM g),
        x AS (SELECT n, n = 0 OR i % 3 = 0 AS b FROM t WHERE n < 3), s AS (SELECT count(*) FILTER (n = 0 AND b) AS hits, count(*) FILTER (n < 2) AS n_true, count(*) FILTER (b) AS n_pred FROM x) SELECT *, round(2 * hits / (n_true + n_pred)::DOUBLE, 6) AS f1 FROM s""",
}
