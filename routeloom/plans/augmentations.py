"""Queries over checked goals and pairs, made of suppliers, against seeds and lines made of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import validate
from routeloom.operators.decide import ARRAY
from routeloom.plans.checks import _LINES, _LIST, _PICK, written_lines
from routeloom.plans.routing import MAPPED
from routeloom.plans.texts import _content, _norm, _set
from routeloom.sources import files
from routeloom.sources.scratch import saved
from routeloom.sources.tables import table
from routeloom.vocab import TAGS

TEXTS = [
    "turn the cabin heat up a bit now", "call {contact} at home", "is there any fuel left", "is there any fuel left in here", "open the {window}", "open the {window} on my side", "play some calm music for the drive", "play some calm music for the way",
    "Set the fan to 5", "read my notes out loud, slowly", "what is left of the fuel", "text {somebody} for me", "", "mute the radio and the phone", "turn the cabin heat up", "find a tea stall near {place}", "radio", "find a toll road",
]
GROUPS = ["vehicle_control", "media", "planning", "odd"]
STYLES, VARIANTS = [*validate.STYLES, "odd"], ["plain", "hinglish", "plain", "disfluent", "asr"]
DESCRIPTIONS = ["some goal", "switch the fog lamps", "", "draft a long email", "pairing a phone", "another goal"]
DIFFERS = [["actuation"], ["capability", "distraction"], ["odd"], ["distraction", "distraction"], ["capability", "distraction", "actuation", "consequence"], []]
OOD = [f"i{u}" for u in range(0, 40, 5)]
#: Tags of intent u and of supplier s: (tag, values, divisor).
CUT = [("capability", 3), ("distraction", 2), ("actuation", 5), ("consequence", 7)]


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(ARRAY(values), (F.floor(i) % len(values) + 1).cast("int"))


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """goals, pairs, refs and intents."""
    s = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey")
    # one in eleven goals has a value that no tag has
    tags = {t: F.when(s % 11 == i, "odd").otherwise(_pick(TAGS[t], s / k)) for i, (t, k) in enumerate(CUT)}
    said = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda j: F.when(j < s % 14, F.struct(_pick(TEXTS, s * 3 + j * 5).alias("text"), _pick(STYLES, s + j).alias("style"), _pick(VARIANTS, s / 2 + j).alias("variant"), (s * 100 + j).alias("line"))))
    name = F.when(s % 7 == 0, "Bad Name").when(s % 7 == 1, F.concat(F.lit("i"), (s % 40).cast("string"))).otherwise(F.concat(F.lit("goal_"), F.floor(s / 2).cast("string")))
    goals = suppliers.select(
        name.alias("name"), _pick(DESCRIPTIONS, s / 3).alias("description"), F.when(s % 13 == 0, " ").otherwise("why").alias("rationale"), _pick(GROUPS, s).alias("grp"), *[v.alias(t) for t, v in tags.items()], s.cast("int").alias("line"), F.array_compact(said).alias("utterances"),
    )
    side = lambda intent, i, line: F.struct(F.concat(F.lit("i"), intent.cast("string")).alias("intent"), _pick(TEXTS, i).alias("text"), _pick(STYLES, i).alias("style"), _pick(VARIANTS, i).alias("variant"), line.alias("line"))
    differs = F.element_at(F.array(*[ARRAY(x) if x else F.array().cast("array<string>") for x in DIFFERS]), (F.floor(s / 2) % len(DIFFERS) + 1).cast("int"))
    pairs = suppliers.select(
        F.when(s % 6 == 0, "Pair X").otherwise(F.concat(F.lit("pair_"), F.floor(s / 3).cast("string"))).alias("id"), differs.alias("differs_in"), side(s % 43, s, s * 10).alias("a"), side(s * 3 % 40, s + s % 3, s * 10 + 1).alias("b"), F.when(s % 9 == 0, "").otherwise("note").alias("note"), s.cast("int").alias("line"),
    )
    lines, seeds = written_lines(spark, d)
    u = F.substring("intent", 2, 9).cast("int")
    split = F.when(u % 5 == 0, "ood").when(u % 5 == 1, "val").when(u % 5 == 2, "test").otherwise("train")
    refs = seeds.select((u * 10 + F.col("seed_index")).cast("long").alias("ref"), "intent", split.alias("split"), F.lit("seed").alias("kind"), "text")
    refs = refs.unionByName(lines.select((F.lit(1_000_000) + F.col("line")).cast("long").alias("ref"), "intent", split.alias("split"), F.lit("line").alias("kind"), "text"))
    numbers = table(spark, d, "events").select((F.col("user_id") % 40).alias("u")).distinct()
    n = F.col("u")
    intents = numbers.select(F.concat(F.lit("i"), n.cast("string")).alias("intent"), _pick(GROUPS[:3], n).alias("grp"), *[_pick(TAGS[t], n / k).alias(t) for t, k in CUT])
    return goals, pairs, refs, intents


def nearest_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of goals and pairs with the nearest known, val/test and OOD text, and the tags that differ."""
    u = validate.reviewed(*inputs(spark, d))
    found = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("known", "valtest", "ood") for c in ("score", "shared", "near_intent", "kind")]
    return u.select("source", "item", "at", "side", "pos", *found, F.array_join("differ", ",").alias("differ"))


def augmentation_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong, or worth a look, with goals and pairs."""
    return validate.augmentation_issues(*inputs(spark, d), OOD)


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed texts and their issues, each made once."""
    made = inputs(spark, d)
    texts = validate.reviewed(*made)
    return texts, saved(validate.augmentation_issues(*made, OOD, texts=texts), "issues")


def item_risks(spark: SparkSession, d: str) -> DataFrame:
    """Goals and pairs by risk, with the intent most of their texts are nearest to."""
    return validate.item_risk(*_checked(spark, d))


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """SK9: every text with its item's risk and issues and its nearest known text."""
    texts, issues = _checked(spark, d)
    return files.review_rows(validate.item_risk(texts, issues), texts, issues)


_ALL = (nearest_texts, augmentation_issues, item_risks, review_rows)
QUERIES = {f.__name__: f for f in _ALL}

_TAG = lambda t, k, key: _PICK(TAGS[t], f"{key} // {k}")
_NAMED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_JAC = lambda a, b: f"round(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))), 9)"
_DIFFERS = "[" + ", ".join(f"[{_NAMED(x)}]::VARCHAR[]" for x in DIFFERS) + "]"
_SIDE = lambda n, intent, i, line: f"'{n}' AS side, 'i' || ({intent}) AS intent, {_PICK(TEXTS, i)} AS text, {_PICK(STYLES, i)} AS style, {_PICK(VARIANTS, i)} AS variant, {line} AS line"
_NEAR = lambda s, cond: f"{s} AS (SELECT uid, arg_max({{'score': j, 'shared': shared, 'near_intent': intent, 'kind': kind, 'near_text': text}}, (j, -ref)) AS m FROM met WHERE {cond} GROUP BY uid)"
_TEXTS = f"""{_LINES}, gl AS (SELECT CASE WHEN s % 7 = 0 THEN 'Bad Name' WHEN s % 7 = 1 THEN 'i' || s % 40 ELSE 'goal_' || s // 2 END AS name, {_PICK(DESCRIPTIONS, 's // 3')} AS description, CASE WHEN s % 13 = 0 THEN ' ' ELSE 'why' END AS rationale, {_PICK(GROUPS, 's')} AS grp,
        {', '.join(f"CASE WHEN s % 11 = {i} THEN 'odd' ELSE {_TAG(t, k, 's')} END AS {t}" for i, (t, k) in enumerate(CUT))}, s AS line, least(s % 14, 13) AS n FROM (SELECT s_suppkey AS s FROM supplier)),
    pr AS (SELECT s AS line, CASE WHEN s % 6 = 0 THEN 'Pair X' ELSE 'pair_' || s // 3 END AS id, ({_DIFFERS})[s // 2 % {len(DIFFERS)} + 1] AS differs_in, CASE WHEN s % 9 = 0 THEN '' ELSE 'note' END AS note, s FROM (SELECT s_suppkey AS s FROM supplier)),
    sd AS (SELECT id, pr.line AS owner, 0 AS pos, {_SIDE('a', 's % 43', 's', 's * 10')} FROM pr UNION ALL SELECT id, pr.line, 1, {_SIDE('b', 's * 3 % 40', '(s + s % 3)', 's * 10 + 1')} FROM pr),
    refs AS (SELECT substr(intent, 2)::INT * 10 + seed_index AS ref, intent, 'seed' AS kind, text FROM seeds UNION ALL SELECT 1000000 + line, intent, 'line', text FROM lines),
    known_refs AS (SELECT *, CASE substr(intent, 2)::INT % 5 WHEN 0 THEN 'ood' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split, unnest({_content('text')}) AS tok, len({_content('text')}) AS nb FROM refs),
    intents AS (SELECT 'i' || u AS intent, {_PICK(GROUPS[:3], 'u')} AS grp, {', '.join(f"{_TAG(t, k, 'u')} AS {t}" for t, k in CUT)} FROM (SELECT DISTINCT user_id % 40 AS u FROM events)),
    ut AS (SELECT *, row_number() OVER () AS uid, {_norm('text')} AS norm, {_content('text')} AS toks FROM (
        SELECT 'goals' AS source, name AS item, gl.line AS owner, '' AS side, j AS pos, {_PICK(TEXTS, 'gl.line * 3 + j * 5')} AS text, {_PICK(STYLES, 'gl.line + j')} AS style, {_PICK(VARIANTS, 'gl.line // 2 + j')} AS variant, gl.line * 100 + j AS line, NULL AS intent FROM gl, range(13) r(j) WHERE j < gl.n
        UNION ALL SELECT 'pairs', id, owner, side, pos, text, style, variant, line, intent FROM sd)),
    met AS (SELECT uid, ref, any_value(k.intent) AS intent, any_value(kind) AS kind, any_value(k.text) AS text, any_value(split) AS split, count(*) AS shared, round(count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE, 9) AS j FROM (SELECT uid, len(toks) AS na, unnest(toks) AS tok FROM ut) t JOIN known_refs k USING (tok) GROUP BY uid, ref),
    {_NEAR('nk', "split <> 'ood'")}, {_NEAR('nv', "split IN ('val', 'test')")}, {_NEAR('no', "split = 'ood'")},
    rv0 AS (SELECT ut.*, nk.m AS known, nv.m AS valtest, no.m AS ood FROM ut LEFT JOIN nk USING (uid) LEFT JOIN nv USING (uid) LEFT JOIN no USING (uid)),
    rv AS (SELECT rv0.*, CASE WHEN known IS NULL THEN []::VARCHAR[] WHEN source = 'goals' THEN list_filter([{', '.join(f"CASE WHEN gl.{t} <> i.{t} THEN '{t}' END" for t in TAGS)}], lambda x: x IS NOT NULL) WHEN known.near_intent <> rv0.intent THEN ['intent'] ELSE [] END AS differ
        FROM rv0 LEFT JOIN intents i ON i.intent = known.near_intent LEFT JOIN gl ON source = 'goals' AND gl.line = owner)"""
_BARE = "regexp_replace(text, '\\{[^{}]*\\}', ' ', 'g')"
_FORM = f"""CASE WHEN trim(text) = '' THEN ['empty'] ELSE list_filter([CASE WHEN regexp_matches(bare, '[{{}}]') THEN 'unbalanced_brace' END, CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 24 THEN 'too_many_words' END, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'non_ascii' END,
    CASE WHEN text <> lower(text) THEN 'uppercase' END, CASE WHEN regexp_matches(text, '^\\s|\\s$') OR contains(text, '  ') THEN 'bad_space' END, CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') AND regexp_matches(lower(regexp_replace(bare, '\\?$', '')), '[^a-z0-9'' ]') THEN 'punctuation' END, CASE WHEN text LIKE '% ?' THEN 'space_before_mark' END,
    CASE WHEN regexp_matches(bare, '[0-9]{{4}}') THEN 'long_number' END, CASE WHEN len(list_intersect(string_split({_norm('bare')}, ' '), {_LIST(X.FIRST_NAMES)})) > 0 THEN 'literal_name' END], lambda x: x IS NOT NULL) END || CASE WHEN len(list_filter(regexp_extract_all(text, '\\{{([^{{}}]*)\\}}', 1), lambda x: NOT list_contains({_LIST(X.SLOTS)}, x))) > 0 THEN ['unknown_slot'] ELSE [] END"""
_HITS = "list_filter([" + ", ".join("CASE WHEN " + " AND ".join(f"len(list_filter(ws, lambda w: starts_with(w, '{k}'))) > 0" for k in keys) + f" THEN '{name}: {' '.join(keys)}' END" for name, alts in validate.OOD_KEYWORDS.items() for keys in alts) + "], lambda x: x IS NOT NULL)"
_ENUMS = {"grp": validate.GROUPS, **TAGS}
_RULES = {
    "a vehicle command has a side effect": "acts AND consequence = 'none'", "only vehicle_control has an actuation": "acts AND NOT vehicle",
    "vehicle_control needs an actuation": "vehicle AND NOT acts", "vehicle commands are local_ok": "acts AND capability <> 'local_ok'",
}
_N2 = lambda x: f"format('{{:.2f}}', {x})"


def _rules(source: str, item: str, line: str, frm: str, rules: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {lv if lv.startswith('CASE') else repr(lv)} AS level, {source} AS source, {item} AS item, {line} AS line, '{code}' AS code, {detail} AS detail FROM {frm} WHERE {cond}" for lv, code, cond, detail in rules)


_ISSUES = f"""WITH {MAPPED.removeprefix('WITH ')}, {_TEXTS},
    ex AS (SELECT {_norm('text')} AS norm, arg_min(intent, ref) AS of FROM refs GROUP BY 1), fst AS (SELECT norm, min((source, owner, item, pos)) AS first, count(*) AS c FROM ut GROUP BY norm),
    tx AS (SELECT rv.*, of, first, c, i.intent IS NOT NULL AS is_known, rv.intent IN ({_NAMED(OOD)}) AS is_ood FROM rv LEFT JOIN ex USING (norm) LEFT JOIN fst USING (norm) LEFT JOIN intents i ON i.intent = rv.intent),
    gg AS (SELECT gl.*, i.intent IS NOT NULL AS taken, row_number() OVER (PARTITION BY name ORDER BY gl.line) AS nth, string_split_regex(lower(name || ' ' || description), '[^a-z0-9]+') AS ws, gl.actuation <> 'none' AS acts, gl.grp = 'vehicle_control' AS vehicle,
        {' AND '.join(f"gl.{c} IN ({_NAMED(vs)})" for c, vs in _ENUMS.items())} AS sound FROM gl LEFT JOIN intents i ON i.intent = name),
    gs AS (SELECT gg.*, (SELECT count(DISTINCT style) FROM ut WHERE source = 'goals' AND owner = gg.line) AS styles, (SELECT count(*) FROM ut WHERE source = 'goals' AND owner = gg.line AND variant IN ({_NAMED(validate.CODE_MIXED)})) AS mixed FROM gg),
    gw AS (SELECT item, owner, pos, line, norm, {_set('text')} AS s FROM ut WHERE source = 'goals'),
    pp AS (SELECT pr.*, a.intent AS ia, b.intent AS ib, CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE {_JAC('a.toks', 'b.toks')} END AS alike, row_number() OVER (PARTITION BY id ORDER BY pr.line) AS nth FROM pr JOIN ut a ON a.source = 'pairs' AND a.owner = pr.line AND a.side = 'a' JOIN ut b ON b.source = 'pairs' AND b.owner = pr.line AND b.side = 'b'),
    pb AS (SELECT pp.*, {', '.join(f'x.{t} AS a_{t}, y.{t} AS b_{t}' for t in TAGS)}, list_filter([{', '.join(f"CASE WHEN x.{t} <> y.{t} THEN '{t}' END" for t in TAGS)}], lambda v: v IS NOT NULL) AS actual FROM pp JOIN intents x ON x.intent = ia JOIN intents y ON y.intent = ib WHERE ia <> ib AND ia NOT IN ({_NAMED(OOD)}) AND ib NOT IN ({_NAMED(OOD)})),
    keys AS (SELECT DISTINCT a_capability, a_distraction, a_actuation, b_capability, b_distraction, b_actuation FROM pb),
    apart AS (SELECT DISTINCT keys.* FROM keys JOIN d x ON x.capability = a_capability AND x.distraction = a_distraction AND x.actuation = a_actuation JOIN d y ON y.capability = b_capability AND y.distraction = b_distraction AND y.actuation = b_actuation
        AND (x.speed, x.connectivity, x.workload, x.privacy, x.passenger, x.tier, x.sensitive) = (y.speed, y.connectivity, y.workload, y.privacy, y.passenger, y.tier, y.sensitive) WHERE x.route <> y.route),
    iss AS ({_rules('source', 'item', 'line', 'tx', [
        ('error', 'unknown_style', f"style NOT IN ({_NAMED(validate.STYLES)})", 'style'), ('error', 'unknown_variant', f"variant NOT IN ({_NAMED(validate.QUOTA)})", 'variant'), ('error', 'same_as_existing', 'of IS NOT NULL', 'of'),
        ('error', 'duplicate', 'c > 1 AND (source, owner, item, pos) > first', 'first[3]'), ('error', 'like_val_or_test', f'valtest.score > {validate.VALTEST_MOST}', _N2('valtest.score') + " || ' ' || valtest.near_intent"),
        ("CASE source WHEN 'pairs' THEN 'warning' ELSE 'error' END", 'like_ood', f'ood.score > {validate.OOD_MOST}', _N2('ood.score') + " || ' ' || ood.near_intent"),
        ('error', 'unknown_intent', "source = 'pairs' AND NOT is_known", 'intent'), ('error', 'ood_intent', "source = 'pairs' AND is_ood", 'intent'),
        ('warning', 'nearer_to_other_intent', f"source = 'pairs' AND is_known AND NOT is_ood AND len(differ) > 0 AND known.shared >= {validate.LEAST_SHARED}", 'known.near_intent')])}
        UNION ALL SELECT 'error', source, item, line, unnest({_FORM}), '' FROM (SELECT *, {_BARE} AS bare FROM ut)
        UNION ALL {_rules("'goals'", 'name', 'line', 'gs', [
            ('error', 'not_snake_case', "NOT regexp_matches(name, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$')", "''"), ('error', 'existing_intent', 'taken', "''"), ('error', 'repeated_name', 'nth > 1', "''"),
            *[('error', f'empty_{c}', f"trim({c}) = ''", "''") for c in ('description', 'rationale')], *[('error', 'unknown_value', f"{c} NOT IN ({_NAMED(vs)})", f"'{c}'") for c, vs in _ENUMS.items()],
            *[('error', 'broken_invariant', f'sound AND {cond}', f"'{rule}'") for rule, cond in _RULES.items()], ('error', 'vehicle_not_low_distraction', "sound AND acts AND distraction <> 'low'", "''"),
            ('error', 'names_ood_goal', f'len({_HITS}) > 0', f"array_to_string({_HITS}, '; ')"), ('warning', 'utterances', f'n NOT BETWEEN {validate.LEAST_UTTERANCES} AND {validate.MOST_UTTERANCES}', 'n::VARCHAR'),
            ('warning', 'few_styles', f'styles < {validate.LEAST_STYLES}', "''"), ('warning', 'no_code_mixed', 'mixed = 0', "''"), ('error', 'no_utterances', 'n = 0', "''")])}
        UNION ALL SELECT 'warning', 'goals', b.item, b.line, 'near_line', {_N2(_JAC('a.s', 'b.s'))} FROM gw a JOIN gw b ON a.owner = b.owner AND a.pos < b.pos AND a.norm <> b.norm WHERE {_JAC('a.s', 'b.s')} > {validate.NEAR_DUPLICATE}
        UNION ALL SELECT 'warning', 'goals', rv.item, rv.line, 'conflicting_tags', known.near_intent || ' ' || {_N2('known.score')} || ' ' || array_to_string(list_filter(differ, lambda x: x <> 'consequence'), ',') FROM rv JOIN gs ON source = 'goals' AND gs.line = owner
            WHERE sound AND NOT ({' OR '.join(f'({c})' for c in _RULES.values())} OR (acts AND distraction <> 'low')) AND known.score >= {validate.CONFLICT} AND known.shared >= {validate.LEAST_SHARED} AND len(list_filter(differ, lambda x: x <> 'consequence')) > 0
        UNION ALL {_rules("'pairs'", 'id', 'line', 'pp', [
            ('error', 'not_snake_case', "NOT regexp_matches(id, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$')", "''"), ('error', 'repeated_id', 'nth > 1', "''"), ('error', 'empty_note', "trim(note) = ''", "''"),
            ('error', 'unknown_tag', f"len(list_filter(differs_in, lambda x: NOT list_contains({_LIST(list(TAGS))}, x))) > 0", "''"), ('error', 'same_intent', 'ia = ib', 'ia'), ('error', 'texts_differ', f'alike < {validate.PAIR_LEAST}', _N2('alike'))])}
        UNION ALL {_rules("'pairs'", 'id', 'line', 'pb', [('error', 'differs_in_is_wrong', 'list_sort(list_distinct(differs_in)) <> list_sort(actual) OR len(list_distinct(differs_in)) <> len(differs_in)', "array_to_string(actual, ',')")])}
        UNION ALL SELECT 'error', 'pairs', id, line, 'routes_never_differ', '' FROM pb ANTI JOIN apart USING (a_capability, a_distraction, a_actuation, b_capability, b_distraction, b_actuation))"""
_RISKS = f"""{_ISSUES}, risk AS (SELECT source, item, max(greatest(coalesce(ood.score, 0) / {validate.OOD_MOST}, coalesce(valtest.score, 0) / {validate.VALTEST_MOST}, CASE WHEN len(differ) > 0 THEN coalesce(known.score, 0) / {validate.CONFLICT} ELSE 0 END)) AS call FROM rv GROUP BY ALL),
        err AS (SELECT source, item, count(*) AS errors FROM iss WHERE level = 'error' GROUP BY ALL), votes AS (SELECT source, item, known.near_intent AS near, count(*) AS n, min(pos) AS p FROM rv WHERE known IS NOT NULL GROUP BY ALL),
        modal AS (SELECT source, item, arg_max(near, (n, -p, near)) AS nearest FROM votes GROUP BY ALL),
        risks AS (SELECT risk.source, risk.item, round(call + coalesce(errors, 0), 6) AS risk, nearest FROM risk LEFT JOIN err ON err.source = risk.source AND err.item = risk.item LEFT JOIN modal ON modal.source = risk.source AND modal.item = risk.item),
        lv AS (SELECT source, item, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM iss GROUP BY ALL)"""
ORACLE = {
    "nearest_texts": f"WITH {_TEXTS} SELECT source, item, owner::INT AS at, side, pos::INT AS pos, " + ", ".join(f"{s}.{c} AS {s}_{c}" for s in ("known", "valtest", "ood") for c in ("score", "shared", "near_intent", "kind")) + ", array_to_string(differ, ',') AS differ FROM rv",
    "augmentation_issues": f"{_ISSUES} SELECT level, source, item, line::BIGINT AS line, code, coalesce(detail, '') AS detail FROM iss",
    "item_risks": f"""{_RISKS} SELECT source, item, risk, nearest FROM risks""",
    "review_rows": f"""{_RISKS} SELECT rv.source, rv.item, owner::INT AS at, side, pos::INT AS pos, text, CASE WHEN known IS NULL THEN '-' ELSE {_N2('known.score')} || ' ' || known.near_intent || ' ' || known.near_text END AS near, array_to_string(differ, ', ') AS differ,
        risk, nearest, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM rv JOIN risks USING (source, item) LEFT JOIN lv ON lv.source = rv.source AND lv.item = rv.item""",
}
