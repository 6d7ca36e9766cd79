"""Queries over summaries of row sets and augmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import metrics, summary
from routeloom.operators.decide import ARRAY
from routeloom.plans.checks import _PICK, written_lines
from routeloom.plans.evaluation import COST, PRED
from routeloom.plans.routing import DECIDED
from routeloom.plans.texts import _norm
from routeloom.sources.tables import AUGMENT_SOURCES, from_records, in_splits, predictions, records, routed, spread, table, with_intent_tags
from routeloom.vocab import REASONS, ROUTES, SPLITS, TAGS

SOURCES = ["seed", "paraphrase", "asr", "synthetic_goal", "minimal_pair"]
VARIANTS = ["plain", "hinglish", "disfluent"]
STYLES = ["command", "indirect", "question"]
GROUPS = ["vehicle_control", "media", "planning", "travel"]
OF_ROWS = ["split", "route", "reason", "style", "source", "variant", "sensitive", "passenger", "split_route"]
OF_UTTERANCES = ["source", "variant", "sensitive"]
KNOWN = {
    "split": SPLITS, "route": ROUTES, "reason": REASONS, "source": [*SOURCES, "other"], "variant": [*VARIANTS, "asr"],
    "sensitive": ["true", "false"], "split_route": [f"{s}|{r}" for s in SPLITS for r in ROUTES],
}


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(ARRAY(values), (i % len(values) + 1).cast("int"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Decided requests as rows of seeds and utterances."""
    k = F.col("event_id")
    split = F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").otherwise("train")
    rows = routed(spark, d).withColumns({
        "id": k, "seed_id": k % 50, "utterance_id": F.floor(k / 4), "intent": k % 20, "split": split, "source": _pick(SOURCES, F.floor(k / 7)), "variant": _pick(VARIANTS, F.floor(k / 5)),
        "pair_id": F.when(_pick(SOURCES, F.floor(k / 7)) == "minimal_pair", F.floor(k / 2)), "is_synthetic": _pick(SOURCES, F.floor(k / 7)) == "synthetic_goal",
    })
    return rows.withColumn("split_route", F.concat_ws("|", "split", "route"))


def row_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2 in full: rows, utterances and seeds counted, zeros filled, with shares."""
    return summary.summary(_rows(spark, d), OF_ROWS, OF_UTTERANCES, KNOWN)


def augmented_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2: what augmentation adds."""
    return summary.augmented(_rows(spark, d), SOURCES[3:])


def augmentation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Customers as goals, parts as pairs, suppliers as training intents."""
    tags = lambda k: [_pick(GROUPS[:3], k).alias("grp"), *[_pick(v, F.floor(k / (i + 2))).alias(t) for i, (t, v) in enumerate(TAGS.items())]]
    k, p = F.col("c_custkey"), F.col("p_partkey")
    said = F.transform(F.sequence(F.lit(1).cast("long"), k % 3 + 1), lambda i: F.struct(_pick(STYLES, k + i).alias("style"), _pick(VARIANTS, i).alias("variant")))
    goals = table(spark, d, "customer").select(*tags(k), said.alias("utterances"))
    side = lambda i: F.struct(F.concat(F.lit("i"), (i % 5).cast("string")).alias("intent"))
    pairs = table(spark, d, "part").select(F.slice(ARRAY(list(TAGS)), (p % 3 + 1).cast("int"), (p % 2 + 1).cast("int")).alias("differs_in"), side(p).alias("a"), side(F.col("p_size")).alias("b"))
    return summary.augmentation_stats(goals, pairs, table(spark, d, "supplier").select(*tags(F.col("s_suppkey"))), GROUPS)


def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The best of seven epochs of predictions."""
    history = metrics.report(predictions(spark, d).withColumn("epoch", F.col("event_id") % 7), ["epoch"])
    return summary.best_epoch(history.select("epoch", "n", "swe", "macro_f1"))


def missing_intents(spark: SparkSession, d: str) -> DataFrame:
    """J18."""
    lines, seeds = written_lines(spark, d)
    return summary.missing_intents(seeds, lines.where("line < 40"))


def first_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each normal form."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return summary.first_texts(docs.select(F.md5(X.normalize(F.col("text"))).alias("norm"), "doc_id"), "norm", "doc_id")


def stored_records(spark: SparkSession, d: str) -> DataFrame:
    """SC1, P12, P13: orders as rows written to JSON texts and read back, of two splits."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("id"), _pick(SPLITS, k).alias("split"), _pick(SOURCES, F.col("o_custkey")).alias("source"), _pick(["formal", "plain"], F.floor(k / 4)).alias("variant"),
        (k % 5 == 0).alias("is_synthetic"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("pair_id"),
    )
    return in_splits(from_records(records(rows, include_source=False), rows.schema), "train, val")


def intent_tags(spark: SparkSession, d: str) -> DataFrame:
    """Line items' tags, their supplier's where it is a known intent and the row is not synthetic; counted."""
    tags = lambda i: [_pick(TAGS[t], i + n).alias(t) for n, t in enumerate(TAGS)]
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("intent"), (F.col("l_linenumber") == 2).alias("is_synthetic"), *tags(F.col("l_orderkey")))
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("intent"), *tags(F.col("s_nationkey")))
    return with_intent_tags(rows, of).groupBy("intent", *TAGS).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (row_summary, augmented_summary, augmentation_stats, best_epoch, missing_intents, first_texts, stored_records, intent_tags)}

_ROWS = f"""{DECIDED}, q AS (SELECT *, event_id AS id, event_id % 50 AS seed_id, event_id // 4 AS utterance_id, event_id % 20 AS intent,
    CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, {_PICK(SOURCES, 'event_id // 7')} AS source, {_PICK(VARIANTS, 'event_id // 5')} AS variant FROM d),
    rows AS (SELECT *, split || '|' || route AS split_route FROM q)"""
_VALUES = lambda level, columns: ", ".join(f"('{level}', '{c}', '{v}', 0)" for c in columns for v in KNOWN.get(c, []))
_COUNT = lambda level, source, column: f"SELECT '{level}' AS level, '{column}' AS name, {column}::VARCHAR AS value, count(*) AS n FROM {source} GROUP BY ALL"
_TAGGED = lambda key: f"{_PICK(GROUPS[:3], key)} AS grp, " + ", ".join(f"{_PICK(v, f'({key} // {i + 2})')} AS {t}" for i, (t, v) in enumerate(TAGS.items()))
_NAMES = ["grp", *TAGS]
_KNOWN_TAGS = ", ".join(f"('tag', '{c}', '{v}', 0, 0, 0)" for c, vs in {"grp": GROUPS, **TAGS}.items() for v in vs)
_TAGS_AT = lambda i, name: ", ".join(f"{_PICK(TAGS[t], f'{i} + {n}')} AS {name}_{t}" for n, t in enumerate(TAGS))
ORACLE = {
    "row_summary": f"""{_ROWS}, first AS (SELECT unnest(min({{'id': id, 'source': source, 'variant': variant, 'sensitive': sensitive}})) FROM rows GROUP BY utterance_id),
        seeds AS (SELECT DISTINCT seed_id, split FROM rows),
        c AS ({' UNION ALL '.join(_COUNT('row', 'rows', c) for c in OF_ROWS)} UNION ALL {' UNION ALL '.join(_COUNT('utterance', 'first', c) for c in OF_UTTERANCES)} UNION ALL {_COUNT('seed', 'seeds', 'split')}
            UNION ALL SELECT 'row', 'all', '', count(*) FROM rows UNION ALL SELECT 'utterance', 'all', '', count(*) FROM first UNION ALL SELECT 'seed', 'all', '', count(DISTINCT seed_id) FROM seeds
            UNION ALL SELECT * FROM (VALUES {_VALUES('row', OF_ROWS)}, {_VALUES('utterance', OF_UTTERANCES)}, {_VALUES('seed', ['split'])}) v),
        s AS (SELECT level, name, value, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
        SELECT *, round(n / (SELECT max(n) FROM s t WHERE t.level = s.level AND t.name = 'all')::DOUBLE, 4) AS rate FROM s""",
    "augmented_summary": f"""{_ROWS} SELECT count(*) AS n_rows, count(DISTINCT intent) FILTER (source = 'synthetic_goal') AS synthetic_goals, count(*) FILTER (source = 'synthetic_goal') AS synthetic_goal_rows,
        count(DISTINCT id // 2) FILTER (source = 'minimal_pair') AS minimal_pairs, count(*) FILTER (source = 'minimal_pair') AS minimal_pair_rows, count(DISTINCT utterance_id) AS utterances
        FROM rows WHERE source IN ('synthetic_goal', 'minimal_pair')""",
    "augmentation_stats": f"""WITH g AS (SELECT c_custkey AS k, c_custkey % 3 + 1 AS u, {_TAGGED('c_custkey')} FROM customer), i AS (SELECT {_TAGGED('s_suppkey')} FROM supplier),
        w AS (SELECT {_PICK(STYLES, '(k + i)')} AS style, {_PICK(VARIANTS, 'i')} AS variant FROM (SELECT k, unnest(range(1, u + 1)) AS i FROM g)),
        p AS (SELECT ({list(TAGS)})[p_partkey % 3 + 1 : p_partkey % 3 + 1 + p_partkey % 2] AS differs, 'i' || p_partkey % 5 AS a, 'i' || p_size % 5 AS b FROM part),
        c AS ({' UNION ALL '.join(f"SELECT 'tag' AS level, '{c}' AS name, {c} AS value, 1 AS n, u AS utterances, 0 AS train FROM g UNION ALL SELECT 'tag', '{c}', {c}, 0, 0, 1 FROM i" for c in _NAMES)}
            UNION ALL SELECT * FROM (VALUES {_KNOWN_TAGS}) v UNION ALL SELECT 'tags', '', concat_ws(' / ', {', '.join(TAGS)}), 1, u, 0 FROM g
            UNION ALL SELECT 'said', 'style', style, 0, 1, 0 FROM w UNION ALL SELECT 'said', 'variant', variant, 0, 1, 0 FROM w
            UNION ALL SELECT 'differs_in', '', unnest(differs), 1, 0, 0 FROM p UNION ALL SELECT 'differs_in', '', unnest({list(TAGS)}), 0, 0, 0
            UNION ALL SELECT 'differs_in_set', '', array_to_string(differs, ', '), 1, 0, 0 FROM p UNION ALL SELECT 'intents', '', least(a, b) || ' / ' || greatest(a, b), 1, 0, 0 FROM p)
        SELECT level, name, value, sum(n)::BIGINT AS n, sum(utterances)::BIGINT AS utterances, sum(train)::BIGINT AS train FROM c GROUP BY ALL""",
    "best_epoch": f"""{PRED}, {COST}, s AS (SELECT event_id % 7 AS epoch, y, p.p AS p, cost.cost FROM p JOIN cost ON cost.p = p.p AND cost.true_row = CASE WHEN y <> 'LOCAL' THEN y WHEN safety THEN 'LOCAL_SAFETY_CRITICAL' ELSE 'LOCAL_OTHER' END),
        k AS (SELECT epoch, v, sum(tp) AS tp, sum(a + b) AS ab FROM (SELECT epoch, y AS v, (y = p)::INT AS tp, 1 AS a, 0 AS b FROM s UNION ALL SELECT epoch, p, 0, 0, 1 FROM s) GROUP BY ALL),
        f AS (SELECT epoch, round(avg(2 * tp / ab::DOUBLE), 6) AS macro_f1 FROM k GROUP BY epoch), m AS (SELECT epoch, count(*) AS n, round(avg(cost), 6) AS swe FROM s GROUP BY epoch)
        SELECT epoch, n, swe, macro_f1 FROM m JOIN f USING (epoch) ORDER BY swe, macro_f1 DESC, epoch LIMIT 1""",
    "missing_intents": "WITH s AS (SELECT DISTINCT user_id % 40 AS u FROM events WHERE user_id % 40 % 9 <> 0) SELECT 'i' || u AS intent FROM s WHERE u NOT IN (SELECT user_id % 40 FROM events WHERE event_id < 40)",
    "first_texts": f"SELECT md5({_norm('text')}) AS norm, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "stored_records": f"""WITH r AS (SELECT o_orderkey AS k, {_PICK(SOURCES, 'o_custkey')} AS own, own IN ({', '.join(f"'{x}'" for x in AUGMENT_SOURCES)}) AS kept, {_PICK(SPLITS, 'o_orderkey')} AS split FROM orders)
        SELECT k::VARCHAR AS id, split, CASE WHEN kept THEN own ELSE 'seed' END AS source, CASE WHEN kept THEN {_PICK(['formal', 'plain'], 'k // 4')} ELSE 'plain' END AS variant, k % 5 = 0 AS is_synthetic,
            CASE WHEN k % 3 = 0 THEN o_orderpriority END AS pair_id FROM r JOIN orders ON o_orderkey = k WHERE split IN ('train', 'val')""",
    "intent_tags": f"""WITH i AS (SELECT s_suppkey AS intent, {_TAGS_AT('s_nationkey', 'own')} FROM supplier), r AS (SELECT l_suppkey * 2 AS intent, l_linenumber = 2 AS syn, {_TAGS_AT('l_orderkey', 'of')} FROM lineitem),
        t AS (SELECT r.intent, {', '.join(f'CASE WHEN i.intent IS NOT NULL AND NOT syn THEN own_{t} ELSE of_{t} END AS {t}' for t in TAGS)} FROM r LEFT JOIN i ON i.intent = r.intent)
        SELECT *, count(*) AS n FROM t GROUP BY ALL""",
}
