"""Queries over the decision engine, contexts, splits and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import contexts, decide, policy, splits
from routeloom.sources.tables import requests, routed, table
from routeloom.vocab import ROUTES

REQUESTS = """r AS (
    SELECT event_id,
        (['parked','low','medium','high'])[user_id % 4 + 1] AS speed, (['none','weak','good'])[event_id % 3 + 1] AS connectivity,
        (['low','medium','high'])[floor(value)::BIGINT % 3 + 1] AS workload, CASE WHEN user_id % 2 = 0 THEN 'standard' ELSE 'strict' END AS privacy,
        event_id % 2 = 1 AS passenger, CASE WHEN user_id % 3 = 0 THEN 'small' ELSE 'tiny' END AS tier, event_id % 7 = 0 AS sensitive,
        CASE event_type WHEN 'click' THEN 'local_ok' WHEN 'view' THEN 'cloud_preferred' WHEN 'signup' THEN 'needs_small_local' ELSE 'needs_cloud' END AS capability,
        CASE event_id % 5 WHEN 0 THEN 'safety_critical' WHEN 1 THEN 'restricted' WHEN 2 THEN 'comfort' ELSE 'none' END AS actuation,
        CASE WHEN value < 5 THEN 'low' WHEN value < 15 THEN 'medium' ELSE 'high' END AS distraction,
        CASE WHEN user_id % 5 = 0 THEN 'question' WHEN user_id % 5 = 1 THEN 'indirect' ELSE 'command' END AS style,
        (props->>'$.k')::INT AS k
    FROM events)"""


def decided(source: str, name: str = "d") -> str:
    """CTEs that decide the rows of a relation."""
    return f"""{name}0 AS (
        SELECT *, CASE WHEN speed = 'parked' THEN 0 WHEN speed = 'low' THEN CASE workload WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END
            WHEN speed = 'medium' THEN CASE WHEN workload = 'high' THEN 3 ELSE 2 END ELSE CASE WHEN workload = 'low' THEN 2 ELSE 3 END END AS raw FROM {source}
    ), {name}1 AS (SELECT *, CASE WHEN raw = 0 THEN 0 WHEN passenger THEN greatest(raw - 1, 1) ELSE raw END AS rel FROM {name}0
    ), {name}2 AS (
        SELECT *, CASE WHEN actuation = 'safety_critical' THEN 'safety_critical' WHEN actuation = 'restricted' AND raw > 0 THEN 'restricted_actuation'
            WHEN (distraction = 'medium' AND rel = 3) OR (distraction = 'high' AND rel > 0) THEN 'distraction'
            WHEN capability = 'local_ok' OR (capability = 'needs_small_local' AND tier = 'small') THEN 'local_capable'
            WHEN connectivity = 'none' AND capability = 'cloud_preferred' THEN 'local_fallback' WHEN connectivity = 'none' THEN 'no_connectivity'
            WHEN sensitive AND privacy = 'strict' THEN 'strict_privacy' WHEN sensitive THEN 'sensitive_spans' ELSE 'cloud_default' END AS reason FROM {name}1
    ), {name} AS (
        SELECT * EXCLUDE (raw, rel), CASE reason WHEN 'restricted_actuation' THEN 'REFUSE' WHEN 'distraction' THEN 'REFUSE' WHEN 'no_connectivity' THEN 'DEFER'
            WHEN 'sensitive_spans' THEN 'CLOUD_MASKED' WHEN 'cloud_default' THEN 'CLOUD' ELSE 'LOCAL' END AS route,
            (['parked','low','medium','high'])[CASE WHEN reason = 'restricted_actuation' THEN raw ELSE rel END + 1] AS demand FROM {name}2)"""


DECIDED = f"WITH {REQUESTS}, {decided('r')}"
GRID = """g AS (SELECT * FROM
    (SELECT unnest(['parked','low','medium','high']) AS speed), (SELECT unnest(['none','weak','good']) AS connectivity), (SELECT unnest(['low','medium','high']) AS workload),
    (SELECT unnest(['standard','strict']) AS privacy), (SELECT unnest([false, true]) AS passenger), (SELECT unnest(['tiny','small']) AS tier))"""
TRIPLES = """t AS (SELECT * FROM
    (SELECT unnest(['local_ok','needs_small_local','needs_cloud','cloud_preferred']) AS capability), (SELECT unnest(['low','medium','high']) AS distraction),
    (SELECT unnest(['none','safety_critical','comfort','restricted']) AS actuation), (SELECT unnest([false, true]) AS sensitive))"""
MAPPED = f"WITH {GRID}, {TRIPLES}, x AS (SELECT * FROM g, t), {decided('x')}"
BY = ["capability", "distraction", "actuation", "sensitive"]


def route_events(spark: SparkSession, d: str) -> DataFrame:
    """Every request decided."""
    return routed(spark, d).select("event_id", "route", "reason", "demand")


def route_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1: decisions counted."""
    return routed(spark, d).groupBy("route", "reason", "demand").agg(F.count("*").alias("n"))


def summary_sets(spark: SparkSession, d: str) -> DataFrame:
    """A2: counts by route, by reason, by both and in all, in one pass."""
    r = routed(spark, d)
    return r.groupingSets([["route"], ["reason"], ["route", "reason"], []], "route", "reason").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("level", "route", "reason", "n")


def route_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A4: routes across, zeros filled."""
    wide = routed(spark, d).groupBy("style").pivot("route", ROUTES).count()
    return wide.select("style", *[F.coalesce(r, F.lit(0)).alias(r) for r in ROUTES])


def adversarial_events(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    return routed(spark, d).where(decide.adversarial(F.col("style"), F.col("actuation"), F.col("route"))).select("event_id", "style", "route")


def context_grid(spark: SparkSession, d: str) -> DataFrame:
    """SC15, P9: the 288 contexts with their prefix."""
    return contexts.contexts(spark).select(decide.context_prefix().alias("prefix"))


def flip_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The routes each tag triple takes over all contexts."""
    return contexts.flip_profile(contexts.route_map(spark), BY)


def routes_differ(spark: SparkSession, d: str) -> DataFrame:
    """In how many contexts two capabilities route apart, other tags alike."""
    m = contexts.route_map(spark)
    keys = [*BY[1:], *contexts.CONTEXT]
    a = m.select(*keys, F.col("capability").alias("a"), F.col("route").alias("ra"))
    b = m.select(*keys, F.col("capability").alias("b"), F.col("route").alias("rb"))
    return a.join(b, keys).where("a < b and ra <> rb").groupBy("a", "b", "distraction", "actuation", "sensitive").agg(F.count("*").alias("n"))


def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    """None for the default policy."""
    return policy.violations(spark, policy.Policy())


def cost_cells(spark: SparkSession, d: str) -> DataFrame:
    """SC11, D10, P21."""
    return policy.cost_table(spark)


def context_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three contexts for each tag triple, rare routes first."""
    return contexts.sample_contexts(contexts.route_map(spark), BY).select(*BY, "slot", *contexts.CONTEXT, "route")


def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Customers as seeds, nation and segment as intent."""
    c = table(spark, d, "customer")
    return splits.assign(c.select(F.col("c_custkey").alias("id"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("intent"), (F.col("c_nationkey") % 7).alias("grp")))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """SC3, O2: a sample of a hundred orders by key (the sample is the feature)."""
    return splits.sample(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composed keys taken apart."""
    r = requests(spark, d)
    full = F.concat(F.col("capability"), F.lit("/"), F.col("event_id").cast("string"), F.lit("-"), F.col("k").cast("string"))
    return r.select("event_id", full.alias("id"), F.regexp_replace(full, "-[^-]*$", "").alias("utterance_key"), F.regexp_replace(full, "/[^/]*$", "").alias("intent"))


def enum_issues(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities outside the expected list, as issue rows."""
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    o = table(spark, d, "orders").where(~F.col("o_orderpriority").isin(known))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(F.lit("error").alias("level"), F.col("o_orderpriority").alias("item"), "n")


QUERIES = {f.__name__: f for f in (route_events, route_summary, summary_sets, route_pivot, adversarial_events, context_grid, flip_profiles, routes_differ, policy_violations, cost_cells, context_sample, split_assignment, seeded_sample, request_keys, enum_issues)}

_KEY = lambda *p: "('0x' || substr(md5(concat_ws('/', '0', " + ", ".join(p) + ")), 1, 8))::BIGINT"
_B = "capability, distraction, actuation, sensitive"
_CTX = "speed, connectivity, workload, privacy, passenger, tier"
ORACLE = {
    "route_events": f"{DECIDED} SELECT event_id, route, reason, demand FROM d",
    "route_summary": f"{DECIDED} SELECT route, reason, demand, count(*) AS n FROM d GROUP BY ALL",
    "summary_sets": f"{DECIDED} SELECT grouping_id(route, reason) AS level, route, reason, count(*) AS n FROM d GROUP BY GROUPING SETS ((route), (reason), (route, reason), ())",
    "route_pivot": f"{DECIDED} SELECT style, " + ", ".join(f"count(*) FILTER (route = '{r}') AS {r}" for r in ROUTES) + " FROM d GROUP BY style",
    "adversarial_events": f"{DECIDED} SELECT event_id, style, route FROM d WHERE (style = 'question' AND actuation = 'restricted') OR (style IN ('question', 'indirect') AND route = 'REFUSE')",
    "context_grid": f"WITH {GRID} SELECT '[speed=' || speed || '] [connectivity=' || connectivity || '] [workload=' || workload || '] [privacy=' || privacy || '] [passenger=' || CASE WHEN passenger THEN 'yes' ELSE 'no' END || '] [tier=' || tier || ']' AS prefix FROM g",
    "flip_profiles": f"{MAPPED} SELECT {_B}, array_to_string(list_sort(list(DISTINCT route)), '+') AS profile, count(DISTINCT route) = 1 AS context_invariant FROM d GROUP BY {_B}",
    "routes_differ": f"{MAPPED} SELECT p.capability AS a, q.capability AS b, p.distraction, p.actuation, p.sensitive, count(*) AS n FROM d p JOIN d q USING (distraction, actuation, sensitive, {_CTX}) WHERE p.capability < q.capability AND p.route <> q.route GROUP BY ALL",
    "policy_violations": "SELECT '' AS rule, '' AS cell WHERE false",
    "cost_cells": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{p}', {float(c)}::DOUBLE)" for t, row in policy.COSTS.items() for p, c in row.items()) + ") v(true_row, pred, cost)",
    "context_sample": f"""{MAPPED}, n AS (SELECT {_B}, route, count(*) AS n FROM d GROUP BY ALL),
        o AS (SELECT {_B}, route, round(-ln(({_KEY('capability', 'distraction', 'actuation', 'sensitive::VARCHAR', 'route')} + 0.5::DOUBLE) / 4294967296::DOUBLE) * n, 9) AS p FROM n),
        j AS (SELECT *, row_number() OVER (PARTITION BY {_B}, route ORDER BY {_KEY('capability', 'distraction', 'actuation', 'sensitive::VARCHAR', 'speed', 'connectivity', 'workload', 'privacy', 'passenger::VARCHAR', 'tier')}, {_CTX}) AS j FROM d),
        s AS (SELECT *, row_number() OVER (PARTITION BY {_B} ORDER BY j, p, route)::INT AS slot FROM j JOIN o USING ({_B}, route))
        SELECT {_B}, slot, {_CTX}, route FROM s WHERE slot <= 3""",
    "split_assignment": """WITH b AS (SELECT c_custkey AS id, c_nationkey || '/' || c_mktsegment AS intent, c_nationkey % 7 AS grp, md5('0/' || c_custkey) AS k FROM customer),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp, intent ORDER BY k, id) AS r, count(*) OVER (PARTITION BY grp, intent) AS n, count(*) OVER (PARTITION BY grp) AS g FROM b),
        e AS (SELECT *, r <= n - 2 AS eligible FROM r),
        f AS (SELECT *, sum(eligible::INT) OVER (PARTITION BY grp ORDER BY k, id ROWS UNBOUNDED PRECEDING) AS e, greatest(1, round_even(g * 0.1::DOUBLE, 0)::INT) AS want FROM e)
        SELECT id, grp, intent, CASE WHEN eligible AND e <= want THEN 'test' WHEN eligible AND e <= 2 * want THEN 'val' ELSE 'train' END AS split FROM f""",
    "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY md5('0/' || o_orderkey), o_orderkey LIMIT 100",
    "request_keys": f"WITH {REQUESTS}, f AS (SELECT event_id, capability || '/' || event_id || '-' || k AS id FROM r) SELECT event_id, id, regexp_replace(id, '-[^-]*$', '') AS utterance_key, regexp_replace(id, '/[^/]*$', '') AS intent FROM f",
    "enum_issues": "SELECT 'error' AS level, o_orderpriority AS item, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority",
}
