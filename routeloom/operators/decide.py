"""The decision tree as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.operators.policy import Policy
from routeloom.vocab import DEMANDS, TAGS

ARRAY = lambda xs: F.array(*map(F.lit, xs))


def _fail(what: str, *keys: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"no policy cell: {what} "), F.concat_ws("|", *keys)))


def raw_rank(policy: Policy, speed: Column, workload: Column) -> Column:
    """The rank of the demand of a speed and a workload; an unknown pair fails the query."""
    cells = F
    for key, demand in policy.demand_table.items():
        a, b = key.split("|")
        cells = cells.when((speed == a) & (workload == b), DEMANDS.index(demand))
    return cells.otherwise(_fail("demand", speed, workload).cast("int"))


def relaxed(rank: Column, steps: Column) -> Column:
    """Parked stays parked; otherwise down by steps, low at least."""
    return F.when(rank == 0, 0).otherwise(F.greatest(rank - steps, F.lit(1)))


def allowed(gate: dict[str, bool], level: Column, rank: Column) -> Column:
    """A gate's cell for a level and a demand's rank; an unknown level fails the query."""
    levels: dict[str, list[int]] = {}
    for key, may in gate.items():
        a, b = key.split("|")
        levels.setdefault(a, []).extend([DEMANDS.index(b)] * may)
    cells = F
    for a, ranks in levels.items():
        cells = cells.when(level == a, rank.isin(*ranks) if ranks else F.lit(False))
    return cells.otherwise(_fail("gate", level).cast("boolean"))


def route_columns(df: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Add route, reason and demand. Needs speed, workload, connectivity, privacy, passenger,
    tier, capability, distraction, actuation and sensitive."""
    policy = policy or Policy()
    c = F.col
    df = df.withColumn("_raw", raw_rank(policy, c("speed"), c("workload")))
    df = df.withColumn("_relaxed", relaxed(c("_raw"), F.when(c("passenger"), policy.passenger_relax_steps).otherwise(0)))
    offline = ~c("connectivity").isin(*policy.cloud_connectivity)
    reason = (
        F.when(c("actuation") == "safety_critical", "safety_critical")
        .when((c("actuation") != "none") & ~F.when(c("actuation") == "none", True).otherwise(allowed(policy.actuation_gate, c("actuation"), c("_raw"))), "restricted_actuation")
        .when(~allowed(policy.distraction_gate, c("distraction"), c("_relaxed")), "distraction")
        .when((c("capability") == "local_ok") | ((c("capability") == "needs_small_local") & (c("tier") == "small")), "local_capable")
        .when(offline & (c("capability") == "cloud_preferred"), "local_fallback")
        .when(offline, "no_connectivity")
        .when(c("sensitive") & (c("privacy") == "strict"), "strict_privacy")
        .when(c("sensitive"), "sensitive_spans")
        .when(c("capability").isin(*TAGS["capability"]), "cloud_default")
        .otherwise(F.raise_error(F.lit("unknown capability")).cast("string"))
    )
    # generated once a row: filters on a route stop here instead of taking the tree along many times
    df = df.withColumn("_d", F.explode(F.array(F.struct(reason.alias("reason"), c("_raw").alias("raw"), c("_relaxed").alias("relaxed"))))).withColumn("reason", c("_d.reason"))
    route = (
        F.when(c("reason").isin("safety_critical", "local_capable", "local_fallback"), "LOCAL").when(c("reason").isin("restricted_actuation", "distraction"), "REFUSE")
        .when(c("reason") == "no_connectivity", "DEFER").when(c("reason") == "strict_privacy", policy.strict_privacy_route).when(c("reason") == "sensitive_spans", "CLOUD_MASKED").otherwise("CLOUD")
    )
    rank = F.when(c("reason") == "restricted_actuation", c("_d.raw")).otherwise(c("_d.relaxed"))
    demand = F.when(rank == 0, DEMANDS[0]).when(rank == 1, DEMANDS[1]).when(rank == 2, DEMANDS[2]).otherwise(DEMANDS[3])
    return df.withColumns({"route": route, "demand": demand}).drop("_raw", "_relaxed", "_d")


def context_prefix() -> Column:
    """Six bracketed pairs."""
    pairs = [("speed", F.col("speed")), ("connectivity", F.col("connectivity")), ("workload", F.col("workload")), ("privacy", F.col("privacy")), ("passenger", F.when(F.col("passenger"), "yes").otherwise("no")), ("tier", F.col("tier"))]
    return F.concat_ws(" ", *[F.concat(F.lit(f"[{k}="), v, F.lit("]")) for k, v in pairs])


def adversarial(style: Column, actuation: Column, route: Column) -> Column:
    return ((style == "question") & (actuation == "restricted")) | (style.isin("question", "indirect") & (route == "REFUSE"))


def true_row(route: Column, safety: Column) -> Column:
    return F.when(route != "LOCAL", route).when(safety, "LOCAL_SAFETY_CRITICAL").otherwise("LOCAL_OTHER")


def critical(y: Column, p: Column, safety: Column) -> tuple[Column, Column]:
    """(eligible, missed)."""
    cloud = p.isin("CLOUD", "CLOUD_MASKED")
    guarded, refused = (y == "LOCAL") & safety, y == "REFUSE"
    return guarded | refused, (guarded & cloud) | (refused & (cloud | (p == "LOCAL")))


def combine(e2e: Column, tag: Column, tag_actuation: Column) -> Column:
    """The more cautious of two routes."""
    either = lambda r: (e2e == r) | (tag == r)
    return (
        F.when(tag_actuation == "safety_critical", tag).when(either("REFUSE"), "REFUSE").when(either("DEFER"), "DEFER")
        .when(either("CLOUD_MASKED") & either("CLOUD"), "CLOUD_MASKED").otherwise(tag)
    )


def argmax_name(probs: Column, names: list[str]) -> Column:
    """The name of the largest value in an array; the first on ties."""
    return F.element_at(ARRAY(names), F.array_position(probs, F.array_max(probs)).cast("int"))


def decode_actuation(p: Column, safety: float = 0.3, restricted: float = 0.3) -> Column:
    at = {n: p[i] for i, n in enumerate(TAGS["actuation"])}
    return F.when(at["safety_critical"] >= safety, "safety_critical").when(at["restricted"] >= restricted, "restricted").otherwise(argmax_name(p, TAGS["actuation"]))


def decode_distraction(p: Column, high: float = 0.3, medium_high: float = 0.5) -> Column:
    at = {n: p[i] for i, n in enumerate(TAGS["distraction"])}
    return F.when(at["high"] >= high, "high").when(at["medium"] + at["high"] >= medium_high, "medium").otherwise(argmax_name(p, TAGS["distraction"]))
