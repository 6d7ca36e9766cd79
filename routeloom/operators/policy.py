"""The decision policy: three lookup tables and three switches, and their checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.vocab import ACTUATIONS, DEMANDS, DISTRACTIONS, ROUTES, SPEEDS, WORKLOADS

# The default policy and the cost matrix; the names of Policy's fields, which stored policies use.
DEMAND_OF = {
    "parked|low": "parked", "parked|medium": "parked", "parked|high": "parked",
    "low|low": "low", "low|medium": "medium", "low|high": "high",
    "medium|low": "medium", "medium|medium": "medium", "medium|high": "high",
    "high|low": "medium", "high|medium": "high", "high|high": "high",
}
DISTRACTION_ALLOWED = {
    "low|parked": True, "low|low": True, "low|medium": True, "low|high": True,
    "medium|parked": True, "medium|low": True, "medium|medium": True, "medium|high": False,
    "high|parked": True, "high|low": False, "high|medium": False, "high|high": False,
}
ACTUATION_ALLOWED = {
    "safety_critical|parked": True, "safety_critical|low": True, "safety_critical|medium": True, "safety_critical|high": True,
    "comfort|parked": True, "comfort|low": True, "comfort|medium": True, "comfort|high": True,
    "restricted|parked": True, "restricted|low": False, "restricted|medium": False, "restricted|high": False,
}
COSTS = {
    "LOCAL_SAFETY_CRITICAL": {"LOCAL": 0, "CLOUD": 10, "CLOUD_MASKED": 10, "DEFER": 8, "REFUSE": 5},
    "LOCAL_OTHER": {"LOCAL": 0, "CLOUD": 2, "CLOUD_MASKED": 2, "DEFER": 2, "REFUSE": 3},
    "CLOUD": {"LOCAL": 3, "CLOUD": 0, "CLOUD_MASKED": 1, "DEFER": 2, "REFUSE": 3},
    "CLOUD_MASKED": {"LOCAL": 3, "CLOUD": 8, "CLOUD_MASKED": 0, "DEFER": 2, "REFUSE": 3},
    "DEFER": {"LOCAL": 2, "CLOUD": 4, "CLOUD_MASKED": 3, "DEFER": 0, "REFUSE": 2},
    "REFUSE": {"LOCAL": 6, "CLOUD": 10, "CLOUD_MASKED": 10, "DEFER": 4, "REFUSE": 0},
}


@dataclass(frozen=True)
class Policy:
    demand_table: dict[str, str] = field(default_factory=lambda: dict(DEMAND_OF))
    distraction_gate: dict[str, bool] = field(default_factory=lambda: dict(DISTRACTION_ALLOWED))
    actuation_gate: dict[str, bool] = field(default_factory=lambda: dict(ACTUATION_ALLOWED))
    passenger_relax_steps: int = 1
    cloud_connectivity: tuple[str, ...] = ("weak", "good")
    strict_privacy_route: str = "LOCAL"

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        d = json.loads(text)
        return cls(**d | {"cloud_connectivity": tuple(d["cloud_connectivity"])})


def tables(spark: SparkSession, policy: Policy) -> dict[str, DataFrame]:
    """The three tables as rows (a, b, value), split from their composite keys."""
    out = {}
    for name in ("demand_table", "distraction_gate", "actuation_gate"):
        rows = [(k, str(v).lower() if isinstance(v, bool) else v) for k, v in getattr(policy, name).items()]
        cells = spark.createDataFrame(rows, "key string, value string")
        parts = F.split("key", r"\|")
        out[name] = cells.select(parts[0].alias("a"), parts[1].alias("b"), "value")
    return out


def violations(spark: SparkSession, policy: Policy) -> DataFrame:
    """(rule, cell): every way in which a policy is not usable; no rows for a good one."""
    t = tables(spark, policy)
    axis = lambda xs, c: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], f"{c} string, {c}_rank int")
    grids = {"demand_table": (SPEEDS, WORKLOADS), "distraction_gate": (DISTRACTIONS, DEMANDS), "actuation_gate": (ACTUATIONS[1:], DEMANDS)}
    cell = F.concat_ws("|", "a", "b")
    found = []
    for name, (xs, ys) in grids.items():
        every = axis(xs, "a").crossJoin(axis(ys, "b"))  # a fixed grid of at most 12 cells
        found.append(every.join(t[name], ["a", "b"], "left_anti").select(F.lit(f"{name}: missing").alias("rule"), cell.alias("cell")))
        rank = F.array_position(F.array(*map(F.lit, DEMANDS)), F.col("value")) if name == "demand_table" else F.when(F.col("value") == "true", 0).otherwise(1)
        ranked = every.join(t[name], ["a", "b"]).withColumn("v", rank.cast("int"))
        for by, along in (("a", "b"),) if name == "actuation_gate" else (("a", "b"), ("b", "a")):
            w = Window.partitionBy(by).orderBy(f"{along}_rank")
            found.append(ranked.withColumn("before", F.lag("v").over(w)).where("v < before").select(F.lit(f"{name}: falls along {along}").alias("rule"), cell.alias("cell")))
    found.append(t["actuation_gate"].where("a = 'safety_critical' and value = 'false'").select(F.lit("actuation_gate: safety blocked").alias("rule"), cell.alias("cell")))
    found.append(t["demand_table"].where("a = 'parked' and value <> 'parked'").select(F.lit("demand_table: parked car has demand").alias("rule"), cell.alias("cell")))
    if policy.passenger_relax_steps < 0:
        found.append(spark.sql("select 'passenger_relax_steps: negative' as rule, '' as cell"))
    if policy.strict_privacy_route.startswith("CLOUD"):
        found.append(spark.sql("select 'strict_privacy_route: a cloud route' as rule, '' as cell"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cost_table(spark: SparkSession, costs: dict[str, dict[str, float]] = COSTS) -> DataFrame:
    """The 30 cells (true_row, pred, cost)."""
    return spark.createDataFrame([(t, p, float(c)) for t, row in costs.items() for p, c in row.items()], "true_row string, pred string, cost double")


def cost_violations(spark: SparkSession, costs: dict) -> DataFrame:
    """(rule, cell): every way in which a cost matrix is not usable; no rows for a good one."""
    cells = [(t, p, json.dumps(c)) for t, row in costs.items() for p, c in row.items()]
    got = spark.createDataFrame(cells, "t string, p string, c string")
    want = spark.createDataFrame([(t, p, p == ("LOCAL" if t.startswith("LOCAL_") else t)) for t in COSTS for p in ROUTES], "t string, p string, diagonal boolean")
    cell = F.concat_ws("|", "t", "p").alias("cell")
    value, number = F.col("c").try_cast("double"), F.col("c").rlike(r"^-?[0-9.]+(?:[eE][+-]?[0-9]+)?$")
    issue = lambda df, rule: df.select(F.lit(rule).alias("rule"), cell)
    return (
        issue(want.join(got, ["t", "p"], "left_anti"), "missing").unionByName(issue(got.join(want, ["t", "p"], "left_anti"), "unexpected"))
        .unionByName(issue(got.join(want, ["t", "p"]).where(~number | (value < 0)), "no number of 0 or more"))
        .unionByName(issue(got.join(want, ["t", "p"]).where(F.col("diagonal") & number & (value != 0)), "a right route has a cost"))
    )
