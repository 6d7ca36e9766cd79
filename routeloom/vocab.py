"""Closed vocabularies (order is sort and index order) and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
SPEEDS = ["parked", "low", "medium", "high"]
CONNECTIVITY = ["none", "weak", "good"]
WORKLOADS = ["low", "medium", "high"]
PRIVACY = ["standard", "strict"]
TIERS = ["tiny", "small"]
ROUTES = ["LOCAL", "CLOUD", "CLOUD_MASKED", "DEFER", "REFUSE"]
DEMANDS = ["parked", "low", "medium", "high"]
CAPABILITIES = ["local_ok", "needs_small_local", "needs_cloud", "cloud_preferred"]
DISTRACTIONS = ["low", "medium", "high"]
ACTUATIONS = ["none", "safety_critical", "comfort", "restricted"]
CONSEQUENCES = ["none", "reversible", "irreversible"]
REASONS = ["safety_critical", "restricted_actuation", "distraction", "local_capable", "local_fallback", "no_connectivity", "strict_privacy", "sensitive_spans", "cloud_default"]
SPLITS = ["train", "val", "test", "ood"]
TAGS = {"capability": CAPABILITIES, "distraction": DISTRACTIONS, "actuation": ACTUATIONS, "consequence": CONSEQUENCES}
DANGEROUS = {"capability": [], "distraction": ["high"], "actuation": ["safety_critical", "restricted"], "consequence": ["irreversible"]}

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])

_STRINGS = "id seed_id intent group style utterance".split()
ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("bio", T.ArrayType(T.StringType())), T.StructField("has_sensitive_spans", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in "speed_bucket connectivity driver_workload privacy_mode".split()]
    + [T.StructField("passenger_present", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in "local_model_tier context_prefix capability distraction actuation consequence route reason demand".split()]
    + [T.StructField(c, T.BooleanType()) for c in "context_invariant context_flipped sensitive adversarial".split()]
    + [T.StructField(c, T.StringType()) for c in "split source variant".split()]
    + [T.StructField("is_synthetic", T.BooleanType()), T.StructField("pair_id", T.StringType())]
)

PREDICTION = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("route", T.StringType()), T.StructField("route_probs", T.ArrayType(T.DoubleType())), T.StructField("intent", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)), T.StructField("confidence", T.DoubleType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tag_probs", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ]
)
