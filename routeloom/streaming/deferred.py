"""Deferred requests that are decided again when the connection returns, on a stream or a table.

A request that is deferred for want of a connection waits for the first later event of its user that has one, at most
``limit``. Then it is decided once more with that event's connectivity; after the limit it stays deferred. The stream
keeps, by user, what waits and the connections not older than that, and settles a request once the watermark has passed
its outcome: late rows inside the watermark change nothing, so stream and table agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from routeloom.operators.decide import route_columns

STATE = "waits array<struct<at:bigint,row:string>>, links array<struct<at:bigint,connectivity:string>>"
#: What a settled request has besides its own columns.
OUTCOME = "connectivity string, settled_at bigint, outcome string"


def _micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _decided(settled: DataFrame) -> DataFrame:
    """The rows with their route under the connection they got."""
    return route_columns(settled)


def first_decision(requests: DataFrame) -> DataFrame:
    """Requests with ``waits``: whether they are deferred for now."""
    routed = route_columns(requests)
    return routed.withColumn("waits", F.col("route") == "DEFER").drop("route", "reason", "demand")


def settled_table(requests: DataFrame, user: str, ts: str, limit: timedelta) -> DataFrame:
    """Each deferred request of a table, decided again: its columns, ``settled_at``, ``outcome`` (returned, expired), route, reason, demand."""
    every = first_decision(requests).withColumn("_at", _micros(ts))
    # from the latest event on, so that the frame is what has been seen: nothing is buffered
    later = Window.partitionBy(user).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    link = F.last(F.when(F.col("connectivity") != "none", F.struct("_at", "connectivity")), ignorenulls=True).over(later)
    most = int(limit.total_seconds() * 1_000_000)
    waiting = every.withColumn("_link", link).where("waits").withColumn("_back", F.coalesce(F.col("_link._at") <= F.col("_at") + most, F.lit(False)))
    settled = waiting.withColumns({
        "connectivity": F.when(F.col("_back"), F.col("_link.connectivity")).otherwise(F.col("connectivity")), "settled_at": F.when(F.col("_back"), F.col("_link._at")).otherwise(F.col("_at") + most),
        "outcome": F.when(F.col("_back"), "returned").otherwise("expired"),
    })
    return _decided(settled.drop("_at", "_link", "_back", "waits"))


def settled_stream(requests: DataFrame, user: str, ts: str, limit: timedelta, *, key: str, late: str = "10 minutes") -> DataFrame:
    """As ``settled_table`` on a stream; rows whose ``key`` repeats within the watermark count once. Append mode."""
    most = int(limit.total_seconds() * 1_000_000)
    once = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    own = [f for f in once.schema.fields if f.name != "connectivity"]
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    asked = first_decision(once).select(ts, user, "connectivity", "waits", _micros(ts).alias("_at"), F.to_json(F.struct(*[f.name for f in own])).alias("_row"))

    def settle(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits, links = (list(map(tuple, x)) for x in (state.get if state.exists else ([], [])))
        for b in batches if not state.hasTimedOut else ():
            waits += [(int(a), r) for a, r in b.loc[b["waits"], ["_at", "_row"]].itertuples(index=False)]
            links += [(int(a), c) for a, c in b.loc[b["connectivity"] != "none", ["_at", "connectivity"]].itertuples(index=False)]
        mark = state.getCurrentWatermarkMs() * 1000
        links.sort()
        out, still, due = [], [], []
        for at, row in waits:
            back = next((x for x in links if x[0] > at), None)
            back = back if back and back[0] <= at + most else None
            when = back[0] if back else at + most
            if when < mark:
                out.append((row, back[1] if back else "none", when, "returned" if back else "expired"))
            else:
                still.append((at, row))
                due.append(when)
        # a request to come is not older than the watermark, so it needs no link before that
        oldest = min([mark, *[a for a, _ in still]])
        links = [x for x in links if x[0] >= oldest]
        if still or links:
            state.update((still, links))
            state.setTimeoutTimestamp(max(min(due, default=links[-1][0] if links else 0), mark) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["_row", "connectivity", "settled_at", "outcome"])

    kept = asked.groupBy(user).applyInPandasWithState(settle, f"_row string, {OUTCOME}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _decided(kept.withColumn("_r", F.from_json("_row", plain)).select("_r.*", "connectivity", "settled_at", "outcome"))
