"""Stateful sessions as streams: a ledger per key, and event-time windows (an extension)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DECIDED = "session string, request_id string, cost long, running long, status string"


def reservations(stream: DataFrame, limit: int, idle_ms: int = 86_400_000) -> DataFrame:
    """Decide reservations (session, request_id, cost) of a stream against each session's limit.

    State per session: what was granted, what was asked, whether it is blocked, and the requests seen, so a
    replayed request is answered but never counted twice. It goes when the session was idle for ``idle_ms``.
    """

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, blocked, seen = state.get if state.exists else (0, False, [])
        known = set(seen)
        out = []
        for frame in frames:
            for request, cost in zip(frame["request_id"], frame["cost"]):
                if request in known:
                    status = "replayed"
                elif blocked or total + cost > limit:
                    status, blocked = "refused", True
                else:
                    status, total = "granted", total + int(cost)
                known.add(request)
                out.append((key[0], request, int(cost), total, status))
        state.update((total, blocked, sorted(known)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECIDED.split(", ")])

    return stream.groupBy("session").applyInPandasWithState(
        decide, _DECIDED, "total long, blocked boolean, seen array<string>", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(stream: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums of events by sliding window and type, with a watermark for late events."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )


def deduplicated(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessionize(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Sessions of each user in a batch: a gap of more than ``gap_seconds`` begins a new one."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(order)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("new", new.cast("int")).withColumn(
        "session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    return numbered.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )
