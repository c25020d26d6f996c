"""Stateful and windowed stream operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.registry import admit


def limit_requests(requests: DataFrame, limit: int = 120, seconds: float = 60.0) -> DataFrame:
    """Requests (key, ts) with ``allowed``: the greedy limiter with each key's accepted times as state. A
    key's state goes when nothing came for twice the window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        times = (rows.ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()
        ok, accepted = admit(times, accepted, limit, seconds)
        state.update((accepted,))
        state.setTimeoutDuration(int(2000 * seconds))
        yield pd.DataFrame({"key": key[0], "ts": rows.ts.to_numpy(), "allowed": ok})

    return requests.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums of events (ts, value) by window; rows later than ``late`` are dropped in a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("since"), by, "n", "total")


def distinct_uploads(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (source, uid) once within the watermark: an idempotent insert."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "uid"])
