"""Windows over streams. Each has the meaning of the same window over a table; a watermark bounds how long state waits for late points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkweave.operators.timeseries import measure


def tumbling(points: DataFrame, width: str, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Windows from multiples of ``width``, such as "1 hour"."""
    return sliding(points, width, width, value, measures, by, ts, late)


def sliding(points: DataFrame, width: str, step: str, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    window = F.window(ts, width, step) if step != width else F.window(ts, width)
    grouped = points.withWatermark(ts, late).groupBy(*by, window.alias("w"))
    aggregated = grouped.agg(*[measure(m, F.col(value), F.col(ts)).alias(m) for m in measures])
    return aggregated.select(*by, F.unix_millis(F.col("w.start")).alias("bucket"), *measures).where("bucket >= 0")


def session(points: DataFrame, gap: str, value: str, measures: Sequence[str], by: Sequence[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end when over ``gap`` passes without a point."""
    numbers = points.where(F.col(value).try_cast("double").isNotNull()).withWatermark(ts, late)
    grouped = numbers.groupBy(*by, F.session_window(ts, gap).alias("w"))
    aggregated = grouped.agg(*[measure(m, F.col(value), F.col(ts)).alias(m) for m in measures])
    return aggregated.select(*by, F.unix_millis(F.col("w.start")).alias("bucket"), *measures)


def state_runs(points: DataFrame, key: str, field: str, value: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of equal states of each key: (key, state, bucket, count, sum). A run is given out when the next one begins, or once the watermark passes its last point.

    A key's open run is its state, so memory is one row for each key, and points of a batch are taken in order of time.
    """
    rows = points.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(field).cast("string"), F.lit("")).alias("field"), F.col(value).try_cast("double").alias("value"), F.col(ts).alias("ts"))
    rows = rows.where("value IS NOT NULL")

    def advance(keys: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        closed: list[tuple[str, str, int, int, float]] = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(keys[0], *run)], columns=["key", "state", "bucket", "count", "sum"])
            return
        last = 0
        every = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for name, number, at in zip(every["field"], every["value"], every["ts"], strict=True):
            ms = int(at.value // 1_000_000)
            last = max(last, ms)
            if run is not None and run[0] == name:
                run[2] += 1
                run[3] += float(number)
            else:
                if run is not None:
                    closed.append((keys[0], *run))
                run = [name, ms, 1, float(number)]
        state.update(tuple(run))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(closed, columns=["key", "state", "bucket", "count", "sum"])

    return rows.groupBy("key").applyInPandasWithState(advance, "key string, state string, bucket long, count long, sum double", "state string, bucket long, count long, sum double", "append", GroupStateTimeout.EventTimeTimeout)
