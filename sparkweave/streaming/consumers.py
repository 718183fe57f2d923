"""Consumption of queue messages from a stream, and keeping the last value of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweave.operators.queue import visible


def consume(messages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, now: int, priorities: bool = True) -> StreamingQuery:
    """Gives each batch of messages that are visible, the urgent first, to a handler. What a batch holds is confirmed by the stream's checkpoint when the handler returns: after a
    failure the same batch comes again under the same number, so a handler that writes by batch number takes every message once."""

    def batch(rows: DataFrame, number: int) -> None:
        ready = rows.where(visible(now))
        handle(ready.orderBy("priority", "id") if priorities else ready.orderBy("id"), number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_values(writes: DataFrame, key: str = "key", sequence: str = "seq") -> DataFrame:
    """The last value of each key of a stream of writes, for output mode complete or update."""
    return writes.groupBy(key).agg(F.max_by("value", sequence).alias("value"))
