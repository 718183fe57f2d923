"""Message queues as tables: messages, and what each consumer of a group has taken and confirmed.

A message has id, priority (0 first), key, payload, deliver_at and expire_at (milliseconds; 0 for none), retries. A consumer's state is one row:
acked (all up to here are done), max_acked, and pending (identifiers that are out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators.tables import number_rows

STATE = "acked long, max_acked long, pending array<bigint>"


def publish(messages: DataFrame, new: DataFrame, by: str = "seq") -> DataFrame:
    """New messages get the numbers after the largest; ``by`` is their order."""
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    numbered = number_rows(new, [by], name="id").crossJoin(F.broadcast(last)).withColumn("id", F.col("id") + F.col("__last"))
    return messages.unionByName(numbered.select(*messages.columns))


def trim(messages: DataFrame, max_len: int) -> DataFrame:
    """The newest ``max_len`` messages of each topic; 0 keeps all."""
    if not max_len:
        return messages
    newest = Window.partitionBy("topic").orderBy(F.col("id").desc())
    return messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max_len).drop("__n")


def visible(now: int) -> Column:
    """Delivery is due and the time to live not over."""
    return ((F.col("expire_at") == 0) | (F.col("expire_at") > now)) & ((F.col("deliver_at") == 0) | (F.col("deliver_at") <= now))


def initial_state(messages: DataFrame) -> DataFrame:
    return messages.sparkSession.createDataFrame([(0, 0, [])], STATE)


def poll(messages: DataFrame, state: DataFrame, count: int, now: int, key: str | None = None) -> DataFrame:
    """The messages that a consumer gets: of the first 4 * count (10 * count with a key) that it may have, by number, the most urgent ones."""
    open_ = messages.where(visible(now)).crossJoin(F.broadcast(state)).where((F.col("id") > F.col("acked")) & ~F.array_contains("pending", F.col("id")))
    if key is not None:
        first = open_.orderBy("id").limit(10 * count).where(F.col("key") == key)
        return first.orderBy("id").limit(count).drop("acked", "max_acked", "pending")
    return open_.orderBy("id").limit(4 * count).orderBy("priority", "id").limit(count).drop("acked", "max_acked", "pending")


def after_poll(state: DataFrame, polled: DataFrame) -> DataFrame:
    out = polled.agg(F.collect_list("id").alias("__out"))
    return state.crossJoin(out).select("acked", "max_acked", F.array_sort(F.array_distinct(F.concat("pending", "__out"))).alias("pending"))


def ack(state: DataFrame, done: int) -> DataFrame:
    """Confirms one message, in any order: everything below the smallest that is still out is done."""
    rest = state.select("acked", F.greatest("max_acked", F.lit(done)).alias("max_acked"), F.array_remove("pending", done).alias("pending"))
    low = F.when(F.size("pending") == 0, F.col("max_acked")).otherwise(F.greatest("acked", F.array_min("pending") - 1))
    return rest.select(low.alias("acked"), "max_acked", "pending")


def nack(messages: DataFrame, state: DataFrame, refused: int, requeue: bool = True, max_retries: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, dead letters, state) after a consumer refuses a message: it comes again under the same number, or, at the last retry or if not to be
    queued again, goes to the dead letters without delay and time to live."""
    again = (F.col("id") == refused) & F.lit(requeue) & (F.col("retries") + 1 < max_retries)
    dead = (F.col("id") == refused) & ~again
    kept = messages.where(~dead).withColumn("retries", F.when(again, F.col("retries") + 1).otherwise(F.col("retries")))
    letters = messages.where(dead).withColumns({"deliver_at": F.lit(0).cast("long"), "expire_at": F.lit(0).cast("long"), "retries": F.col("retries") + 1})
    return kept, letters, state.withColumn("pending", F.array_remove("pending", refused))


def describe(messages: DataFrame, now: int) -> DataFrame:
    """Per topic: messages, those visible now, those still delayed, those expired, and the largest number."""
    expired = (F.col("expire_at") != 0) & (F.col("expire_at") <= now)
    delayed = ~expired & (F.col("deliver_at") > now)
    return messages.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(visible(now)).alias("visible"), F.count_if(delayed).alias("delayed"), F.count_if(expired).alias("expired"), F.max("id").alias("last_id")
    )


def describe_group(messages: DataFrame, states: DataFrame, width: int = 10_000) -> DataFrame:
    """Per consumer (topic, consumer, acked, pending): how many messages are out, and how many lie after the last confirmed one.

    Messages are counted by topic and stretches of ``width`` numbers first, so a consumer meets counts, and single messages only in the stretch that its position lies in.
    """
    stretch = F.floor(F.col("id") / width).cast("long")
    counts = messages.groupBy("topic", stretch.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    at = states.select("topic", "consumer", "acked", F.size("pending").alias("pending"), F.floor(F.col("acked") / width).cast("long").alias("__at"))
    later = at.join(counts, (at["topic"] == counts["topic"]) & (counts["__s"] > F.col("__at"))).groupBy(at["topic"], "consumer").agg(F.sum("__n").alias("__later"))
    inside = at.join(messages.select(F.col("topic").alias("__t"), "id", stretch.alias("__s")), (F.col("topic") == F.col("__t")) & (F.col("__s") == F.col("__at")) & (F.col("id") > F.col("acked")))
    near = inside.groupBy("topic", "consumer").agg(F.count(F.lit(1)).alias("__near"))
    lag = F.coalesce("__later", F.lit(0)) + F.coalesce("__near", F.lit(0))
    return at.join(later, ["topic", "consumer"], "left").join(near, ["topic", "consumer"], "left").select("topic", "consumer", "pending", lag.alias("lag"))


def reset(state: DataFrame, offset: int) -> DataFrame:
    """Begins again after a message; what is out is forgotten."""
    return state.select(F.lit(offset).cast("long").alias("acked"), F.lit(offset).cast("long").alias("max_acked"), F.array().cast("array<bigint>").alias("pending"))


def purge(messages: DataFrame, topic: str) -> DataFrame:
    return messages.where(F.col("topic") != topic)


def effective_expiry(published: Column, ttl: Column, topic_ttl: int = 0) -> Column:
    """When a message goes: by its own time to live, else by its topic's; 0 for never."""
    own = F.when(ttl > 0, published + ttl)
    return F.coalesce(own, F.when(F.lit(topic_ttl) > 0, published + topic_ttl), F.lit(0)).cast("long")
