"""Conversations: recent messages, windows that fit a budget of tokens, and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparkweave.functions.vectors import MISMATCH
from sparkweave.operators.nearest import nearest, within


def _newest() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy(F.col("turn").desc())


def token_count(text: Column) -> Column:
    """Words, as a stand-in for a model's tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def recent(messages: DataFrame, count: int) -> DataFrame:
    """The last messages of each conversation."""
    return messages.withColumn("__n", F.row_number().over(_newest())).where(F.col("__n") <= count).drop("__n")


def context_window(messages: DataFrame, max_tokens: int, prompt_tokens: int = 0, summary_tokens: int = 0) -> DataFrame:
    """The newest messages that fit what the prompt and the summary leave of the budget: the longest run at the end."""
    budget = max(0, max_tokens - prompt_tokens - summary_tokens)
    counted = messages.withColumn("tokens", token_count(F.col("text")))
    running = F.sum("tokens").over(_newest().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("used_tokens", running).where(F.col("used_tokens") <= budget)


def compact(messages: DataFrame, keep_recent: int) -> DataFrame:
    """One row per conversation for what is to be summed up, beside the messages that stay: how many, and how many tokens."""
    marked = messages.withColumn("__old", F.row_number().over(_newest()) > keep_recent).withColumn("tokens", token_count(F.col("text")))
    return marked.groupBy("conv_id").agg(
        F.count_if("__old").alias("compacted"),
        F.coalesce(F.sum(F.when(F.col("__old"), F.col("tokens"))), F.lit(0)).alias("compacted_tokens"),
        F.count_if(~F.col("__old")).alias("kept"),
    )


def statistics(messages: DataFrame) -> DataFrame:
    tokens = token_count(F.col("text"))
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(tokens).alias("tokens"), F.count_if(F.col("role") == "user").alias("user_messages"), F.max("turn").alias("last_turn")
    )


def text_chunks(docs: DataFrame, size: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """Pieces of whole texts for retrieval: ``size`` characters, each beginning ``size - overlap`` after the one before."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be less than size")
    n = F.char_length("text")
    count = F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1)).cast("int")
    each = docs.where(n > 0).select(key, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return each.select(key, "chunk", F.substring("text", F.col("chunk") * step + 1, F.lit(size)).alias("piece"))


def remember(memories: DataFrame, column: str, query: Sequence[float], k: int, now: int, where: Column | None = None, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """The k nearest memories that have not expired (expire_at in milliseconds, 0 for never) and pass a filter."""
    live = (F.col("expire_at") == 0) | (F.col("expire_at") > now)
    return nearest(memories, column, query, k, metric, where=live if where is None else live & where, key=key)


def duplicates_of(memories: DataFrame, column: str, queries: DataFrame, threshold: float, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """(query_id, key, distance): memories at most ``threshold`` from each of a stated set of memories, itself not among them. All pairs are looked at."""
    found = within(memories, column, queries, threshold, metric, key).where(F.col(key) != F.col("query_id")).select("query_id", key, "distance")
    if threshold < MISMATCH:
        return found
    # So far that vectors of another length, or none, count too.
    sides = memories.select(F.col(key), F.size(column).alias("__v")), queries.select("query_id", F.size("query").alias("__q"))
    other = (F.col(key) != F.col("query_id")) & ~F.coalesce(F.col("__v") == F.col("__q"), F.lit(False))
    return found.unionByName(sides[0].join(F.broadcast(sides[1]), other).select("query_id", key, F.lit(MISMATCH).alias("distance")))


def performance(steps: DataFrame, name: str, duration: str) -> DataFrame:
    """Per kind of step: runs, mean, median, 95th percentile and longest duration."""
    d = F.col(duration)
    return steps.groupBy(name).agg(F.count(d).alias("runs"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("longest"))
