"""Sessions, versions of documents, caches of tools, steps and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import agents as A
from sparkweave.operators import sessions
from sparkweave.plans.registry import register
from sparkweave.tables import table

NOW = 1_000_000


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions, some archived and some expired."""
    key = F.col("conv_id")
    each = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return each.select(
        key.alias("id"),
        F.create_map(F.lit("team"), F.concat(F.lit("t"), (key % 4).cast("string"))).alias("metadata"),
        F.array(F.concat(F.lit("g"), (key % 3).cast("string"))).alias("tags"),
        (key % 5 == 0).alias("archived"),
        F.when(key % 7 == 0, F.lit(NOW) - key).otherwise(0).cast("long").alias("expire_at"),
    )


_SESSIONS = f"(SELECT DISTINCT conv_id AS id, 't' || (conv_id % 4) AS team, 'g' || (conv_id % 3) AS tag, conv_id % 5 = 0 AS archived, CASE WHEN conv_id % 7 = 0 THEN {NOW} - conv_id ELSE 0 END AS expire_at FROM conversations)"
_LIVE = f"(SELECT * FROM {_SESSIONS} WHERE expire_at = 0 OR expire_at > {NOW})"


@register("session_list", f"SELECT id FROM {_LIVE} WHERE NOT archived")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active(_sessions(spark, sf_dir), NOW).select("id")


@register("session_create", f"SELECT id, team FROM {_LIVE} UNION ALL SELECT id, 'new' FROM {_SESSIONS} WHERE NOT (expire_at = 0 OR expire_at > {NOW}) UNION ALL SELECT id + 1000000, 'new' FROM {_SESSIONS}")
def session_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _sessions(spark, sf_dir)
    new = held.select(F.explode(F.array(F.col("id"), F.col("id") + 1_000_000)).alias("id"), F.create_map(F.lit("team"), F.lit("new")).alias("metadata"), F.lit(0).cast("long").alias("expire_at"))
    return A.create(held, new, NOW).select("id", F.col("metadata")["team"].alias("team"))


@register("session_tags", f"SELECT id FROM {_LIVE} WHERE NOT archived AND (tag = 'g1' AND id % 2 = 0 OR id % 2 = 1)")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _sessions(spark, sf_dir)
    odd = held.where("id % 2 = 1").select("id")
    return A.with_tag(A.add_tags(A.remove_tags(held, odd, ["g1"]), odd, ["g1", "odd"]), "g1", NOW).select("id")


@register("session_metadata", f"SELECT id FROM {_LIVE} WHERE NOT archived AND (team = 't2' OR id % 10 = 1)")
def session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _sessions(spark, sf_dir)
    return A.with_metadata(A.update_metadata(held, held.where("id % 10 = 1"), {"team": "t2", "note": "moved"}), "team", "t2", NOW).select("id")


@register("session_archive", f"SELECT id FROM {_LIVE} WHERE archived OR id % 3 = 0")
def session_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _sessions(spark, sf_dir)
    return A.archived(A.set_archived(held, held.where("id % 3 = 0")), NOW).select("id")


@register("session_clean_up", f"SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id IN (SELECT id FROM {_LIVE}) GROUP BY conv_id")
def session_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, messages = A.clean_up(_sessions(spark, sf_dir), NOW, (table(spark, sf_dir, "conversations"), "conv_id"))
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


@register("session_export", "SELECT conv_id AS id, count(*) AS messages, arg_min(role, turn) AS first_role, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY conv_id")
def session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = A.export(_sessions(spark, sf_dir), table(spark, sf_dir, "conversations"))
    messages = F.from_json(F.get_json_object("document", "$.messages"), "array<struct<turn:int,role:string,text:string>>")
    read = exported.select("id", messages.alias("m"))
    size = F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.char_length(x["text"]), F.lit(0)))
    return read.select("id", F.size("m").cast("long").alias("messages"), F.get("m", F.lit(0))["role"].alias("first_role"), size.alias("characters"))


_EVEN = "doc_id % 2 = 0"


@register("document_versions", f"SELECT doc_id, (CASE WHEN {_EVEN} THEN 2 ELSE 1 END)::BIGINT AS version, length(text) + CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS n FROM documents")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = docs.where(F.lit(False)).select("doc_id", F.lit(1).cast("long").alias("version"), "text")
    once = A.store_version(none, docs)
    twice = A.store_version(once, docs.where(_EVEN).withColumn("text", F.concat("text", F.lit("!"))))
    return A.at_version(twice).select("doc_id", "version", F.char_length("text").cast("long").alias("n"))


@register("document_at_version", "SELECT doc_id, 1::BIGINT AS version, length(text) AS n FROM documents")
def document_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    versions = A.store_version(docs.select("doc_id", F.lit(1).cast("long").alias("version"), "text"), docs.where(_EVEN))
    return A.at_version(versions, 1).select("doc_id", "version", F.char_length("text").cast("long").alias("n"))


_PIECES = "(SELECT doc_id, c AS chunk, substr(text, c * 800 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT))::INT AS c FROM documents WHERE length(text) > 0))"


@register("document_statistics", f"SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, sum(strlen(piece))::BIGINT AS bytes FROM {_PIECES}")
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return A.document_statistics(docs, sessions.text_chunks(docs, 1000, 200))


@register("chunk_search", f"SELECT doc_id, chunk, ((length(piece) - length(replace(lower(piece), 'license', ''))) / 7)::BIGINT AS hits FROM {_PIECES} WHERE contains(lower(piece), 'license') ORDER BY hits DESC, doc_id, chunk LIMIT 20")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pieces_with(sessions.text_chunks(table(spark, sf_dir, "documents"), 1000, 200), "License", 20)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of tools: each user's events of a kind are calls with the same input."""
    expire = F.when(F.col("event_id") % 4 == 0, F.lit(NOW) - 1).otherwise(0).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("input"), F.col("event_id").alias("result"), expire.alias("expire_at"), F.col("event_id").alias("seq"))


@register("tool_cache", f"SELECT event_type AS tool, user_id AS input, CASE WHEN max(event_id) % 4 <> 0 AND event_type <> 'click' THEN max(event_id) END AS result FROM events GROUP BY event_type, user_id")
def tool_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    cache = A.invalidate(A.remember_results(results.where(F.lit(False)).drop("seq"), results), "click")
    return A.cached(cache, results.select("tool", "input").distinct(), NOW)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.unix_millis("ts").alias("at"))


@register("agent_state", "SELECT user_id AS agent, arg_max(event_id, (ts, event_id)) AS step, arg_max(event_type, (ts, event_id)) AS state, count(*) AS steps FROM events GROUP BY user_id")
def agent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_step(_steps(spark, sf_dir)).select("agent", "step", "state", "steps")


_MIDDLE = "(SELECT user_id, event_id, ts FROM events WHERE event_id = 50)"


@register("agent_rollback", f"SELECT count(*) AS n FROM events e, {_MIDDLE} m WHERE e.user_id <> m.user_id OR (e.ts, e.event_id) <= (m.ts, m.event_id)")
def agent_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    agent = table(spark, sf_dir, "events").where("event_id = 50").select("user_id").first()[0]  # the agent that a caller names
    return A.rollback(steps, agent, 50).agg(F.count(F.lit(1)).alias("n"))


@register("trace_report", "SELECT user_id AS run, count(*) AS operations, count(*) FILTER (event_type = 'error' OR event_id % 6 = 0) AS failed, sum(event_id % 50)::BIGINT AS busy, (max(epoch_us(ts) // 1000 + event_id % 50) - min(epoch_us(ts) // 1000))::BIGINT AS elapsed FROM events GROUP BY user_id")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when((F.col("event_type") == "error") | (F.col("event_id") % 6 == 0), F.lit("failed"))
    records = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.unix_millis("ts").alias("at"), F.col("event_type").alias("operation"), (F.col("event_id") % 50).alias("duration"), failed.alias("error"))
    return A.traces(records)
