"""Upkeep of the models: single records, changes to them, and what they say about themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import fulltext, geosets
from sparkweave.operators import keyvalue as KV
from sparkweave.operators import queue as Q
from sparkweave.operators import tables as DML
from sparkweave.operators import timeseries as T
from sparkweave.plans import search as S
from sparkweave.plans import state as ST
from sparkweave.plans.registry import register
from sparkweave.scratch import scratch
from sparkweave.tables import table

# ---------------------------------------------------------------- key-value


@register("kv_exists", f"SELECT n.key, o.key IS NOT NULL AS found FROM {ST._NEW} n LEFT JOIN {ST._LIVE} o ON n.key = o.key")
def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.exists(ST._kv(spark, sf_dir), ST._new(spark, sf_dir), ST.NOW)


@register("kv_getset", f"SELECT n.key, o.value AS old, n.value AS new FROM {ST._NEW} n LEFT JOIN {ST._LIVE} o ON n.key = o.key")
def kv_getset(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ST._new(spark, sf_dir)
    before, after = KV.get_and_set(ST._kv(spark, sf_dir), new, ST.NOW)
    return before.withColumnRenamed("value", "old").join(after.select("key", F.col("value").alias("new")), "key")


@register("kv_persist", f"SELECT key, value, CASE WHEN key IN (SELECT key FROM {ST._NEW}) THEN 0 ELSE expire_at END::BIGINT AS expire_at FROM {ST._KV}")
def kv_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.expire(ST._kv(spark, sf_dir), ST._new(spark, sf_dir), 0)


@register("kv_expire_time", f"SELECT key, expire_at // 1000 AS at FROM {ST._LIVE} WHERE expire_at > 0")
def kv_expire_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.expire_time(ST._kv(spark, sf_dir), ST.NOW)


@register("kv_decr", f"SELECT coalesce(o.key, d.key) AS key, CASE WHEN d.n IS NOT NULL THEN (coalesce(o.value::BIGINT, 0) - d.n)::VARCHAR ELSE o.value END AS value FROM {ST._LIVE} o FULL JOIN (SELECT 'user:' || o_custkey AS key, 2 * count(*) AS n FROM orders GROUP BY o_custkey) d ON o.key = d.key")
def kv_decr(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "orders").select(F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("key"), F.lit(-2).alias("delta"))
    return KV.increase(ST._kv(spark, sf_dir), deltas, ST.NOW).select("key", "value")


# ---------------------------------------------------------------- queues


@register(
    "queue_describe",
    f"SELECT 'tasks' AS topic, count(*) AS messages, (SELECT count(*) FROM {ST._VISIBLE}) AS visible, count(*) FILTER (NOT (expire_at <> 0 AND expire_at <= {ST.NOW}) AND deliver_at > {ST.NOW}) AS delayed, count(*) FILTER (expire_at <> 0 AND expire_at <= {ST.NOW}) AS expired, max(id) AS last_id FROM {ST._MESSAGES}",
)
def queue_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.describe(ST._messages(spark, sf_dir), ST.NOW)


@register("queue_group_lag", f"SELECT 'tasks' AS topic, c AS consumer, p AS pending, (SELECT count(*) FROM {ST._MESSAGES} WHERE id > a) AS lag FROM (VALUES ('one', 100, 2), ('two', 5, 0)) t(c, a, p)")
def queue_group_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame([("tasks", "one", 100, [101, 103]), ("tasks", "two", 5, [])], "topic string, consumer string, acked long, pending array<bigint>")
    return Q.describe_group(ST._messages(spark, sf_dir), states)


@register("queue_reset", f"SELECT id FROM (SELECT * FROM {ST._VISIBLE} WHERE id > 30 ORDER BY id LIMIT 20) ORDER BY priority, id LIMIT 5")
def queue_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ST._messages(spark, sf_dir)
    return Q.poll(messages, Q.reset(ST._state(spark, 90, 95, [91, 92]), 30), 5, ST.NOW).select("id")


@register("queue_purge", "SELECT 0::BIGINT AS n")
def queue_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.purge(ST._messages(spark, sf_dir), "tasks").agg(F.count(F.lit(1)).alias("n"))


@register("queue_topics", "SELECT 'tasks' AS topic")
def queue_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST._messages(spark, sf_dir).select("topic").distinct()


@register("queue_ttl", "SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 1000 + event_id + 10 ELSE 1000 + event_id + 500 END)::BIGINT AS expire_at FROM events")
def queue_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    published, ttl = F.lit(1000) + F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.lit(10)).otherwise(F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", Q.effective_expiry(published, ttl, 500).alias("expire_at"))


# ---------------------------------------------------------------- time series


@register("ts_all_tag_values", "SELECT DISTINCT 'event_type' AS tag, event_type AS value FROM events UNION ALL SELECT DISTINCT 'user_id', user_id::VARCHAR FROM events")
def ts_all_tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.all_tag_values(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@register("ts_describe", "SELECT event_type, count(*) AS points, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY event_type")
def ts_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.describe(table(spark, sf_dir, "events"), ["event_type"])


# ---------------------------------------------------------------- vectors


@register("vector_get", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id = 17")
def vector_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").where("vec_id = 17").select("vec_id", "label", F.round(total, 5).alias("total"))


@register("vector_upsert", "SELECT CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label, count(*) AS n FROM (SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 100000, label FROM embeddings WHERE vec_id % 7 = 1) GROUP BY 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL puts the added rows beside all that are there, so their keys must be free: 100,000 further on, or past the largest where the keys reach as far as that."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    changed = vectors.where("vec_id % 7 = 0").withColumn("label", F.lit(-1))
    reach = F.coalesce(F.max("vec_id") - F.min("vec_id") + 1, F.lit(0))
    shift = vectors.agg(F.greatest(reach, F.lit(100000)).alias("shift"))
    added = vectors.where("vec_id % 7 = 1").crossJoin(F.broadcast(shift)).select((F.col("vec_id") + F.col("shift")).alias("vec_id"), "embedding", "label")
    fresh = changed.unionByName(added).withColumn("seq", F.lit(1))
    return DML.replace_into(vectors, fresh, "vec_id", "seq").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("vector_delete", "SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 3")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.delete(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 10 == 3).select("vec_id")


# ---------------------------------------------------------------- places


@register("geo_members", f"SELECT member FROM {S._PLACES}")
def geo_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S._places(spark, sf_dir).select("member")


@register("geo_delete", f"SELECT member FROM {S._PLACES} WHERE id % 9 <> 4")
def geo_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = S._places(spark, sf_dir)
    return geosets.remove(places, places.where("id % 9 = 4")).select("member")


@register("geo_search_store", f"SELECT member FROM {S._PLACES} WHERE {S._TO_BERLIN} <= 2000000")
def geo_search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "geo-set")
    geosets.store(geosets.search(S._places(spark, sf_dir), 13.405, 52.52, 2000, "km"), path)
    return spark.read.parquet(path).select("member")


@register("geo_search_box_store", f"SELECT member FROM {S._PLACES} WHERE lng BETWEEN 0 AND 50 AND lat BETWEEN 0 AND 50")
def geo_search_box_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "geo-set")
    geosets.store(geosets.search_box(S._places(spark, sf_dir), 0, 0, 50, 50), path)
    return spark.read.parquet(path).select("member")


# ---------------------------------------------------------------- full text


@register("text_get", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 5")
def text_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 5").select("doc_id", "source", "n_chars")


@register("text_update", "SELECT count(*) AS n FROM documents WHERE doc_id % 100 = 7")
def text_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are replaced are found by their new words and no longer by their old ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 100 = 7").select("doc_id", F.lit("zyzzyva unheard words").alias("text"))
    return S._index(spark, sf_dir).with_documents(new).search("zyzzyva", None).agg(F.count(F.lit(1)).alias("n"))


@register("text_delete", S._INDEX + "SELECT count(DISTINCT doc_id) AS n FROM postings WHERE term = 'license' AND doc_id % 2 = 1")
def text_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    return S._index(spark, sf_dir).without(gone).search("license", None).agg(F.count(F.lit(1)).alias("n"))


@register("text_whitespace", r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '\S+'), lambda x: x NOT IN (" + S._STOPS + r") AND strlen(x) <= 256))::INT AS n FROM documents")
def text_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fulltext.tokens(F.col("text"), "whitespace")).alias("n"))


# ---------------------------------------------------------------- graphs


@register("graph_out_edges", f"SELECT src, dst, weight FROM {S._EDGES} WHERE src = 103")
def graph_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S._edges(spark, sf_dir).where("src = 103")


@register("graph_in_edges", f"SELECT src, dst, weight FROM {S._EDGES} WHERE dst = 103")
def graph_in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S._edges(spark, sf_dir).where("dst = 103")


@register("graph_vertices_by_label", f"SELECT id FROM {S._VERTICES} WHERE label = 'nation'")
def graph_vertices_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S._vertices(spark, sf_dir).where("label = 'nation'").select("id")


@register("graph_edges_by_weight", f"SELECT src, dst FROM {S._EDGES} WHERE weight = 'heavy'")
def graph_edges_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S._edges(spark, sf_dir).where("weight = 'heavy'").select("src", "dst")


@register("graph_update_vertex", f"SELECT id, CASE WHEN id = 102 THEN 'capital' ELSE label END AS label FROM {S._VERTICES}")
def graph_update_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.update(S._vertices(spark, sf_dir), F.col("id") == 102, {"label": F.lit("capital")})


@register("graph_delete_edge", f"SELECT src, dst FROM {S._EDGES} WHERE NOT (src = 1 AND dst % 2 = 0)")
def graph_delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.delete(S._edges(spark, sf_dir), (F.col("src") == 1) & (F.col("dst") % 2 == 0)).select("src", "dst")
