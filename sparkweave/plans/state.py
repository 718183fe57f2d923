"""Tables that change: key-value, queues, rows by INSERT, UPDATE and DELETE, conversations, imports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import keyvalue as KV
from sparkweave.operators import queue as Q
from sparkweave.operators import sessions
from sparkweave.operators import tables as DML
from sparkweave.plans.registry import register
from sparkweave.scratch import scratch
from sparkweave.sources import files
from sparkweave.tables import table

# ---------------------------------------------------------------- key-value

NOW = 1_000_000


def _kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys: a value each, and for a third a time at which it goes, for some in the past."""
    key = F.col("c_custkey")
    expire = F.when(key % 3 == 0, F.when(key % 2 == 0, F.lit(NOW + 5000) + key).otherwise(F.lit(NOW) - key)).otherwise(F.lit(0))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), key.cast("string")).alias("key"), F.col("c_nationkey").cast("string").alias("value"), expire.cast("long").alias("expire_at"))


_KV = f"(SELECT 'user:' || c_custkey AS key, c_nationkey::VARCHAR AS value, (CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN {NOW} + 5000 + c_custkey ELSE {NOW} - c_custkey END ELSE 0 END)::BIGINT AS expire_at FROM customer)"
_LIVE = f"(SELECT * FROM {_KV} WHERE expire_at = 0 OR expire_at > {NOW})"


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("user:"), (key * 20).cast("string")).alias("key"), F.concat(F.lit("s"), key.cast("string")).alias("value"), F.lit(0).cast("long").alias("expire_at"))


_NEW = "(SELECT 'user:' || (s_suppkey * 20) AS key, 's' || s_suppkey AS value, 0::BIGINT AS expire_at FROM supplier)"


@register("kv_set", f"SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value, coalesce(n.expire_at, o.expire_at) AS expire_at FROM {_KV} o FULL JOIN {_NEW} n ON o.key = n.key")
def kv_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.put(_kv(spark, sf_dir), _new(spark, sf_dir))


@register("kv_setnx", f"SELECT coalesce(o.key, n.key) AS key, coalesce(o.value, n.value) AS value, coalesce(o.expire_at, n.expire_at) AS expire_at FROM {_LIVE} o FULL JOIN {_NEW} n ON o.key = n.key")
def kv_setnx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.put_new(_kv(spark, sf_dir), _new(spark, sf_dir), NOW)


@register("kv_log", "SELECT 'u' || user_id AS key, arg_max(value, event_id)::VARCHAR AS value, 0::BIGINT AS expire_at FROM (SELECT user_id, event_id, event_type AS value FROM events) GROUP BY user_id")
def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.lit(0).cast("long").alias("expire_at"), F.col("event_id").alias("seq"))
    return KV.last_of(log)


@register("kv_get", f"SELECT n.key, o.value FROM {_NEW} n LEFT JOIN {_LIVE} o ON n.key = o.key")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.get(_kv(spark, sf_dir), _new(spark, sf_dir), NOW)


@register("kv_delete", f"SELECT * FROM {_KV} WHERE key NOT IN (SELECT key FROM {_NEW})")
def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.delete(_kv(spark, sf_dir), _new(spark, sf_dir))


@register("kv_delete_prefix", f"SELECT * FROM {_KV} WHERE NOT starts_with(key, 'user:1')")
def kv_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.delete_prefix(_kv(spark, sf_dir), "user:1")


@register("kv_expire", f"SELECT key, value, CASE WHEN key IN (SELECT key FROM {_NEW}) THEN 1235000 ELSE expire_at END::BIGINT AS expire_at FROM {_KV}")
def kv_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.expire(_kv(spark, sf_dir), _new(spark, sf_dir), 1_234_567)


@register("kv_ttl", f"SELECT key, CASE WHEN expire_at = 0 THEN -1 ELSE ceil((expire_at - {NOW}) / 1000.0) END::BIGINT AS ttl FROM {_LIVE}")
def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.ttl(_kv(spark, sf_dir), NOW)


@register(
    "kv_incr",
    f"SELECT coalesce(o.key, d.key) AS key, CASE WHEN d.n IS NOT NULL THEN (coalesce(o.value::BIGINT, 0) + d.n)::VARCHAR ELSE o.value END AS value, CASE WHEN d.n IS NOT NULL THEN 0 ELSE o.expire_at END AS expire_at "
    f"FROM {_LIVE} o FULL JOIN (SELECT 'user:' || o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey) d ON o.key = d.key",
)
def kv_incr(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "orders").select(F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("key"), F.lit(1).alias("delta"))
    return KV.increase(_kv(spark, sf_dir), deltas, NOW)


@register("kv_incr_saturates", "SELECT 'a' AS key, '9223372036854775807' AS value, 0::BIGINT AS expire_at UNION ALL SELECT 'b', '-9223372036854775808', 0")
def kv_incr_saturates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = spark.createDataFrame([("a", "9223372036854775800", 0), ("b", "-9223372036854775800", 0)], "key string, value string, expire_at long")
    return KV.increase(kv, spark.createDataFrame([("a", 100), ("b", -100)], "key string, delta long"), NOW)


@register("kv_incrbyfloat", f"SELECT key, round(value::DOUBLE + CASE WHEN key IN (SELECT key FROM {_NEW}) THEN 0.5 ELSE 0 END, 3) AS value FROM {_LIVE}")
def kv_incrbyfloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = KV.live(_kv(spark, sf_dir), NOW)
    deltas = kv.join(_new(spark, sf_dir).select("key"), "key", "left_semi").select("key", F.lit(0.5).alias("delta"))
    return KV.increase_float(kv, deltas, NOW).select("key", F.round(F.col("value").cast("double"), 3).alias("value"))


@register("kv_append", f"SELECT coalesce(o.key, n.key) AS key, coalesce(o.value, '') || coalesce(n.value, '') AS value, coalesce(o.expire_at, 0) AS expire_at FROM {_LIVE} o FULL JOIN {_NEW} n ON o.key = n.key")
def kv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.append(_kv(spark, sf_dir), _new(spark, sf_dir).withColumnRenamed("value", "part"), NOW)


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in which every key stands as often as a customer has orders, with expired keys among them."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("key"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("value"), F.lit(0).cast("long").alias("expire_at"), F.col("o_orderkey").alias("seq"))


_TWICE = "(SELECT 'user:' || o_custkey AS key, 'o' || o_orderkey AS value, 0::BIGINT AS expire_at, o_orderkey AS seq FROM orders)"
_FOLDED = f"(SELECT key, arg_max(value, seq) AS last, arg_min(value, seq) AS first, string_agg(value, '' ORDER BY seq) AS every FROM {_TWICE} GROUP BY key)"


@register("kv_mset_repeated", f"SELECT coalesce(n.key, o.key) AS key, coalesce(n.last, o.value) AS value, CASE WHEN n.key IS NULL THEN o.expire_at ELSE 0 END AS expire_at FROM {_KV} o FULL JOIN {_FOLDED} n ON o.key = n.key")
def kv_mset_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.put(_kv(spark, sf_dir), _twice(spark, sf_dir))


@register("kv_setnx_repeated", f"SELECT coalesce(o.key, n.key) AS key, coalesce(o.value, n.first) AS value FROM {_LIVE} o FULL JOIN {_FOLDED} n ON o.key = n.key")
def kv_setnx_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.put_new(_kv(spark, sf_dir), _twice(spark, sf_dir), NOW).select("key", "value")


@register("kv_append_repeated", f"SELECT coalesce(o.key, n.key) AS key, coalesce(o.value, '') || coalesce(n.every, '') AS value FROM {_LIVE} o FULL JOIN {_FOLDED} n ON o.key = n.key")
def kv_append_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.append(_kv(spark, sf_dir), _twice(spark, sf_dir).withColumnRenamed("value", "part"), NOW).select("key", "value")


@register("kv_getset_repeated", f"SELECT n.key, CASE WHEN lag(n.value) OVER w IS NULL THEN o.value ELSE lag(n.value) OVER w END AS value FROM {_TWICE} n LEFT JOIN {_LIVE} o ON n.key = o.key WINDOW w AS (PARTITION BY n.key ORDER BY n.seq)")
def kv_getset_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = KV.get_and_set(_kv(spark, sf_dir), _twice(spark, sf_dir), NOW)
    return found


@register("kv_random_key", f"SELECT min(key) AS key FROM {_LIVE}")
def kv_random_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.random_key(_kv(spark, sf_dir), NOW)


@register(
    "kv_ranges",
    "SELECT c_custkey, length(c_name)::INT AS strlen, substr(c_name, 3, 4) AS middle, right(c_name, 3) AS tail, '' AS none, left(c_name, 2) || 'XY' || substr(c_name, 5) AS written, 'ab' || chr(1) || 'Z' AS padded FROM customer",
)
def kv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.char_length(name).alias("strlen"),
        KV.get_range(name, 2, 5).alias("middle"),
        KV.get_range(name, -3, -1).alias("tail"),
        KV.get_range(name, 5, 2).alias("none"),
        KV.set_range(name, 2, "XY").alias("written"),
        F.translate(KV.set_range(F.lit("ab"), 3, "Z"), "\0", "\1").alias("padded"),
    )


@register("kv_rename", f"SELECT CASE WHEN key = 'user:5' THEN 'user:7' ELSE key END AS key, value, expire_at FROM {_KV} WHERE key <> 'user:7'")
def kv_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.rename(_kv(spark, sf_dir), "user:5", "user:7", NOW)


@register("kv_prefix_scan", f"SELECT key, value FROM {_LIVE} WHERE starts_with(key, 'user:12') ORDER BY key LIMIT 5 OFFSET 2")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.prefix_scan(_kv(spark, sf_dir), "user:12", NOW, 5, 2).select("key", "value")


@register("kv_glob_scan", f"SELECT key FROM {_LIVE} WHERE key GLOB 'user:1?*5'")
def kv_glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.glob_scan(_kv(spark, sf_dir), "user:1?*5", NOW).select("key")


@register("kv_types", "SELECT 'string' AS a, 'bytes' AS b, 'none' AS c")
def kv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1)
    return one.select(KV.key_type(F.lit("text")).alias("a"), KV.key_type(F.unhex(F.lit("FF")).cast("string")).alias("b"), KV.key_type(F.lit(None).cast("string")).alias("c"))


@register("kv_count", f"SELECT count(*) AS n, min(key) AS first_key FROM {_LIVE}")
def kv_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KV.live(_kv(spark, sf_dir), NOW).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


# ---------------------------------------------------------------- queues


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a topic: numbered from 1, with priorities, some delayed, some with a time to live."""
    key = F.col("event_id")
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "events").select(
        F.lit("tasks").alias("topic"),
        (key + 1).alias("id"),
        (key * 7 % 10).cast("int").alias("priority"),
        F.concat(F.lit("k"), (key % 3).cast("string")).alias("key"),
        F.col("event_type").alias("payload"),
        F.when(key % 5 == 0, NOW + key).otherwise(zero).alias("deliver_at"),
        F.when(key % 7 == 0, NOW - key + 50).otherwise(zero).alias("expire_at"),
        F.lit(0).alias("retries"),
    )


_MESSAGES = f"""(SELECT event_id + 1 AS id, (event_id * 7 % 10)::INT AS priority, 'k' || (event_id % 3) AS key, event_type AS payload,
  CASE WHEN event_id % 5 = 0 THEN {NOW} + event_id ELSE 0 END AS deliver_at, CASE WHEN event_id % 7 = 0 THEN {NOW} - event_id + 50 ELSE 0 END AS expire_at FROM events)"""
_VISIBLE = f"(SELECT * FROM {_MESSAGES} WHERE (expire_at = 0 OR expire_at > {NOW}) AND (deliver_at = 0 OR deliver_at <= {NOW}))"


def _state(spark: SparkSession, acked: int, top: int, pending: list[int]) -> DataFrame:
    return spark.createDataFrame([(acked, top, pending)], Q.STATE)


@register("queue_poll", f"SELECT id, priority FROM (SELECT * FROM {_VISIBLE} WHERE id > 10 AND id NOT IN (12, 14) ORDER BY id LIMIT 40) ORDER BY priority, id LIMIT 10")
def queue_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.poll(_messages(spark, sf_dir), _state(spark, 10, 10, [12, 14]), 10, NOW).select("id", "priority")


@register("queue_poll_key", f"SELECT id FROM (SELECT * FROM {_VISIBLE} ORDER BY id LIMIT 50) WHERE key = 'k1' ORDER BY id LIMIT 5")
def queue_poll_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.poll(_messages(spark, sf_dir), Q.initial_state(_messages(spark, sf_dir)), 5, NOW, "k1").select("id")


@register(
    "queue_poll_then_ack",
    f"""WITH got AS (SELECT id FROM (SELECT * FROM {_VISIBLE} ORDER BY id LIMIT 16) ORDER BY priority, id LIMIT 4)
    SELECT greatest(0, (SELECT min(id) FROM got WHERE id <> (SELECT max(id) FROM got)) - 1) AS acked, (SELECT max(id) FROM got) AS max_acked, (SELECT count(*) - 1 FROM got)::INT AS pending""",
)
def queue_poll_then_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    state = Q.initial_state(messages)
    polled = Q.poll(messages, state, 4, NOW)
    out = Q.after_poll(state, polled)
    last = polled.agg(F.max("id")).first()[0]  # what a consumer holds in its hand
    return Q.ack(out, last).select("acked", "max_acked", F.size("pending").alias("pending"))


@register("queue_ack", "SELECT 8::BIGINT AS acked, 12::BIGINT AS max_acked, '9,11' AS pending UNION ALL SELECT 12, 12, ''")
def queue_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = Q.ack(_state(spark, 5, 7, [9, 11, 12]), 12)
    rest = Q.ack(Q.ack(one, 9), 11)
    both = one.unionAll(rest)
    return both.select("acked", "max_acked", F.array_join(F.col("pending").cast("array<string>"), ",").alias("pending"))


@register("queue_nack_requeue", f"SELECT id, (CASE WHEN id = 20 THEN 1 ELSE 0 END)::INT AS retries FROM {_MESSAGES}")
def queue_nack_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = Q.nack(_messages(spark, sf_dir), _state(spark, 0, 0, [20]), 20)
    return kept.select("id", "retries")


@register("queue_dead_letters", f"SELECT id, payload, 0::BIGINT AS deliver_at, 0::BIGINT AS expire_at, 1 AS retries FROM {_MESSAGES} WHERE id = 21")
def queue_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, letters, _ = Q.nack(_messages(spark, sf_dir), _state(spark, 0, 0, [21]), 21, requeue=False)
    return letters.select("id", "payload", "deliver_at", "expire_at", "retries")


@register("queue_trim", f"SELECT id FROM {_MESSAGES} ORDER BY id DESC LIMIT 100")
def queue_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.trim(_messages(spark, sf_dir), 100).select("id")


@register("queue_publish", f"SELECT id, payload FROM {_MESSAGES} UNION ALL SELECT (SELECT max(id) FROM {_MESSAGES}) + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def queue_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    fresh = table(spark, sf_dir, "region").select(
        F.lit("tasks").alias("topic"), F.lit(5).alias("priority"), F.lit(None).cast("string").alias("key"), F.col("r_name").alias("payload"), F.lit(0).cast("long").alias("deliver_at"), F.lit(0).cast("long").alias("expire_at"), F.lit(0).alias("retries"), F.col("r_regionkey").alias("seq")
    )
    return Q.publish(messages, fresh).select("id", "payload")


# ---------------------------------------------------------------- rows


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for keys that exist and keys that don't, each of them three times."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((F.floor(key / 3) * 2).cast("long").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"), key.alias("seq"))


_STOCK = "(SELECT s_suppkey, s_name, s_acctbal FROM supplier)"
_ARRIVALS = "(SELECT c_custkey // 3 * 2 AS s_suppkey, c_name AS s_name, c_acctbal AS s_acctbal, c_custkey AS seq FROM customer)"
_LAST = f"(SELECT s_suppkey, arg_max(s_name, seq) AS s_name, arg_max(s_acctbal, seq) AS s_acctbal, arg_min(s_name, seq) AS first_name, arg_min(s_acctbal, seq) AS first_bal, count(*) AS n FROM {_ARRIVALS} GROUP BY s_suppkey)"


@register("insert_or_replace", f"SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM {_STOCK} o FULL JOIN {_LAST} n USING (s_suppkey)")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.replace_into(_stock(spark, sf_dir), _arrivals(spark, sf_dir), "s_suppkey", "seq")


@register("insert_or_ignore", f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o.s_name, n.first_name) AS s_name, coalesce(o.s_acctbal, n.first_bal) AS s_acctbal FROM {_STOCK} o FULL JOIN {_LAST} n USING (s_suppkey)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.insert_or_ignore(_stock(spark, sf_dir), _arrivals(spark, sf_dir), "s_suppkey", "seq")


@register(
    "insert_on_conflict",
    f"""SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o.s_name, n.first_name) AS s_name,
    CASE WHEN n.s_suppkey IS NULL THEN o.s_acctbal WHEN o.s_suppkey IS NOT NULL OR n.n > 1 THEN n.s_acctbal ELSE n.first_bal END AS s_acctbal FROM {_STOCK} o FULL JOIN {_LAST} n USING (s_suppkey)""",
)
def insert_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.upsert(_stock(spark, sf_dir), _arrivals(spark, sf_dir), "s_suppkey", {"s_acctbal": None}, "seq")


@register(
    "insert_on_conflict_adds",
    f"""SELECT coalesce(o.s_suppkey, n.k) AS s_suppkey, round(coalesce(o.s_acctbal, 0) + coalesce(n.total, 0), 4) AS s_acctbal
    FROM {_STOCK} o FULL JOIN (SELECT s_suppkey AS k, sum(s_acctbal) AS total FROM {_ARRIVALS} GROUP BY s_suppkey) n ON s_suppkey = k""",
)
def insert_on_conflict_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key add up one after the other."""
    merged = DML.upsert(_stock(spark, sf_dir), _arrivals(spark, sf_dir), "s_suppkey", {"s_acctbal": "base.s_acctbal + last.s_acctbal"}, "seq")
    return merged.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@register("insert_select", f"SELECT s_suppkey, s_name, s_acctbal FROM {_STOCK} UNION ALL SELECT s_suppkey + 100000, s_name, s_acctbal FROM {_STOCK} WHERE s_acctbal > 0")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = _stock(spark, sf_dir)
    return stock.unionByName(stock.where("s_acctbal > 0").withColumn("s_suppkey", F.col("s_suppkey") + 100000))


@register("update_where", f"SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debtor' ELSE s_name END AS s_name, round(CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 ELSE s_acctbal END, 4) AS s_acctbal FROM {_STOCK}")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = DML.update(_stock(spark, sf_dir), F.col("s_acctbal") < 0, {"s_name": F.lit("debtor"), "s_acctbal": F.col("s_acctbal") * 2})
    return changed.withColumn("s_acctbal", F.round("s_acctbal", 4))


@register("update_order_limit", f"SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM {_STOCK} WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) THEN 'top' ELSE s_name END AS s_name FROM {_STOCK}")
def update_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = DML.update_first(_stock(spark, sf_dir), F.col("s_acctbal") > 0, {"s_name": F.lit("top")}, "s_suppkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 5)
    return changed.select("s_suppkey", "s_name")


@register("update_from", f"SELECT o.s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, o.s_acctbal FROM {_STOCK} o LEFT JOIN {_LAST} n USING (s_suppkey)")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.update_from(_stock(spark, sf_dir), _arrivals(spark, sf_dir), ("s_suppkey", "s_suppkey"), {"s_name": "s_name"}, "seq")


@register("update_returning", f"SELECT s_suppkey, 'rich' AS s_name FROM {_STOCK} WHERE s_acctbal > 5000")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.col("s_acctbal") > 5000
    return DML.update(_stock(spark, sf_dir), test, {"s_name": F.lit("rich")}).where(test).select("s_suppkey", "s_name")


@register("delete_where", f"SELECT s_suppkey FROM {_STOCK} WHERE NOT coalesce(nullif(s_acctbal, 0) < 1000, false)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.delete(_stock(spark, sf_dir), F.nullif("s_acctbal", F.lit(0)) < 1000).select("s_suppkey")


@register("delete_using", f"SELECT s_suppkey FROM {_STOCK} WHERE s_suppkey NOT IN (SELECT s_suppkey FROM {_ARRIVALS})")
def delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.delete_using(_stock(spark, sf_dir), _arrivals(spark, sf_dir), [("s_suppkey", "s_suppkey")]).select("s_suppkey")


@register("insert_defaults", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'anon') AS s_name FROM supplier")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stock(spark, sf_dir).select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"))
    return DML.checked(rows, ["s_suppkey"], [["s_suppkey"]], {"positive": F.col("s_suppkey") >= 0}, {"s_name": F.lit("anon")})


@register("foreign_key_orphans", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def foreign_key_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.orphans(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation").where("n_regionkey <> 1"), "n_nationkey").select("c_custkey")


@register("auto_increment", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) + 99 AS id FROM part")
def auto_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DML.number_rows(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 100).select("p_partkey", "id")


@register("alter_table", "SELECT n_nationkey AS id, n_name, NULL::VARCHAR AS note, 'none' AS state FROM nation")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = table(spark, sf_dir, "nation").withColumns({"note": F.lit(None).cast("string"), "state": F.lit("none")})
    return added.withColumnRenamed("n_nationkey", "id").drop("n_regionkey")


# ---------------------------------------------------------------- conversations

_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_COUNTED = f"(SELECT *, {_WORDS} AS tokens FROM conversations)"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@register("context_recent", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def context_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(_talk(spark, sf_dir), 3).select("conv_id", "turn")


@register(
    "context_window",
    f"SELECT conv_id, turn, used AS used_tokens FROM (SELECT conv_id, turn, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {_COUNTED}) WHERE used <= 150",
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.context_window(_talk(spark, sf_dir), 200, 30, 20).select("conv_id", "turn", "used_tokens")


@register(
    "context_compact",
    f"SELECT conv_id, count(*) FILTER (n > 2) AS compacted, coalesce(sum(tokens) FILTER (n > 2), 0)::BIGINT AS compacted_tokens, count(*) FILTER (n <= 2) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {_COUNTED}) GROUP BY conv_id",
)
def context_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.compact(_talk(spark, sf_dir), 2)


@register("session_statistics", f"SELECT conv_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn FROM {_COUNTED} GROUP BY conv_id")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.statistics(_talk(spark, sf_dir))


@register("session_search", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%the%' AND role = 'user'")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).where(F.ilike(F.col("text"), F.lit("%the%")) & (F.col("role") == "user")).select("conv_id", "turn")


@register(
    "text_chunks",
    "SELECT doc_id, c AS chunk, substr(text, c * 800 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT))::INT AS c FROM documents WHERE length(text) > 0)",
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.text_chunks(table(spark, sf_dir, "documents"), 1000, 200)


_ONE = [1.0] + [0.0] * 63
_SQL_ONE = "[1.0" + ", 0.0" * 63 + "]::DOUBLE[]"


@register("memory_search", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_SQL_ONE}), 6) AS distance FROM embeddings WHERE vec_id % 4 <> 0 AND label < 5 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_SQL_ONE}), vec_id LIMIT 8")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "embeddings").withColumn("expire_at", F.when(F.col("vec_id") % 4 == 0, NOW - 1).otherwise(0))
    found = sessions.remember(memories, "embedding", _ONE, 8, NOW, F.col("label") < 5)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@register("memory_duplicates", "SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id WHERE 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) <= 0.7")
def memory_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "embeddings")
    queries = memories.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return sessions.duplicates_of(memories, "embedding", queries, 0.7).withColumn("distance", F.round("distance", 6))


@register("step_performance", "SELECT event_type, count(value) AS runs, round(avg(value) + 1e-9, 6) AS mean, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, max(value) AS longest FROM events GROUP BY event_type")
def step_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sessions.performance(table(spark, sf_dir, "events"), "event_type", "value")
    return report.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean", "p50", "p95")})


# ---------------------------------------------------------------- imports and exports


@register("import_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return files.import_csv(spark, path)


@register("import_jsonl", "SELECT n_nationkey::VARCHAR AS doc_id, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0")
def import_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    key = F.col("n_nationkey")
    named = F.when(key % 5 == 0, F.to_json(F.struct(F.col("n_name").alias("title")))).otherwise(F.to_json(F.struct(key.alias("id"), F.col("n_name").alias("title"))))
    table(spark, sf_dir, "nation").select(named.alias("value")).write.text(path)
    return files.import_jsonl(spark, path)


@register("import_line_protocol", "SELECT 'events' AS measurement, event_type AS kind, user_id::VARCHAR AS user, event_id::VARCHAR AS n, 'true' AS ok, epoch_us(ts) // 1000 AS ms FROM events")
def import_line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    events = table(spark, sf_dir, "events")
    line = F.format_string("events,kind=%s,user=%s n=%si,ok=T %s000000", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.unix_millis("ts").cast("string"))
    events.select(line.alias("value")).write.text(path)
    points = files.import_lines(spark, path)
    return points.select("measurement", F.col("tags")["kind"].alias("kind"), F.col("tags")["user"].alias("user"), F.col("fields")["n"].alias("n"), F.col("fields")["ok"].alias("ok"), F.unix_millis("ts").alias("ms"))


@register("import_bulk", "SELECT 'docs' AS index_name, n_nationkey::VARCHAR AS doc_id, '{\"name\":\"' || n_name || '\"}' AS document FROM nation WHERE n_nationkey % 4 IN (0, 1)")
def import_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bulk")
    key = F.col("n_nationkey")
    action = F.element_at(F.array(F.lit("index"), F.lit("create"), F.lit("update"), F.lit("delete")), (key % 4 + 1).cast("int"))
    head = F.format_string('{"%s":{"_index":"docs","_id":"%s"}}', action, key.cast("string"))
    body = F.to_json(F.struct(F.col("n_name").alias("name")))
    pair = F.when(key % 4 == 3, head).otherwise(F.concat_ws("\n", head, body))
    table(spark, sf_dir, "nation").select(pair.alias("value")).write.text(path)
    return files.import_bulk(spark, path)


@register("import_sql_dump", "SELECT 1::BIGINT AS id, 'it''s; fine' AS name, 1.5::DOUBLE AS price UNION ALL SELECT 2, NULL, 2.0 UNION ALL SELECT 3, 'x', NULL")
def import_sql_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = """PRAGMA foreign_keys=OFF; BEGIN TRANSACTION; -- a comment; with a semicolon
    CREATE TABLE items(id INTEGER PRIMARY KEY, name TEXT, price NUMERIC(10,2), UNIQUE (name));
    INSERT INTO items VALUES(1,'it''s; fine',1.5); INSERT INTO items VALUES(2,NULL,2.0); INSERT INTO items(id, name) VALUES (3, 'x'); COMMIT;"""
    return files.import_dump(spark, script)["items"]


@register("keyspace_round_trip", f"SELECT * FROM {_KV}")
def keyspace_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "keyspace")
    files.export_keyspace(_kv(spark, sf_dir), path)
    return files.import_keyspace(spark, path)


@register("database_round_trip", "SELECT r_regionkey, r_name FROM region")
def database_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "database")
    files.export_tables({"region": table(spark, sf_dir, "region"), "nation": table(spark, sf_dir, "nation")}, path)
    return files.import_tables(spark, path, ["region"])["region"]
