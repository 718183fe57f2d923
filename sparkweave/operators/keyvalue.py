"""Key-value tables (key, value, expire_at): the write operations give the new table, the reads what they find. expire_at is in milliseconds, 0 for never."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.predicates import glob_to_regex

LARGEST, SMALLEST = (1 << 63) - 1, -(1 << 63)


def live(kv: DataFrame, now: int) -> DataFrame:
    """Without expired rows."""
    return kv.where((F.col("expire_at") == 0) | (F.col("expire_at") > now))


def in_order(writes: DataFrame, sequence: str = "seq") -> DataFrame:
    """Writes with their order: a column of that name, or else the order of the rows."""
    return writes if sequence in writes.columns else writes.withColumn(sequence, F.monotonically_increasing_id())


def _merged(kv: DataFrame, new: DataFrame, choice: Column) -> DataFrame:
    old = kv.select("key", F.struct("value", "expire_at").alias("old"))
    fresh = new.select("key", F.struct("value", "expire_at").alias("fresh"))
    return old.join(fresh, "key", "full").withColumn("row", choice).where("row IS NOT NULL").select("key", "row.value", "row.expire_at")


def put(kv: DataFrame, new: DataFrame) -> DataFrame:
    """SET and MSET; of several values for one key the last (see in_order()) stays."""
    return _merged(kv, last_of(in_order(new)), F.coalesce("fresh", "old"))


def put_new(kv: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """SETNX: only keys that are not there; of several values for one key the first stays."""
    first = in_order(new).groupBy("key").agg(F.min_by(F.struct("value", "expire_at"), "seq").alias("r")).select("key", "r.value", "r.expire_at")
    return _merged(live(kv, now), first, F.coalesce("old", "fresh"))


def last_of(writes: DataFrame, sequence: str = "seq") -> DataFrame:
    """The table that a log of writes leaves: of each key the last."""
    return writes.groupBy("key").agg(F.max_by(F.struct("value", "expire_at"), sequence).alias("r")).select("key", "r.value", "r.expire_at")


def get(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(key, value) for each key asked for; NULL where there is none."""
    return keys.select("key").join(live(kv, now).select("key", "value"), "key", "left")


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def delete_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(~F.startswith("key", F.lit(prefix)))


def expire(kv: DataFrame, keys: DataFrame, at: int) -> DataFrame:
    """EXPIRE, EXPIREAT: a time for each of these keys; PERSIST is time 0. Times below a second are rounded up to the next."""
    at = -(-at // 1000) * 1000
    hit = keys.select("key").distinct().withColumn("__hit", F.lit(True))
    return kv.join(hit, "key", "left").select("key", "value", F.when(F.col("__hit"), F.lit(at)).otherwise(F.col("expire_at")).cast("long").alias("expire_at"))


def ttl(kv: DataFrame, now: int) -> DataFrame:
    """(key, seconds left); -1 for keys that do not expire."""
    left = F.when(F.col("expire_at") == 0, F.lit(-1)).otherwise(F.ceil((F.col("expire_at") - now) / 1000))
    return live(kv, now).select("key", left.cast("long").alias("ttl"))


def increase(kv: DataFrame, deltas: DataFrame, now: int) -> DataFrame:
    """INCR, INCRBY, DECR, DECRBY: whole numbers (key, delta) added within 64 bits; a key that is new begins at 0, and time limits go."""
    summed = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    both = live(kv, now).join(summed, "key", "full")
    number = F.coalesce(F.col("value").try_cast("bigint"), F.lit(0)).cast("decimal(38,0)") + F.col("delta")
    held = F.least(F.greatest(number, F.lit(SMALLEST).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint").cast("string")
    changed = F.col("delta").isNotNull()
    return both.select("key", F.when(changed, held).otherwise(F.col("value")).alias("value"), F.when(changed, F.lit(0)).otherwise(F.col("expire_at")).cast("long").alias("expire_at"))


def increase_float(kv: DataFrame, deltas: DataFrame, now: int) -> DataFrame:
    summed = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    both = live(kv, now).join(summed, "key", "full")
    number = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.col("delta")
    return both.select("key", F.when(F.col("delta").isNotNull(), number.cast("string")).otherwise(F.col("value")).alias("value"), F.coalesce("expire_at", F.lit(0)).cast("long").alias("expire_at"))


def append(kv: DataFrame, parts: DataFrame, now: int) -> DataFrame:
    """APPEND (key, part), in order; a key that is new or has expired begins empty, others keep their time limit."""
    listed = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("part", F.lit("")).alias("part"))))
    joined = in_order(parts).groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("part"))
    both = live(kv, now).join(joined, "key", "full")
    return both.select("key", F.concat(F.coalesce("value", F.lit("")), F.coalesce("part", F.lit(""))).alias("value"), F.coalesce("expire_at", F.lit(0)).cast("long").alias("expire_at"))


def get_range(value: Column, start: int, end: int) -> Column:
    """GETRANGE in bytes: both ends included, negative ones from the end. Bytes that are no whole characters are cut off as they are."""
    data = value.cast("binary")
    n = F.octet_length(value)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.lit(end) if end >= 0 else n + end
    return F.substring(data, low + 1, F.greatest(F.least(high, n - 1) - low + 1, F.lit(0))).cast("string")


def set_range(value: Column, offset: int, part: str) -> Column:
    """SETRANGE in bytes: what is missing before the offset becomes zero bytes."""
    data, size = value.cast("binary"), len(part.encode())
    head = F.rpad(F.substring(data, F.lit(1), F.lit(offset)), F.lit(offset), F.lit(b"\0")) if offset else F.lit(b"")
    tail = F.substring(data, F.lit(offset + size + 1), F.greatest(F.octet_length(value) - offset - size, F.lit(0)))
    return F.concat(head, F.lit(part.encode()), tail).cast("string")


def rename(kv: DataFrame, old: str, new: str, now: int) -> DataFrame:
    """The value under another key, with its time limit; that key's own value goes. KeyError if there is no such key or it has expired."""
    moved = live(kv, now).where(F.col("key") == old).withColumn("key", F.lit(new))
    if moved.isEmpty():
        raise KeyError(old)
    return kv if old == new else kv.where(~F.col("key").isin(old, new)).unionByName(moved)


def random_key(kv: DataFrame, now: int) -> DataFrame:
    """One row with a key that has not expired, the first in order; none if there is none."""
    return live(kv, now).select("key").orderBy("key").limit(1)


def prefix_scan(kv: DataFrame, prefix: str, now: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Keys with a prefix, which scans push down; in order if paged."""
    hits = live(kv, now).where(F.startswith("key", F.lit(prefix)))
    return hits if limit is None else hits.orderBy("key").offset(offset).limit(limit)


def glob_scan(kv: DataFrame, pattern: str, now: int) -> DataFrame:
    """Keys that a pattern with * and ? matches; the literal text before the first of these is a prefix that scans push down."""
    literal = re.split(r"[*?]", pattern, maxsplit=1)[0]
    hits = live(kv, now).where(F.startswith("key", F.lit(literal)))
    return hits.where(F.rlike("key", F.lit(glob_to_regex(pattern))))


def key_type(value: Column) -> Column:
    """string for UTF-8 text, bytes for other values, none for no value."""
    return F.when(value.isNull(), "none").when(F.is_valid_utf8(value), "string").otherwise("bytes")


def exists(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(key, found) for each key asked for."""
    held = live(kv, now).select("key", F.lit(True).alias("found"))
    return keys.select("key").join(held, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def get_and_set(kv: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """GETSET: the values that were there, and the table with the new ones. Of several writes to one key each finds the value of the one before."""
    ordered = in_order(new)
    before = ordered.withColumns({"__n": F.row_number().over(each := Window.partitionBy("key").orderBy("seq")), "__before": F.lag("value").over(each)})
    held = live(kv, now).select("key", F.col("value").alias("__old"))
    found = before.join(held, "key", "left").select("key", F.when(F.col("__n") == 1, F.col("__old")).otherwise(F.col("__before")).alias("value"))
    return found, put(kv, ordered)


def expire_time(kv: DataFrame, now: int) -> DataFrame:
    """(key, second at which it goes), without keys that don't expire."""
    return live(kv, now).where("expire_at > 0").select("key", F.floor(F.col("expire_at") / 1000).cast("long").alias("at"))
