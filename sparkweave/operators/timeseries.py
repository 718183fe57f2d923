"""Time series: queries by tags and time, windows, gap filling, retention.

A series is a table with a timestamp column, tag columns and field columns. Bucket starts are milliseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.scratch import scratch

# Fixed value: grids with more buckets than this are not filled.
MAX_GRID = 100_000


def millis(df: DataFrame, ts: str = "ts") -> Column:
    return F.unix_millis(df[ts])


def measure(name: str, value: Column, ts: Column) -> Column:
    """sum, count, avg, min, max, first, last or stddev (of the population) of numeric values; others are left out."""
    value = value.try_cast("double")
    known = F.when(value.isNotNull(), ts)
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "avg": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "first": lambda: F.min_by(value, known),
        "last": lambda: F.max_by(value, known),
        "stddev": lambda: F.stddev_pop(value),
    }[name]()


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Of points with the same tags and time, the one written last."""
    columns = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), sequence).alias("__row"))
    return newest.select(*keys, "__row.*")


def query(df: DataFrame, tags: Mapping[str, str] | None = None, start: int | None = None, end: int | None = None, ts: str = "ts", patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Points with these tag values or patterns, from start (inclusive) to end (exclusive) in milliseconds. The time limits are on the column itself, so scans prune by them."""
    for tag, value in (tags or {}).items():
        df = df.where(F.col(tag) == value)
    for tag, pattern in (patterns or {}).items():
        df = df.where(F.rlike(F.col(tag), F.lit(pattern)))
    if start is not None:
        df = df.where(F.col(ts) >= F.timestamp_millis(F.lit(start)))
    if end is not None:
        df = df.where(F.col(ts) < F.timestamp_millis(F.lit(end)))
    return df


def tumbling(df: DataFrame, width: int, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Windows of ``width`` milliseconds from multiples of it, toward zero."""
    ms = millis(df, ts)
    start = (ms - ms % width).alias("bucket")
    aggregates = [measure(m, F.col(value), F.col(ts)).alias(m) for m in measures]
    return df.groupBy(*by, start).agg(*aggregates)


def sliding(df: DataFrame, width: int, step: int, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Windows of ``width`` that begin at every multiple of ``step`` from 0 on. A point is copied once for each window that holds it."""
    if step >= width:
        return tumbling(df, width, value, measures, by, ts)
    ms = millis(df, ts)
    last = ms - F.pmod(ms, F.lit(step))
    first = F.greatest(ms - width + step - F.pmod(ms - width, F.lit(step)), F.lit(0))
    starts = F.when((ms >= 0) & (first <= last), F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    spread = df.withColumn("bucket", F.explode(starts))
    return spread.groupBy(*by, "bucket").agg(*[measure(m, F.col(value), F.col(ts)).alias(m) for m in measures])


def session(df: DataFrame, gap: int, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Sessions that end when over ``gap`` milliseconds pass without a point whose field is a number; named by their first time."""
    points = df.where(F.col(value).try_cast("double").isNotNull())
    window = F.session_window(ts, f"{gap} milliseconds")
    grouped = points.groupBy(*by, window.alias("w")).agg(*[measure(m, F.col(value), F.col(ts)).alias(m) for m in measures])
    return grouped.select(*by, F.unix_millis(F.col("w.start")).alias("bucket"), *measures)


def state(df: DataFrame, field: str, value: str, measures: Sequence[str], by: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """A window for each run of equal states in the order of time; named by its first time. A missing state is an empty one.

    Without ``by`` there is one order over all points: ranges of it are written once and numbered by themselves, and a range's first run goes on from the last of the range before.
    """
    points = df.where(F.col(value).try_cast("double").isNotNull()).withColumn("__state", F.coalesce(F.col(field).cast("string"), F.lit("")))
    groups = list(by)
    if not by:
        path = scratch(df.sparkSession, "states")
        points.repartitionByRange(ts, *tie).sortWithinPartitions(ts, *tie).withColumn("__range", F.spark_partition_id()).write.parquet(path)
        points, groups = df.sparkSession.read.parquet(path), ["__range"]
    ordered = Window.partitionBy(*groups).orderBy(ts, *tie)
    changed = F.coalesce((F.lag("__state").over(ordered) != F.col("__state")).cast("int"), F.lit(1))
    runs = points.withColumn("__changed", changed).withColumn("__run", F.sum("__changed").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not by:
        # One row for each range: its first and last state and its runs.
        place = F.struct(ts, *tie)
        each = runs.groupBy("__range").agg(F.min_by("__state", place).alias("first"), F.max_by("__state", place).alias("last"), F.max("__run").alias("n"))
        along = Window.orderBy("__range")
        joined = F.coalesce((F.lag("last").over(along) == F.col("first")).cast("int"), F.lit(0))
        each = each.withColumn("joined", joined)
        moved = F.coalesce(F.sum(F.col("n") - F.col("joined")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("joined")
        runs = runs.join(F.broadcast(each.select("__range", moved.alias("__moved"))), "__range").withColumn("__run", F.col("__run") + F.col("__moved"))
    grouped = runs.groupBy(*by, "__run", F.col("__state").alias("state")).agg(F.unix_millis(F.min(ts)).alias("bucket"), *[measure(m, F.col(value), F.col(ts)).alias(m) for m in measures])
    return grouped.drop("__run")


def fill(buckets: DataFrame, width: int, value: str, how: str = "null", constant: float = 0.0, start: int | None = None, end: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row for each bucket of the grid from start to end, by default from the first to the last one there is, with NaN, a constant, the previous value or a straight
    line in the empty ones. How "none" leaves the rows as they are, and so do grids of over MAX_GRID buckets, group by group; a null in ``by`` is a group of its own.
    """
    if how == "none":
        return buckets
    limits = buckets.groupBy(*by).agg(F.min("bucket").alias("__a"), F.max("bucket").alias("__z"))
    low = F.lit(start - start % width) if start is not None else F.col("__a")
    high = F.lit(end) if end is not None else F.col("__z") + width
    limits = limits.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], low.alias("__low"), high.alias("__high"), ((high - low) / width > MAX_GRID).alias("__large"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(f"__by{i}").eqNullSafe(buckets[c])
    grid = limits.where("NOT __large AND __high > __low").withColumn("__bucket", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1, F.lit(width))))
    names = [F.col(f"__by{i}").alias(c) for i, c in enumerate(by)]
    filled = grid.join(buckets, same & (F.col("__bucket") == buckets["bucket"]), "left").select(*names, F.col("__bucket").alias("bucket"), *[c for c in buckets.columns if c not in (*by, "bucket")])
    ordered = Window.partitionBy(*by).orderBy("bucket")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    here, nan = F.col(value), F.lit(float("nan"))
    if how == "null":
        new = F.coalesce(here, nan)
    elif how == "value":
        new = F.coalesce(here, F.lit(constant))
    elif how == "previous":
        new = F.coalesce(F.last(here, ignorenulls=True).over(before), nan)
    elif how == "linear":
        at = F.when(here.isNotNull(), F.col("bucket"))
        p, gp = F.last(here, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(before)
        n, gn = F.first(here, ignorenulls=True).over(after), F.first(at, ignorenulls=True).over(after)
        line = p + (F.col("bucket") - gp) / F.when(gn > gp, gn - gp) * (n - p)
        new = F.coalesce(here, line, nan)
    else:
        raise ValueError("how must be none, null, value, previous or linear")
    others = [c for c in buckets.columns if c not in (*by, "bucket", value)]
    done = filled.select(*by, "bucket", new.alias(value), *[F.coalesce(c, F.lit(0)).alias(c) if c == "count" else F.col(c) for c in others])
    large = buckets.join(limits.where("__large"), same, "left_semi")
    return done.unionByName(large.select(*by, "bucket", value, *others))


def downsample(df: DataFrame, width: int, value: str, how: str, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One point per bucket and tags, as a series again."""
    reduced = tumbling(df, width, value, [how], by, ts)
    return reduced.select(F.timestamp_millis("bucket").alias(ts), *by, F.col(how).alias(value))


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    return df.select(tag).where(F.col(tag).isNotNull()).distinct().orderBy(tag)


def retain(df: DataFrame, now: int, duration: int, ts: str = "ts") -> DataFrame:
    """Without points older than ``duration`` milliseconds."""
    return df.where(F.col(ts) >= F.timestamp_millis(F.lit(now - duration)))


def purge(df: DataFrame, before: int | None = None, tags: Mapping[str, str] | None = None, ts: str = "ts") -> DataFrame:
    """Without points before a time, or with all of these tags."""
    if before is not None:
        df = df.where(F.col(ts) >= F.timestamp_millis(F.lit(before)))
    if tags:
        hit = F.lit(True)
        for tag, value in tags.items():
            hit = hit & F.col(tag).eqNullSafe(value)
        df = df.where(~hit)
    return df


def all_tag_values(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(tag, value) of all tags, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in tags]))
    return df.select(pairs.alias("p")).select("p.tag", "p.value").where("value IS NOT NULL").distinct()


def describe(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Per series: points, and the first and last time in milliseconds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.unix_millis(F.min(ts)).alias("first_ms"), F.unix_millis(F.max(ts)).alias("last_ms"))
