"""Aggregates, window functions and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import aggregates as A
from sparkweave.operators import timeseries as T
from sparkweave.operators import windows as W
from sparkweave.operators.relational import order
from sparkweave.plans.registry import register
from sparkweave.tables import table


@register(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_shipdate <= TIMESTAMP '1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base"),
            F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@register(
    "aggregate_ungrouped",
    """
    SELECT count(*) AS n, count(v) AS n_values, coalesce(sum(v), 0) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high,
           round(stddev_pop(v), 6) AS sd, round(var_pop(v), 4) AS variance
    FROM (SELECT CASE WHEN l_linenumber > 1 THEN l_quantity END AS v FROM lineitem)
    """,
)
def aggregate_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_values"),
        A.total(v).alias("total"),
        F.round(F.avg(v), 6).alias("mean"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.round(A.stddev(v), 6).alias("sd"),
        F.round(A.variance(v), 4).alias("variance"),
    )


@register("sum_of_nothing", "SELECT 0::DOUBLE AS total, NULL::DOUBLE AS mean, 0::BIGINT AS n")
def sum_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity < 0").agg(A.total(F.col("l_quantity")).alias("total"), F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"))


@register(
    "having",
    "SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 500000",
)
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cnt"), F.sum("o_totalprice").alias("total"))
    return grouped.where("cnt > 12 AND total > 500000").withColumn("total", F.round("total", 2))


@register("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@register("group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_nationkey::VARCHAR, '; ' ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.group_concat(F.col("n_name")).alias("names"), A.group_concat(F.col("n_nationkey"), "; ").alias("keys"))


@register(
    "json_aggregates",
    """
    SELECT n_regionkey, '[' || string_agg(coalesce('"' || v || '"', 'null'), ',' ORDER BY n_nationkey) || ']' AS every,
           '[' || string_agg('"' || v || '"', ',' ORDER BY n_nationkey) || ']' AS known,
           '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS object
    FROM (SELECT *, CASE WHEN n_nationkey % 4 != 0 THEN n_name END AS v FROM nation) GROUP BY n_regionkey
    """,
)
def json_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("v", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")))
    by = F.col("n_nationkey")
    return nations.groupBy("n_regionkey").agg(
        A.json_array(F.col("v"), by).alias("every"),
        A.json_array(F.col("v"), by, keep_nulls=False).alias("known"),
        A.json_object(F.col("n_name"), F.col("n_nationkey"), by).alias("object"),
    )


@register("bool_aggregates", "SELECT l_returnflag, bool_and(l_linenumber - 1 <> 0) AS every, bool_or(l_linenumber - 6 <> 0) AS some FROM lineitem GROUP BY l_returnflag")
def bool_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.bool_and(n - 1).alias("every"), A.bool_or(n - 6).alias("some"))


@register(
    "percentiles",
    """
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.25) AS q1
    FROM orders GROUP BY o_orderpriority
    """,
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(A.percentile_cont(0.5, price), 4).alias("median"), F.round(A.percentile_cont(0.9, price), 4).alias("p90"), A.percentile_disc(0.25, "o_totalprice").alias("q1")
    )


@register(
    "grouped_statistics",
    "SELECT p_size, count(p_retailprice) AS n, round(stddev_pop(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS variance, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY p_size",
)
def grouped_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_size").agg(
        F.count(price).alias("n"), F.round(A.stddev(price), 6).alias("sd"), F.round(A.variance(price), 4).alias("variance"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name")
    )


@register(
    "analyze",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, "
        f"min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS selectivity FROM nation"
        for c in ("n_nationkey", "n_name", "n_regionkey")
    ),
)
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyze(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


_BY_PRICE = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey)"


@register(
    "window_ranking",
    f"""
    SELECT o_orderkey, (row_number() {_BY_PRICE})::INT AS rn, (rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INT AS rk,
           (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority))::INT AS dr,
           (floor((row_number() {_BY_PRICE} - 1) * 4 / count(*) OVER (PARTITION BY o_custkey)) + 1)::INT AS tile, (ntile(4) {_BY_PRICE})::INT AS standard_tile
    FROM orders
    """,
)
def window_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    price = [order("o_totalprice", True), order("o_orderkey")]
    by_price, by_priority = Window.partitionBy("o_custkey").orderBy(*price), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.row_number().over(by_price).alias("rn"),
        F.rank().over(by_priority).alias("rk"),
        F.dense_rank().over(by_priority).alias("dr"),
        W.ntile(4, ["o_custkey"], price).alias("tile"),
        F.ntile(4).over(by_price).alias("standard_tile"),
    )


@register(
    "window_lag_lead",
    """
    SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after"))


@register(
    "window_aggregates",
    """
    SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
           round(sum(o_totalprice) OVER p, 2) AS whole, count(*) OVER p AS n, round(avg(o_totalprice) OVER p, 6) AS mean, min(o_totalprice) OVER p AS low, max(o_totalprice) OVER p AS high,
           round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER p / count(*) OVER p, 6) AS mean_of_rows
    FROM orders WINDOW p AS (PARTITION BY o_custkey)
    """,
)
def window_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, keys, by = F.col("o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(_running(price, keys), 2).alias("running"),
        F.round(W.aggregate_over(F.sum(price), keys, by, "partition"), 2).alias("whole"),
        W.aggregate_over(F.count(F.lit(1)), keys).alias("n"),
        F.round(W.aggregate_over(F.avg(price), keys), 6).alias("mean"),
        W.aggregate_over(F.min(price), keys).alias("low"),
        W.aggregate_over(F.max(price), keys).alias("high"),
        F.round(W.average_of_rows(F.when(F.col("o_orderstatus") == "F", price), keys), 6).alias("mean_of_rows"),
    )


def _running(price, keys):
    return W.aggregate_over(F.sum(price), keys, [F.col("o_orderdate"), F.col("o_orderkey")])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_START, _END = 1704153600000, 1705363200000
_RANGE = f"(epoch_us(ts) // 1000) >= {_START} AND (epoch_us(ts) // 1000) < {_END}"
_MEASURES = ["sum", "count", "avg", "min", "max", "first", "last", "stddev"]
_MEASURED = "sum(value) AS sum, count(value) AS count, avg(value) AS avg, min(value) AS min, max(value) AS max, arg_min(value, ts) AS first, arg_max(value, ts) AS last, stddev_pop(value) AS stddev"


def _rounded(df: DataFrame) -> DataFrame:
    """Means of few decimals lie on the edges of rounding, where engines differ; a nudge moves them off."""
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round_sql(sql: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in columns)}) FROM ({sql})"


_ROUNDED = ["sum", "avg", "min", "max", "first", "last", "stddev"]


@register("ts_query", f"SELECT event_id, value FROM events WHERE event_type = 'click' AND {_RANGE} ORDER BY ts DESC, event_id LIMIT 50")
def ts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.query(_events(spark, sf_dir), {"event_type": "click"}, _START, _END).orderBy(F.col("ts").desc(), "event_id").select("event_id", "value").limit(50)


@register("ts_query_regex", f"SELECT event_id FROM events WHERE regexp_matches(event_type, 'c(l|a)') AND {_RANGE}")
def ts_query_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.query(_events(spark, sf_dir), None, _START, _END, patterns={"event_type": "c(l|a)"}).select("event_id")


@register("ts_aggregate_all", _round_sql(f"SELECT 0::BIGINT AS bucket, {_MEASURED} FROM events WHERE {_RANGE}", _ROUNDED))
def ts_aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.query(_events(spark, sf_dir), None, _START, _END)
    return _rounded(points.agg(*[T.measure(m, F.col("value"), F.col("ts")).alias(m) for m in _MEASURES]).select(F.lit(0).cast("long").alias("bucket"), *_MEASURES))


@register("ts_tumbling", _round_sql(f"SELECT event_type, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 AS bucket, {_MEASURED} FROM events GROUP BY ALL", _ROUNDED))
def ts_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.tumbling(_events(spark, sf_dir), 3_600_000, "value", _MEASURES, ["event_type"]))


@register(
    "ts_sliding",
    _round_sql(
        "SELECT bucket, sum(value) AS sum, count(value) AS count, avg(value) AS avg FROM (SELECT value, unnest(range(greatest(0, ((epoch_us(ts) // 1000) - 7200000) // 1800000 * 1800000 + 1800000), (epoch_us(ts) // 1000) + 1, 1800000)) AS bucket FROM events) GROUP BY bucket",
        ["sum", "avg"],
    ),
)
def ts_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.sliding(_events(spark, sf_dir), 7_200_000, 1_800_000, "value", ["sum", "count", "avg"]))


@register(
    "ts_session",
    _round_sql(
        """
        SELECT user_id, (epoch_us(min(ts)) // 1000) AS bucket, sum(value) AS sum, count(value) AS count FROM (
          SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
            SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events))
        GROUP BY user_id, run
        """,
        ["sum"],
    ),
)
def ts_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.session(_events(spark, sf_dir), 1_800_000, "value", ["sum", "count"], ["user_id"]))


@register(
    "ts_state",
    _round_sql(
        """
        SELECT user_id, state, (epoch_us(min(ts)) // 1000) AS bucket, count(value) AS count, avg(value) AS avg FROM (
          SELECT *, event_type AS state, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events))
        GROUP BY user_id, run, state
        """,
        ["avg"],
    ),
)
def ts_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.state(_events(spark, sf_dir), "event_type", "value", ["count", "avg"], ["user_id"], tie=["event_id"]))


_HOURS = "SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 600000 AS bucket, sum(value) AS v, count(value) AS count FROM events WHERE user_id = 3 GROUP BY 1"
_GRID = f"SELECT g.bucket, h.v, coalesce(h.count, 0) AS count FROM (SELECT unnest(range(min(bucket), max(bucket) + 600000, 600000)) AS bucket FROM ({_HOURS})) g LEFT JOIN ({_HOURS}) h ON g.bucket = h.bucket"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir).where("user_id = 3")
    return T.tumbling(points, 600_000, "value", ["sum", "count"]).withColumnRenamed("sum", "v")


def _register_fill(how: str, sql: str) -> None:
    @register(f"ts_fill_{how}", f"SELECT bucket, round({sql} + 1e-9, 6) AS v, count FROM ({_GRID})")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        filled = T.fill(_hours(spark, sf_dir), 600_000, "v", how, constant=-1.0)
        # NaN stands for an empty bucket; a large negative number makes it comparable.
        return filled.select("bucket", F.round(F.when(F.isnan("v"), F.lit(-999.0)).otherwise(F.col("v")) + 1e-9, 6).alias("v"), F.col("count"))


_P = "last_value(v IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_GP = "last_value(CASE WHEN v IS NOT NULL THEN bucket END IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_register_fill("null", "coalesce(v, -999)")
_register_fill("value", "coalesce(v, -1)")
_register_fill("previous", f"coalesce({_P}, -999)")
_register_fill("linear", f"coalesce(v, {_P} + (bucket - {_GP}) / (({_GP.replace('last_value', 'first_value').replace('UNBOUNDED PRECEDING AND CURRENT ROW', 'CURRENT ROW AND UNBOUNDED FOLLOWING')}) - {_GP}) * (({_P.replace('last_value', 'first_value').replace('UNBOUNDED PRECEDING AND CURRENT ROW', 'CURRENT ROW AND UNBOUNDED FOLLOWING')}) - {_P}), -999)")


@register(
    "ts_fill_long_gap",
    """WITH b AS (SELECT event_type, (epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 3600000) * CASE WHEN event_type = 'click' THEN 1000000 ELSE 1 END AS bucket, count(value) AS count FROM events GROUP BY 1, 2),
    l AS (SELECT event_type, min(bucket) AS a, max(bucket) AS z FROM b GROUP BY event_type),
    g AS (SELECT event_type, unnest(range(a, z + 3600000, 3600000)) AS bucket FROM l WHERE (z + 3600000 - a) / 3600000 <= 100000)
    SELECT g.event_type, g.bucket, coalesce(b.count::DOUBLE, -1) AS v FROM g LEFT JOIN b ON g.event_type IS NOT DISTINCT FROM b.event_type AND g.bucket = b.bucket
    UNION ALL SELECT event_type, bucket, count::DOUBLE FROM b WHERE event_type IN (SELECT event_type FROM l WHERE (z + 3600000 - a) / 3600000 > 100000)""",
)
def ts_fill_long_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group's grid is far too long to be filled; its rows stay as they are."""
    hours = T.tumbling(_events(spark, sf_dir), 3_600_000, "value", ["count"], ["event_type"])
    apart = hours.select("event_type", (F.col("bucket") * F.when(F.col("event_type") == "click", 1_000_000).otherwise(1)).alias("bucket"), F.col("count").cast("double").alias("v"))
    return T.fill(apart, 3_600_000, "v", "value", constant=-1.0, by=["event_type"])


@register("ts_fill_none", f"SELECT bucket, round(v + 1e-9, 6) AS v, count FROM ({_HOURS})")
def ts_fill_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.fill(_hours(spark, sf_dir), 600_000, "v", "none"))


@register("ts_downsample", "SELECT make_timestamp(((epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000) * 1000) AS ts, event_type, round(avg(value) + 1e-9, 6) AS value FROM events GROUP BY 1, 2")
def ts_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.downsample(_events(spark, sf_dir), 86_400_000, "value", "avg", ["event_type"]))


@register("ts_tag_values", "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def ts_tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tag_values(_events(spark, sf_dir), "event_type")


@register("ts_retention", f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) >= {_END} - 864000000")
def ts_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.retain(_events(spark, sf_dir), _END, 864_000_000).select("event_id")


@register("ts_purge", f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) >= {_START} AND NOT (event_type = 'click' AND user_id = 3)")
def ts_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.purge(_events(spark, sf_dir).withColumn("user", F.col("user_id").cast("string")), _START, {"event_type": "click", "user": "3"}).select("event_id")


@register("ts_keep_last", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def ts_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir).select("user_id", "event_type", "value", "event_id")
    return T.keep_last(points, ["user_id", "event_type"], "event_id").drop("event_id")
