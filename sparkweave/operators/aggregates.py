"""Aggregates of the dialect, where they differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(column: Column) -> Column:
    """SUM without groups: 0 where there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def group_concat(column: Column, separator: str = ",", by: Column | None = None) -> Column:
    """The values as text in the order of ``by``, or of the texts themselves; NULL for none."""
    pairs = F.collect_list(F.when(column.isNotNull(), F.struct((column if by is None else by).alias("k"), column.cast("string").alias("v"))))
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), separator)
    return F.when(F.size(pairs) > 0, joined)


def json_array(column: Column, by: Column, keep_nulls: bool = True) -> Column:
    """JSON_ARRAYAGG keeps NULLs and is [] for no rows; ARRAY_AGG skips them and is NULL for none. Elements are in the order of ``by``."""
    pairs = F.collect_list(F.struct(by.alias("k"), column.alias("v")))
    if not keep_nulls:
        pairs = F.filter(pairs, lambda x: x["v"].isNotNull())
    text = F.to_json(F.transform(F.array_sort(pairs), lambda x: x["v"]))
    return text if keep_nulls else F.when(F.size(pairs) > 0, text)


def json_object(key: Column, value: Column, by: Column) -> Column:
    """Keys sorted; NULL keys left out; of equal keys the last in the order of ``by``."""
    pairs = F.collect_list(F.when(key.isNotNull(), F.struct(key.cast("string").alias("k"), by.alias("b"), value.alias("v"))))
    ordered = F.array_sort(pairs)
    last = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["k"] != x["k"]))
    return F.to_json(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))))


def bool_and(column: Column) -> Column:
    """Numbers other than 0 are true; NULL if there is no value."""
    return F.bool_and(column.cast("boolean"))


def bool_or(column: Column) -> Column:
    return F.bool_or(column.cast("boolean"))


def stddev(column: Column) -> Column:
    """Of the population."""
    return F.stddev_pop(column)


def variance(column: Column) -> Column:
    return F.var_pop(column)


def percentile_cont(fraction: float, column: Column) -> Column:
    """Interpolated between neighbours at fraction * (n - 1)."""
    return F.percentile(column, F.lit(fraction))


def percentile_disc(fraction: float, column: str) -> Column:
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{column}`)")


def analyze(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: rows, nulls, distinct values, smallest and largest as text, and the share of distinct values. One pass for all columns.

    Exact distinct counts shuffle each column's values; for wide or very large tables ``exact=False`` takes sketches.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    measures = []
    for i, c in enumerate(df.columns):
        column = F.col(f"`{c}`")
        measures += [F.count_if(column.isNull()).alias(f"n{i}"), distinct(column).alias(f"d{i}"), F.min(column).cast("string").alias(f"a{i}"), F.max(column).cast("string").alias(f"z{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *measures)
    each = [
        F.struct(F.lit(c).alias("column_name"), F.col("total").alias("row_count"), F.col(f"n{i}").alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"))
        for i, c in enumerate(df.columns)
    ]
    long = wide.select(F.explode(F.array(*each)).alias("s")).select("s.*")
    return long.withColumn("selectivity", F.coalesce(F.round(F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count")), 4), F.lit(0.0)))
