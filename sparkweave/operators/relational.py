"""Joins, set operations, ordering and deduplication with the dialect's meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOIN_KINDS = ("inner", "left", "right", "full", "cross", "left_semi", "left_anti")


def order(column: str | Column, descending: bool = False, nulls: str | None = None) -> Column:
    """A sort key: NULLs last when ascending, first when descending, unless ``nulls`` says first or last."""
    column = F.col(column) if isinstance(column, str) else column
    nulls = nulls or ("first" if descending else "last")
    return getattr(column, f"{'desc' if descending else 'asc'}_nulls_{nulls}")()


def top(df: DataFrame, keys: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET, which Spark plans as a top-n without a full sort."""
    sorted_ = df.orderBy(*keys)
    return (sorted_.offset(offset) if offset else sorted_).limit(limit)


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], kind: str = "inner", null_safe: bool = False) -> DataFrame:
    """An equality join on pairs of (left column, right column). Spark picks the strategy from sizes and re-plans skewed keys; no side is forced to be broadcast.

    ``null_safe``: NULL keys match each other.
    """
    if kind not in JOIN_KINDS:
        raise ValueError(f"kind must be one of {JOIN_KINDS}")
    if kind == "cross":
        return left.crossJoin(right)
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
    condition = tests[0]
    for t in tests[1:]:
        condition = condition & t
    return left.join(right, condition, kind)


def natural_join(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    """An inner join on all columns of the same name, of which both copies are kept, the right one with a suffix; without any, a cross join."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({c: c + suffix for c in common})
    return join(left, renamed, [(c, c + suffix) for c in common])


def in_subquery(df: DataFrame, column: str, query: DataFrame, negated: bool = False) -> DataFrame:
    """IN and NOT IN over a one-column query; a NULL is in no query, and passes NOT IN."""
    (name,) = query.columns
    values = query.select(F.col(name).alias("__value")).where("__value IS NOT NULL")
    return df.join(values, df[column] == values["__value"], "left_anti" if negated else "left_semi")


def exists(df: DataFrame, query: DataFrame, negated: bool = False) -> DataFrame:
    """EXISTS of an uncorrelated query: all rows or none, decided by one row of the query."""
    one = query.limit(1).agg(F.count(F.lit(1)).alias("__n"))
    return df.crossJoin(F.broadcast(one)).where(F.col("__n") == 0 if negated else F.col("__n") > 0).drop("__n")


def distinct_on(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. A struct's minimum can't follow any order, so this is a window over the key."""
    first = Window.partitionBy(*keys).orderBy(*ordering)
    return df.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """union, union all, intersect, intersect all, except, except all, by position; NULLs are equal."""
    operations = {
        "union": lambda: left.union(right).distinct(),
        "union all": lambda: left.unionAll(right),
        "intersect": lambda: left.intersect(right),
        "intersect all": lambda: left.intersectAll(right),
        "except": lambda: left.subtract(right),
        "except all": lambda: left.exceptAll(right),
    }
    if kind not in operations:
        raise ValueError(f"kind must be one of {sorted(operations)}")
    return operations[kind]()
