"""Window functions of the dialect, where they differ from Spark's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ntile(buckets: int, partition: Sequence[str], ordering: Sequence[Column]) -> Column:
    """floor(i * k / n) + 1 for the row at i of n, which may differ from the standard's."""
    group = Window.partitionBy(*partition)
    return F.floor((F.row_number().over(group.orderBy(*ordering)) - 1) * buckets / F.count(F.lit(1)).over(group)).cast("int") + 1


def aggregate_over(measure: Column, partition: Sequence[str], ordering: Sequence[Column] = (), frame: str = "running") -> Column:
    """An aggregate over a partition: up to the current row and its peers if there is an order, or over all of it (frame "partition")."""
    spec: WindowSpec = Window.partitionBy(*partition)
    if ordering and frame == "running":
        spec = spec.orderBy(*ordering).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return measure.over(spec)


def average_of_rows(column: Column, partition: Sequence[str]) -> Column:
    """The sum over a partition by the number of all its rows, those with NULL too."""
    group = Window.partitionBy(*partition)
    return F.sum(column).over(group) / F.count(F.lit(1)).over(group)
