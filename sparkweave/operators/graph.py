"""Graphs as tables: vertices (id, ...) and edges (src, dst, ...). Traversals go round by round with joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.scratch import scratch

DIRECTIONS = ("out", "in", "both")


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) in the direction of travel."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionAll(back)}[direction]()


def _kept(df: DataFrame) -> DataFrame:
    """Writes a round's rows to the shared folder, so that plans don't grow from round to round and a lost executor costs one round."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_source(steps: DataFrame) -> DataFrame:
    """The edges of a traversal, without repetitions, written once and sorted by where they begin, so that a round reads the row groups of its vertices and shuffles no more than it needs."""
    return _kept(steps.sortWithinPartitions("src"))


def neighbors(edges: DataFrame, vertex: int, direction: str = "out") -> DataFrame:
    return _oriented(edges, direction).where(F.col("src") == vertex).select(F.col("dst").alias("id")).distinct()


def bfs(edges: DataFrame, start: int, max_depth: int, direction: str = "out", allow: Callable[[Column], Column] | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(id, depth): least number of edges from the start, which is there at depth 0. ``allow`` names the vertices, by a test on the columns of
    ``vertices``, that are kept and gone on from; the others are visited and dropped."""
    spark = edges.sparkSession
    steps = _oriented(edges, direction).distinct()
    passing = None
    if allow is not None and vertices is not None:
        passing = vertices.where(allow(F.col("id"))).select("id")
        steps = steps.join(passing.withColumnRenamed("id", "dst"), "dst", "left_semi")
    steps = _by_source(steps)
    frontier = seen = spark.createDataFrame([(start, 0)], "id long, depth int")
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = _kept(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen if passing is None else seen.join(passing, "id", "left_semi")


def k_hop(edges: DataFrame, start: int, hops: int, direction: str = "out") -> DataFrame:
    return bfs(edges, start, hops, direction).where(F.col("id") != start)


def shortest_path(edges: DataFrame, start: int, end: int, max_depth: int) -> DataFrame:
    """One row with the vertices of a path with the fewest edges, the smallest of equal ones; none if there is no path."""
    spark = edges.sparkSession
    steps = _by_source(edges.select("src", "dst").distinct())
    frontier = spark.createDataFrame([(start, [start])], "id long, path array<bigint>")
    found, seen = frontier, frontier.select("id")
    for _ in range(max_depth):
        if not frontier.where(F.col("id") == end).isEmpty():
            break
        longer = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        best = longer.groupBy("id").agg(F.min("path").alias("path"))
        frontier = _kept(best.join(seen, "id", "left_anti"))
        found, seen = found.unionAll(frontier), seen.unionAll(frontier.select("id"))
    return found.where(F.col("id") == end).select("path", (F.size("path") - 1).alias("length"))


def weighted_path(edges: DataFrame, start: int, end: int, max_depth: int, weight: Column | None = None) -> DataFrame:
    """One row with the cheapest path of at most ``max_depth`` edges; weights that are missing or no numbers are 1."""
    spark = edges.sparkSession
    cost = F.lit(1.0) if weight is None else F.coalesce(weight.try_cast("double"), F.lit(1.0))
    steps = _by_source(edges.select("src", "dst", cost.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = spark.createDataFrame([(start, 0.0, [start])], "id long, cost double, path array<bigint>")
    for _ in range(max_depth):
        longer = best.join(steps, best["id"] == steps["src"]).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        every = best.unionAll(longer)
        best = _kept(every.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b")).select("id", "b.cost", "b.path"))
    return best.where(F.col("id") == end).select("cost", "path")


def degrees(vertices: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, out_degree, in_degree) of every vertex, those with most edges first."""
    sides = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = sides.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    every = vertices.select("id").join(counts, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    ordered = every.orderBy((F.col("out_degree") + F.col("in_degree")).desc(), "id")
    return every if limit is None else ordered.limit(limit)


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 10, limit: int | None = None, every: int = 5) -> DataFrame:
    """(id, rank) after synchronous rounds; parallel edges count, and what vertices without edges hold is lost."""
    ids = vertices.select("id")
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    outward = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    steps = _by_source(edges.join(outward, "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.first("out")).alias("share")))
    ranks = ids.crossJoin(F.broadcast(total)).select("id", (F.lit(1.0) / F.col("total")).alias("rank"))
    for n in range(1, rounds + 1):
        given = ranks.join(steps, ranks["id"] == steps["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = (
            ids.join(given, ids["id"] == given["dst"], "left")
            .crossJoin(F.broadcast(total))
            .select("id", ((1 - damping) / F.col("total") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        )
        if n % every == 0 and n < rounds:
            ranks = _kept(ranks)
    return ranks if limit is None else ranks.orderBy(F.col("rank").desc(), "id").limit(limit)


def add_edges(vertices: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones whose two ends exist; parallel edges are allowed."""
    known = vertices.select("id")
    valid = new.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(valid)


def delete_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices (id) and the edges that touch them."""
    rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), rest
