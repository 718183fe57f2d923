"""Nearest neighbours by exact distance, and what builds on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.vectors import METRICS, MISMATCH, distance, literal, norm


def with_distance(df: DataFrame, column: str, query: Sequence[float], metric: str = "cosine", name: str = "distance") -> DataFrame:
    return df.withColumn(name, distance(F.col(column), query, metric))


def nearest(df: DataFrame, column: str, query: Sequence[float] | Column, k: int, metric: str = "cosine", where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest rows, of those that pass ``where``. Filters come before distances, and each task keeps k rows of its own."""
    rows = df if where is None else df.where(where)
    scored = rows.withColumn("distance", distance(F.col(column), query, metric)).where("distance IS NOT NULL")
    return scored.orderBy("distance", key).limit(k)


#: Most values (queries times dimensions) that a set of queries may have to be handed to every task.
MOST_QUERY_VALUES = 1 << 24


#: Rows and queries whose distances are bounded at once, and pairs whose distances are taken at once.
ROWS, QUERIES, PAIRS = 2048, 1024, 1 << 17
#: Fixed value: how much of a bound is left for its rounding, in units of the dimensions.
SLACK = 16 * np.finfo(float).eps


def _asked(queries: DataFrame, query_key: str, query_column: str) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], pa.Array, int]:
    """Vectors of a stated set of queries by their length, with their places, and their keys. Null vectors are left out."""
    held = queries.where(F.col(query_column).isNotNull())
    sizes = held.agg(F.coalesce(F.sum(F.size(query_column)), F.lit(0))).first()[0]
    if sizes > MOST_QUERY_VALUES:
        raise ValueError(f"{sizes} values of queries are more than {MOST_QUERY_VALUES}; ask in several sets")
    asked = held.select(query_key, F.col(query_column).cast("array<double>").alias("q")).toArrow()
    names, lists = (pa.chunked_array(asked.column(c).chunks, asked.schema.field(c).type).combine_chunks() for c in (query_key, "q"))
    return _by_length(lists), names, len(names)


def _by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Matrices of vectors without nulls, with the places of their rows, by length; missing values are NaN."""
    lengths = lists.value_lengths().to_numpy().astype(np.int64)
    values, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(lengths) - lengths
    found = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        found[int(n)] = (at, values[starts[at][:, None] + np.arange(n)])
    return found


def _squares(matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", matrix, matrix)


def _bounds(metric: str, rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs, what their distance (its square, for l2) is near to, by one product of matrices, and how far it may be off; NaN where nothing can be said."""
    dots = rows @ queries.T
    slack = SLACK * (rows.shape[1] + 4)
    squares, others = _squares(rows)[:, None], _squares(queries)[None, :]
    if metric == "l2":
        both = squares + others
        return both - 2 * dots, slack * both + np.finfo(float).tiny
    lengths = np.sqrt(squares) * np.sqrt(others)
    if metric == "dot":
        return -dots, slack * lengths + np.finfo(float).tiny
    # Products of lengths that are next to nothing have lost their digits.
    return 1 - np.divide(dots, lengths, out=np.full_like(dots, np.nan), where=lengths > 1e-200), np.array(slack)


def _bound(metric: str, gap: float | np.ndarray) -> float | np.ndarray:
    """A distance as _bounds() has it, and a little more."""
    gap = np.asarray(gap, float)
    wide = gap + np.abs(gap) * 1e-12 + np.finfo(float).tiny
    return np.where(gap < 0, -1.0, wide * wide) if metric == "l2" else wide


def _gaps(metric: str, rows: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of pairs, summed dimension by dimension as the expressions of functions.vectors sum them; NaN where there is none. For l2 by differences, not the expanded
    square, which loses digits for near vectors."""
    found = []
    left, right = np.ascontiguousarray(rows.T), np.ascontiguousarray(queries.T)
    summed = lambda pairs, n: sum(pairs, start=np.zeros(n))
    if metric == "cosine":
        lengths = np.sqrt(summed((x * x for x in left), len(rows))), np.sqrt(summed((x * x for x in right), len(queries)))
    for i in range(0, len(row), PAIRS):
        r, q = row[i : i + PAIRS], query[i : i + PAIRS]
        if metric == "l2":
            found.append(np.sqrt(summed(((x[r] - y[q]) ** 2 for x, y in zip(left, right, strict=True)), len(r))))
            continue
        dots = summed((x[r] * y[q] for x, y in zip(left, right, strict=True)), len(r))
        if metric == "cosine":
            product = lengths[0][r] * lengths[1][q]
            dots = 1 - np.divide(dots, product, out=np.full_like(dots, np.nan), where=product != 0)
        found.append(dots if metric == "cosine" else -dots)
    return np.concatenate(found) if found else np.zeros(0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Keys of a few rows (k, v), and their vectors by length; rows without a vector are left out."""
    for big in batches:
        for batch in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
            batch = batch.filter(batch.column("v").is_valid())
            if batch.num_rows:
                yield batch.column("k"), _by_length(batch.column("v"))


def _pairs(df: DataFrame, column: str, key: str, queries: DataFrame, query_key: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    kinds = T.StructType([T.StructField("q", queries.schema[query_key].dataType), T.StructField("k", df.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    found = df.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, kinds)
    return found.select(F.col("q").alias(query_key), F.col("k").alias(key), "distance")


def within(df: DataFrame, column: str, queries: DataFrame, threshold: float, metric: str = "cosine", key: str = "vec_id", query_key: str = "query_id", query_column: str = "query") -> DataFrame:
    """(query_key, key, distance): the rows at most ``threshold`` from each of a stated set of queries whose size is checked. Every pair is looked at, by products of matrices of a
    bounded size; those that may be near enough have their distance taken in full. Null vectors and those of another
    length than a query's are no neighbours, whatever the threshold."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    shared = df.sparkSession.sparkContext.broadcast(_asked(queries, query_key, query_column)[:2])
    limit = _bound(metric, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, names = shared.value
        for keys, vectors in _blocks(batches):
            for n, (here, rows) in vectors.items():
                at, matrix = matrices.get(n, (np.zeros(0, int), np.zeros((0, n))))
                for i in range(0, len(at), QUERIES):
                    part = matrix[i : i + QUERIES]
                    near, off = _bounds(metric, rows, part)
                    row, query = np.nonzero(~(near - off > limit))
                    gaps = _gaps(metric, rows, part, row, query)
                    kept = np.flatnonzero(gaps <= threshold)
                    for j in range(0, len(kept), PAIRS):
                        some = kept[j : j + PAIRS]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at[i + query[some]])), keys.take(pa.array(here[row[some]])), pa.array(gaps[some])], names=["q", "k", "distance"])

    return _pairs(df, column, key, queries, query_key, run)


def nearest_to_each(df: DataFrame, column: str, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", query_key: str = "query_id", query_column: str = "query") -> DataFrame:
    """The k nearest rows of each query. The queries are a stated set whose size is checked; they go to all tasks, which bound the distances of a few rows from a few queries as one
    product of matrices, take in full those that may be among the k nearest, and hand on k rows for each query at their end (Spark limits the groups of a row_number below its
    exchange). Rows of another length than a query's come last, at the distance that stands for that; null vectors are left out."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    shared = df.sparkSession.sparkContext.broadcast(_asked(queries, query_key, query_column))
    most = max(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, names, count = shared.value
        limits = np.full(count, np.inf)
        held: list[pa.Table] = []
        waiting = 0

        def best() -> pa.Table:
            """The k nearest of those held, for each query; of equal distances the smaller keys."""
            every = pa.concat_tables(held).combine_chunks()
            every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("distance", "ascending"), ("k", "ascending")], null_placement="at_start"))
            query = every.column("q").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            last = np.flatnonzero(rank == most - 1)
            limits[query[last]] = np.minimum(limits[query[last]], _bound(metric, every.column("distance").to_numpy()[last]))
            return every.take(pa.array(np.flatnonzero(rank < most)))

        def hold(query: np.ndarray, found: pa.Array, gaps: np.ndarray) -> None:
            nonlocal held, waiting
            held.append(pa.table({"q": pa.array(query), "distance": pa.array(gaps), "k": found}))
            waiting += len(gaps)
            if waiting > max(4 * most * count, PAIRS):
                held, waiting = [best()], 0

        for keys, vectors in _blocks(batches):
            for n, (at, matrix) in matrices.items():
                here, rows = vectors.get(n, (np.zeros(0, int), np.zeros((0, n))))
                for i in range(0, len(at), QUERIES) if len(here) else ():
                    part, places = matrix[i : i + QUERIES], at[i : i + QUERIES]
                    near, off = _bounds(metric, rows, part)
                    if len(rows) >= most and np.isinf(limits[places]).any():
                        far = np.where(np.isnan(near), np.inf, near + off)
                        limits[places] = np.minimum(limits[places], np.partition(far, most - 1, axis=0)[most - 1])
                    row, query = np.nonzero(~(near - off > limits[places][None, :]))
                    gaps = _gaps(metric, rows, part, row, query)
                    kept = np.flatnonzero(~np.isnan(gaps))
                    if len(kept):
                        hold(places[query[kept]], keys.take(pa.array(here[row[kept]])), gaps[kept])
                others = np.concatenate([np.zeros(0, int), *[rest for m, (rest, _) in vectors.items() if m != n]])
                open_to = at[limits[at] >= MISMATCH if metric != "l2" else limits[at] >= _bound(metric, MISMATCH)] if len(others) else at[:0]
                if len(open_to):
                    # All of these are equally far, so the smaller keys decide.
                    found = keys.take(pa.array(others))
                    found = found.take(pc.sort_indices(found, null_placement="at_start")[:most])
                    hold(np.repeat(open_to, len(found)), pa.concat_arrays([found] * len(open_to)), np.full(len(open_to) * len(found), MISMATCH))
        if held:
            for batch in best().to_batches(max_chunksize=PAIRS):
                yield pa.RecordBatch.from_arrays([names.take(batch.column("q")), batch.column("k"), batch.column("distance")], names=["q", "k", "distance"])

    ranked = Window.partitionBy(query_key).orderBy("distance", key)
    scored = _pairs(df, column, key, queries, query_key, run)
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(query_key, key, "distance", "rank")


def mean_vector(df: DataFrame, column: str) -> DataFrame:
    """One row with the mean of the vectors, dimension by dimension."""
    each = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))


def recommend(df: DataFrame, column: str, positive: DataFrame, negative: DataFrame | None, k: int, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """The k nearest to the mean of liked vectors less the mean of disliked ones, brought to length 1."""
    target = mean_vector(positive, column).withColumnRenamed("mean", "__p")
    if negative is not None:
        target = target.crossJoin(mean_vector(negative, column).withColumnRenamed("mean", "__n"))
        target = target.withColumn("__p", F.when(F.size("__n") > 0, F.zip_with("__p", "__n", lambda a, b: a - b)).otherwise(F.col("__p")))
    length = norm(F.col("__p"))
    # Fixed value: shorter vectors stay as they are.
    target = target.select(F.when(length > 1e-10, F.transform("__p", lambda x: x / length)).otherwise(F.col("__p")).alias("__q"))
    scored = df.crossJoin(F.broadcast(target)).withColumn("distance", distance(F.col(column), F.col("__q"), metric)).drop("__q")
    return scored.where("distance IS NOT NULL").orderBy("distance", key).limit(k)


def discover(df: DataFrame, column: str, target: Sequence[float], context: Sequence[tuple[Sequence[float], Sequence[float]]], k: int, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """Of the 4k nearest to the target, the k with the best score: less distance, and for each (liked, disliked) pair the more the nearer the liked one is."""
    near = nearest(df, column, target, 4 * k, metric, key=key)
    score = -F.col("distance")
    for liked, disliked in context:
        gap = distance(F.col(column), disliked, metric) - distance(F.col(column), liked, metric)
        score = score + 1 / (1 + F.exp(-gap))
    return near.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(k)


def quantization(df: DataFrame, column: str) -> DataFrame:
    """One row: per dimension the smallest and largest value, one apart where they are equal."""
    each = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))
    # Fixed value: a range of less than a 32-bit epsilon counts as none.
    each = each.withColumn("hi", F.when(F.abs(F.col("hi") - F.col("lo")) <= 1.1920929e-07, F.col("lo") + 1).otherwise(F.col("hi")))
    rows = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))
    return each.agg(F.transform(rows, lambda x: x["lo"]).alias("lo"), F.transform(rows, lambda x: x["hi"]).alias("hi"))


def quantize(df: DataFrame, column: str, params: DataFrame) -> DataFrame:
    """Adds ``codes``: 0 to 255 per dimension, by the parameters of quantization()."""
    wide = df.crossJoin(F.broadcast(params))
    unit = F.zip_with(F.zip_with(column, "lo", lambda v, lo: v.cast("double") - lo), F.zip_with("hi", "lo", lambda hi, lo: hi - lo), lambda d, w: F.least(F.greatest(d / w, F.lit(0.0)), F.lit(1.0)))
    return wide.withColumn("codes", F.transform(unit, lambda u: F.floor(u * 255 + 0.5).cast("int"))).drop("lo", "hi")


def dequantize(codes: Column, lo: Column, hi: Column) -> Column:
    return F.zip_with(F.zip_with(codes, F.zip_with(hi, lo, lambda h, low: h - low), lambda q, w: q / 255.0 * w), lo, lambda d, low: low + d)


__all__ = ["dequantize", "discover", "literal", "mean_vector", "nearest", "nearest_to_each", "quantization", "quantize", "recommend", "with_distance", "within"]
