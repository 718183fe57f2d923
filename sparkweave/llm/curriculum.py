"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.columns import pick, word_count
from sparkweave.llm.storage import written

#: Slope of the weight schedule of the first, second and third source in turn; see mix_sources().
SLOPES = (0.6, 0.0, -0.6)


def source_targets(sized: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """One row per source: source_size, weight, rank, target.

    Targets share the total size by weight; a target stops at ``max_repeats`` times the size of its source, and what is
    over goes to the others by weight until none is above. With the sources sorted by cap over weight, the level that all
    uncapped targets share per unit of weight is the largest of (total - caps before) / (weights from here on).
    The windows run over one row per source, never over documents.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The default string order of Spark is that of UTF-8 bytes, which is the order of code points.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onwards = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    levels = capped.withColumn("level", (total - before) / onwards)
    return levels.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight"))).select("source", "source_size", "weight", "rank", "target")


def _inverse_demand(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] by which a source has met ``share`` of its demand.

    The schedule is w(t) = 1 + slope * (1 - 2t), so the integrated demand is D(t) = (1 + slope) * t - slope * t^2 with D(1) = 1.
    """
    b = 1 + slope
    root = F.sqrt(F.greatest(b * b - 4 * slope * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, share).otherwise(2 * share / (b + root))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: float = 3,
    slopes: Sequence[float] = SLOPES,
    rows_per_bucket: int = 1000,
    buckets_per_stretch: int = 1000,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by training position.

    Method. Every source's weight follows a schedule over training time; integrating it gives the source's cumulative token
    demand, scaled so that it ends at the source's target. A source is read pass after pass in an order fixed by a
    digest of doc_id, and each read begins at the time at which the inverted demand reaches the
    words read before it. Cumulative sums go by (source, bucket of the digest), first over stretches of buckets, then over the buckets of a stretch and then within a bucket, so
    a source with a third of all rows spreads over as many tasks as its rows need.

    Results: doc_id, source, size (words), source_size, target, taken (words that the mix takes, repeats counted; the last
    document that a source reaches is taken in part), copies (passes that take any of it), positions (one time in [0, 1)
    for each), position (the first; null where the mix takes nothing, sorted last), and the row's own columns that ``carry`` names.

    Defined cases: a null text has no words and is never taken; a null source is a source of its own, ranked last; rows that
    repeat a doc_id are separate reads; a null doc_id is read like any other, its text's digest giving the order. Ties
    of the digest fall back to doc_id and size, so reruns agree. An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    sized = pick(docs, *dict.fromkeys(("doc_id", "text", "source", *carry))).select("doc_id", "source", size.alias("size"), key.alias("key"), *carried)
    sized = written(sized, "mix-sized")
    buckets = max(1, -(-sized.count() // rows_per_bucket))
    sized = sized.withColumn("bucket", F.shiftright(F.col("key") * buckets, 32))

    # Prefix sums go over stretches of buckets first and then within each, so that a hot source's buckets don't meet in one task.
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("stretch", F.floor(F.col("bucket") / buckets_per_stretch))
    per_stretch = per_bucket.groupBy(F.col("source").alias("of_source"), F.col("stretch").alias("of_stretch")).agg(F.sum("in_bucket").alias("in_stretch"))
    per_stretch = per_stretch.withColumn("before_stretch", F.coalesce(F.sum("in_stretch").over(earlier("of_source", by="of_stretch")), F.lit(0)))
    per_bucket = per_bucket.withColumn("in_order", F.coalesce(F.sum("in_bucket").over(earlier("source", "stretch", by="bucket")), F.lit(0)))
    per_bucket = per_bucket.join(per_stretch, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("stretch") == F.col("of_stretch")))
    per_bucket = per_bucket.select("source", "bucket", (F.col("before_stretch") + F.col("in_order")).alias("before_bucket"))
    targets = source_targets(sized, weights, max_repeats)
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    right = targets.withColumn("slope", slope).withColumnRenamed("source", "of_source")
    frame = per_bucket.join(right, F.col("source").eqNullSafe(F.col("of_source"))).select(
        F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), "before_bucket", "source_size", "target", "slope"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        frame, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    )
    start = F.col("before_bucket") + F.col("inside")
    demand = F.round("target").cast("long")
    passes = F.ceil(F.col("demand") / F.greatest("source_size", F.lit(1))).cast("int")
    of_pass = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - p * F.col("source_size") - F.col("start")))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "slope", start.alias("start"), demand.alias("demand"), *["carried"] * bool(carry))
    reads = F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))
    placed = placed.withColumn("reads", F.filter(reads, lambda p: of_pass(p) > 0))
    share = lambda p: (p * F.col("source_size") + F.col("start")) / F.col("target")
    mixed = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("reads", F.lit(0).cast("long"), lambda taken, p: taken + of_pass(p)).alias("taken"),
        F.size("reads").alias("copies"),
        F.transform("reads", lambda p: _inverse_demand(share(p), F.col("slope"))).alias("positions"),
        *["carried"] * bool(carry),
    )
    position = F.when(F.col("copies") > 0, F.element_at("positions", 1))
    mixed = mixed.withColumn("position", position).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return mixed.select(*[c for c in mixed.columns if c != "carried"], "carried.*") if carry else mixed
