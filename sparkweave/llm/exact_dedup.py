"""Exact deduplication by a tree of merges over sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.columns import ascii_lower, pick
from sparkweave.llm.storage import written


def _sorted_run(rows: DataFrame, parts: int) -> DataFrame:
    """Lays each run out in slices of the digest's range and sorts every slice."""
    return rows.repartition(parts, "run", "slice").sortWithinPartitions("run", "slice", "digest", "check")


def exact_dedup(docs: DataFrame, keep: str = "min", fan_in: int = 8, runs: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its group of equal texts stays.

    Method. Each document gets a digest (SHA-256 of the text, A-Z lower-cased) and an independent check
    (xxHash64 of the same text and its length in bytes); texts count as equal when digest and check both agree, so
    every merge verifies what it joins. Rows are dealt into ``runs`` runs by identifier. A run is a sorted list of distinct
    digests with the identifier that stays and the group's size so far. In each round, ``fan_in`` neighbouring runs
    exchange their slices and merge, down to one run after log(runs) rounds. Winners then go back to the rows
    through the first-level runs, so a digest that a third of all rows share meets each run once and no task
    ever holds all rows of a group.

    ``keep``: "min" or "max", the identifier that stays. Results: doc_id, keep_id, group_size, kept, text_sha256, and the row's own
    columns that ``carry`` names.

    Defined cases: a null text counts as empty; a null doc_id is chosen only where the group has no other, and
    keep_id is null then; rows with the same doc_id and text count one by one in group_size, and exactly one row of
    every group is kept. An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs or parts
    best = {"min": F.min, "max": F.max}[keep]
    last = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = pick(docs, *dict.fromkeys(("doc_id", "text", *carry))).select("doc_id", text.alias("t"), F.monotonically_increasing_id().alias("row"), *carried)
    rows = rows.select(
        "doc_id",
        "row",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t", F.octet_length("t")).alias("check"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.lit(runs)).cast("int").alias("run"),
        *["carried"] * bool(carry),
    ).withColumn("slice", F.hex(F.substring("digest", 1, 2)))
    rows = written(rows, "dedup-rows")

    candidate = F.struct(last.alias("last"), "doc_id", "row")
    first = rows.groupBy("run", "slice", "digest", "check").agg(best(candidate).alias("winner"), F.count(F.lit(1)).alias("size"))
    level = first
    for _ in range(math.ceil(math.log(max(runs, 2), fan_in) - 1e-9)):
        parents = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = _sorted_run(parents, parts).groupBy("run", "slice", "digest", "check").agg(best("winner").alias("winner"), F.sum("size").alias("size"))
    merged = level.select("digest", "check", "winner", "size")
    by_run = first.select("run", "digest", "check").join(merged, ["digest", "check"])
    return rows.join(by_run, ["run", "digest", "check"]).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *["carried.*"] * bool(carry),
    )
