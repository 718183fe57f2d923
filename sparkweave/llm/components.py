"""Connected components by alternating stars, with every step a distributed join or aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.storage import discard, written


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (src > dst)."""
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    own = least.where("m < src").select("src", F.col("m").alias("dst"))
    large = large.union(own).where("src != dst").distinct()
    below = large.groupBy("src").agg(F.min("dst").alias("m"))
    small = large.join(below, "src").where("dst != m").select(F.greatest("dst", "m").alias("src"), F.least("dst", "m").alias("dst"))
    return small.union(below.select("src", F.col("m").alias("dst"))).where("src != dst").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of ``links`` (src, dst): label is the smallest node of its component.

    Links that touch a null and loops count as none. Steps repeat until every node but a component's smallest links to
    exactly that smallest; each step's links are written to the shared folder before the next begins.
    """
    tidy = links.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    current = written(tidy.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    most = current.count()  # steps make about as many links as there were, or fewer
    for _ in range(max_rounds):
        following = written(_stars(current), "links", rows=most)
        moved = following.exceptAll(current).limit(1).count() or current.exceptAll(following).limit(1).count()
        discard(current)
        current = following
        if not moved:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
            )
    raise RuntimeError(f"components() did not settle in {max_rounds} rounds")
