"""Geo sets: members with longitude and latitude, searched by circle or box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.geo import SET_RADIUS, UNITS, geohash, haversine, within

# Fixed value: the latitude at which a square map ends.
MAX_LATITUDE = 85.05112878


def search(members: DataFrame, lng: float, lat: float, radius: float, unit: str = "m", count: int | None = None) -> DataFrame:
    """Members in a circle by distance, in the unit of the radius. A box that scans can push down comes first."""
    scale = UNITS[unit]
    hit = members.where(within(F.col("lat"), F.col("lng"), lat, lng, radius * scale, SET_RADIUS))
    ordered = hit.withColumn("distance", haversine(lat, lng, F.col("lat"), F.col("lng")) / scale).orderBy("distance", "member")
    return ordered if count is None else ordered.limit(count)


def search_box(members: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float, count: int | None = None) -> DataFrame:
    """Members in a box, edges included, by longitude."""
    ordered = members.where(F.col("lng").between(min_lng, max_lng) & F.col("lat").between(min_lat, max_lat)).orderBy("lng", "member")
    return ordered if count is None else ordered.limit(count)


def fence(members: DataFrame, names: DataFrame, lng: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """For each name whether it lies in a circle; NULL if there is no such member."""
    found = names.select("member").join(members, "member", "left")
    inside = haversine(lat, lng, F.col("lat"), F.col("lng")) <= radius * UNITS[unit]
    return found.select("member", F.when(F.col("lat").isNotNull(), inside).alias("inside"))


def distances(members: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """The distance of each pair (a, b) of names."""
    one = members.select(F.col("member").alias("a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"))
    two = members.select(F.col("member").alias("b"), F.col("lng").alias("lng_b"), F.col("lat").alias("lat_b"))
    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", (haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) / UNITS[unit]).alias("distance"))


def hashes(members: DataFrame, length: int = 11) -> DataFrame:
    return members.withColumn("geohash", geohash(F.col("lat"), F.col("lng"), length))


def add(members: DataFrame, new: DataFrame, mode: str = "any") -> DataFrame:
    """The set with members added or moved: any, only new ones ("nx"), or only ones that exist ("xx"). Points beyond the latitudes that a square map has are left out.
    Of several points for one member the last stays, with "nx" the first, by a column "seq" or else in the order of the rows."""
    valid = new.where((F.abs("lat") <= MAX_LATITUDE) & (F.abs("lng") <= 180))
    valid = valid if "seq" in valid.columns else valid.withColumn("seq", F.monotonically_increasing_id())
    choose = F.min_by if mode == "nx" else F.max_by
    fresh = valid.groupBy("member").agg(choose(F.struct("lng", "lat"), F.col("seq")).alias("fresh"))
    both = members.select("member", F.struct("lng", "lat").alias("old")).join(fresh, "member", "full")
    choice = {"any": F.coalesce("fresh", "old"), "nx": F.coalesce("old", "fresh"), "xx": F.when(F.col("old").isNotNull(), F.coalesce("fresh", "old"))}[mode]
    return both.withColumn("point", choice).where("point IS NOT NULL").select("member", "point.lng", "point.lat")


def changed(members: DataFrame, new: DataFrame, mode: str = "any") -> DataFrame:
    """One row: how many members an add() adds or moves."""
    after = add(members, new, mode).select("member", "lng", "lat")
    return after.exceptAll(members.select("member", "lng", "lat")).agg(F.count(F.lit(1)).alias("changed"))


def store(result: DataFrame, path: str) -> None:
    """Writes the members that a search found as a set, over the one that is there."""
    result.select("member", "lng", "lat").write.mode("overwrite").parquet(path)


def remove(members: DataFrame, names: DataFrame) -> DataFrame:
    return members.join(names.select("member"), "member", "left_anti")
