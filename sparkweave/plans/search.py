"""Vectors, places, full text, graphs, and what combines them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import geo as G
from sparkweave.functions.vectors import distance
from sparkweave.operators import fulltext, fusion, geosets, graph, nearest
from sparkweave.plans.registry import register
from sparkweave.scratch import scratch
from sparkweave.tables import table

# ---------------------------------------------------------------- vectors

DIMENSIONS = 64


def _query(n: int) -> list[float]:
    """A fixed query vector, the same in SQL and here."""
    return [((i * n) % 17 - 8) / 8 for i in range(DIMENSIONS)]


def _sql_query(n: int) -> str:
    return "[" + ", ".join(f"{v}" for v in _query(n)) + "]::DOUBLE[]"


_VECTORS = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _sql_distance(metric: str, a: str, b: str) -> str:
    return {"cosine": f"1 - list_cosine_similarity({a}, {b})", "l2": f"list_distance({a}, {b})", "dot": f"-list_inner_product({a}, {b})"}[metric]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _register_metric(metric: str) -> None:
    @register(f"vector_{metric}", f"SELECT vec_id, round({_sql_distance(metric, 'e', _sql_query(5))}, 6) AS distance FROM {_VECTORS}")
    def every(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nearest.with_distance(_vectors(spark, sf_dir), "embedding", _query(5), metric).select("vec_id", F.round("distance", 6).alias("distance"))

    @register(f"vector_nearest_{metric}", f"SELECT vec_id, round({_sql_distance(metric, 'e', _sql_query(3))}, 6) AS distance FROM {_VECTORS} ORDER BY {_sql_distance(metric, 'e', _sql_query(3))}, vec_id LIMIT 10")
    def top(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nearest.nearest(_vectors(spark, sf_dir), "embedding", _query(3), 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))


for _metric in ("cosine", "l2", "dot"):
    _register_metric(_metric)


@register("vector_mismatch", "SELECT vec_id, round(3.4028234663852886e38 / 1e38, 6) AS distance FROM embeddings")
def vector_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.with_distance(_vectors(spark, sf_dir), "embedding", [1.0, 2.0]).select("vec_id", F.round(F.col("distance") / 1e38, 6).alias("distance"))


@register(
    "vector_batch_search",
    f"""
    SELECT query_id, vec_id, round(d, 6) AS distance, rank::INT AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, {_sql_distance("l2", "v.e", "q.e")} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sql_distance("l2", "v.e", "q.e")}, v.vec_id) AS rank
      FROM {_VECTORS} v CROSS JOIN (SELECT * FROM {_VECTORS} WHERE vec_id % 50 = 0) q)
    WHERE rank <= 5
    """,
)
def vector_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = nearest.nearest_to_each(vectors, "embedding", queries, 5, "l2")
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@register("vector_filtered", f"SELECT vec_id, label FROM {_VECTORS} WHERE label IN (1, 2, 3) AND vec_id > 20 ORDER BY {_sql_distance('cosine', 'e', _sql_query(7))}, vec_id LIMIT 12")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_vectors(spark, sf_dir), "embedding", _query(7), 12, where=F.col("label").isin(1, 2, 3) & (F.col("vec_id") > 20)).select("vec_id", "label")


_MEAN = "(SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS m FROM (SELECT e, unnest(range(1, 65)) AS i FROM {v} WHERE {w}) GROUP BY i))"


@register(
    "vector_recommend",
    f"""
    WITH target AS (
      SELECT list_transform(list_zip(p.m, n.m), lambda x: x[1] - x[2]) AS t FROM {_MEAN.format(v=_VECTORS, w="vec_id IN (1, 2, 3)")} p, {_MEAN.format(v=_VECTORS, w="vec_id IN (10, 11)")} n)
    SELECT vec_id, round({_sql_distance("cosine", "e", "t")}, 6) AS distance FROM {_VECTORS}, target ORDER BY {_sql_distance("cosine", "e", "t")}, vec_id LIMIT 10
    """,
)
def vector_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = nearest.recommend(vectors, "embedding", vectors.where("vec_id IN (1, 2, 3)"), vectors.where("vec_id IN (10, 11)"), 10)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@register(
    "vector_discover",
    f"""
    WITH near AS (SELECT *, {_sql_distance("l2", "e", _sql_query(2))} AS d FROM {_VECTORS} ORDER BY d, vec_id LIMIT 40),
    scored AS (SELECT vec_id, -d + 1 / (1 + exp(-({_sql_distance("l2", "e", _sql_query(4))} - {_sql_distance("l2", "e", _sql_query(6))})))
                                 + 1 / (1 + exp(-({_sql_distance("l2", "e", _sql_query(8))} - {_sql_distance("l2", "e", _sql_query(9))}))) AS s FROM near)
    SELECT vec_id, round(s, 6) AS score FROM scored ORDER BY s DESC, vec_id LIMIT 10
    """,
)
def vector_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = [(_query(6), _query(4)), (_query(9), _query(8))]
    return nearest.discover(_vectors(spark, sf_dir), "embedding", _query(2), context, 10, "l2").select("vec_id", F.round("score", 6).alias("score"))


@register(
    "vector_quantize",
    f"""
    WITH each AS (SELECT vec_id, i, e[i] AS v FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM {_VECTORS})),
    params AS (SELECT i, min(v) AS lo, CASE WHEN abs(max(v) - min(v)) <= 1.1920929e-07 THEN min(v) + 1 ELSE max(v) END AS hi FROM each GROUP BY i)
    SELECT vec_id, sum(floor((v - lo) / (hi - lo) * 255 + 0.5))::BIGINT AS code_sum, round(max(abs(lo + floor((v - lo) / (hi - lo) * 255 + 0.5) / 255 * (hi - lo) - v)), 6) AS worst
    FROM each JOIN params USING (i) GROUP BY vec_id
    """,
)
def vector_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    params = nearest.quantization(vectors, "embedding")
    coded = nearest.quantize(vectors, "embedding", params).crossJoin(F.broadcast(params))
    decoded = nearest.dequantize(F.col("codes"), F.col("lo"), F.col("hi"))
    error = F.array_max(F.zip_with(decoded, "embedding", lambda a, b: F.abs(a - b.cast("double"))))
    return coded.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.round(error, 6).alias("worst"))


@register(
    "vector_quantized_nearest",
    f"""
    WITH each AS (SELECT vec_id, i, e[i] AS v FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM {_VECTORS})),
    params AS (SELECT i, min(v) AS lo, CASE WHEN abs(max(v) - min(v)) <= 1.1920929e-07 THEN min(v) + 1 ELSE max(v) END AS hi FROM each GROUP BY i),
    coded AS (SELECT vec_id, i, floor((v - lo) / (hi - lo) * 255 + 0.5) / 255 * (hi - lo) AS c FROM each JOIN params USING (i))
    SELECT a.vec_id, round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 6) AS distance FROM coded a JOIN coded b ON a.i = b.i AND b.vec_id = 0
    GROUP BY a.vec_id ORDER BY sqrt(sum((a.c - b.c) * (a.c - b.c))), a.vec_id LIMIT 10
    """,
)
def vector_quantized_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    params = nearest.quantization(vectors, "embedding")
    coded = nearest.quantize(vectors, "embedding", params).crossJoin(F.broadcast(params)).select("vec_id", nearest.dequantize(F.col("codes"), F.col("lo"), F.col("hi")).alias("c"))
    one = coded.where("vec_id = 0").select(F.col("c").alias("q"))
    scored = coded.crossJoin(F.broadcast(one)).withColumn("distance", distance(F.col("c"), F.col("q"), "l2"))
    return scored.orderBy("distance", "vec_id").limit(10).select("vec_id", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------- places


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at places made from their keys, for the tables have none."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("member"), ((key * 37) % 3600 / 10.0 - 180).alias("lng"), ((key * 53) % 1600 / 10.0 - 80).alias("lat"))


_PLACES = "(SELECT c_custkey AS id, c_name AS member, (c_custkey * 37) % 3600 / 10.0 - 180 AS lng, (c_custkey * 53) % 1600 / 10.0 - 80 AS lat FROM customer)"


def _sql_haversine(lat1: str, lng1: str, lat2: str, lng2: str, radius: float) -> str:
    return f"2 * {radius} * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))))"


_TO_BERLIN = _sql_haversine("52.52", "13.405", "lat", "lng", G.SET_RADIUS)


@register("geo_within", f"SELECT id FROM {_PLACES} WHERE {_sql_haversine('52.52', '13.405', 'lat', 'lng', G.SQL_RADIUS)} <= 3000000")
def geo_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).where(G.within(F.col("lat"), F.col("lng"), 52.52, 13.405, 3_000_000)).select("id")


@register("geo_distance_sorted", f"SELECT id, round({_sql_haversine('52.52', '13.405', 'lat', 'lng', G.SQL_RADIUS)}, 3) AS dist FROM {_PLACES} ORDER BY {_sql_haversine('52.52', '13.405', 'lat', 'lng', G.SQL_RADIUS)}, id LIMIT 20 OFFSET 5")
def geo_distance_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist = G.haversine(52.52, 13.405, F.col("lat"), F.col("lng"), G.SQL_RADIUS)
    return _places(spark, sf_dir).withColumn("dist", dist).orderBy("dist", "id").offset(5).limit(20).select("id", F.round("dist", 3).alias("dist"))


@register("geo_search", f"SELECT member, round({_TO_BERLIN} / 1000, 6) AS distance FROM {_PLACES} WHERE {_TO_BERLIN} <= 2500000 ORDER BY {_TO_BERLIN}, member LIMIT 15")
def geo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.search(_places(spark, sf_dir), 13.405, 52.52, 2500, "km", 15).select("member", F.round("distance", 6).alias("distance"))


_NEAR_DATELINE = _sql_haversine("0", "179.5", "lat", "lng", G.SET_RADIUS)


@register("geo_search_antimeridian", f"SELECT member FROM {_PLACES} WHERE {_NEAR_DATELINE} <= 1609344 * 2")
def geo_search_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.search(_places(spark, sf_dir), 179.5, 0, 2000, "mi").select("member")


@register("geo_search_box", f"SELECT member, lng, lat FROM {_PLACES} WHERE lng BETWEEN -10 AND 40 AND lat BETWEEN 35 AND 70 ORDER BY lng, member LIMIT 25")
def geo_search_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.search_box(_places(spark, sf_dir), -10, 35, 40, 70, 25).select("member", "lng", "lat")


@register("geo_fence", f"SELECT n.member, CASE WHEN lat IS NOT NULL THEN {_TO_BERLIN} <= 4000000 END AS inside FROM (SELECT c_name || CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE '' END AS member FROM customer) n LEFT JOIN {_PLACES} p ON n.member = p.member")
def geo_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, "?").otherwise("")).alias("member"))
    return geosets.fence(_places(spark, sf_dir), names, 13.405, 52.52, 4000, "km")


@register("geo_distance_pairs", f"SELECT a.member AS a, b.member AS b, round(({_sql_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', G.SET_RADIUS)}) / 1609.344, 6) AS distance FROM {_PLACES} a JOIN {_PLACES} b ON b.id = a.id + 1")
def geo_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    follows = places.select((F.col("id") - 1).alias("id"), F.col("member").alias("b"))
    pairs = places.select("id", F.col("member").alias("a")).join(follows, "id").select("a", "b")
    return geosets.distances(places, pairs, "mi").select("a", "b", F.round("distance", 6).alias("distance"))


def _sql_geohash(length: int) -> str:
    bits = 5 * length
    nx, ny = (bits + 1) // 2, bits // 2
    letters = []
    for k in range(length):
        value = " + ".join(f"(({'x' if b % 2 == 0 else 'y'} >> {(nx if b % 2 == 0 else ny) - 1 - b // 2}) & 1) * {1 << (4 - b % 5)}" for b in range(5 * k, 5 * k + 5))
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ({value} + 1)::BIGINT, 1)")
    return f"SELECT member, {' || '.join(letters)} AS geohash FROM (SELECT member, floor((lng + 180) / 360 * {1 << nx})::BIGINT AS x, floor((lat + 90) / 180 * {1 << ny})::BIGINT AS y FROM {_PLACES})"


@register("geo_hash", _sql_geohash(11))
def geo_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.hashes(_places(spark, sf_dir)).select("member", "geohash")


@register("geo_hash_sql", _sql_geohash(12))
def geo_hash_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.hashes(_places(spark, sf_dir), 12).select("member", "geohash")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New places for every second customer, half of them under names that are new; some beyond the map."""
    moved = F.when(F.col("id") % 4 == 0, F.concat("member", F.lit("+"))).otherwise(F.col("member"))
    return _places(spark, sf_dir).where("id % 2 = 0").select(moved.alias("member"), (F.col("lng") / 2).alias("lng"), (F.col("lat") * 1.2).alias("lat"))


_MOVES = f"(SELECT * FROM (SELECT CASE WHEN id % 4 = 0 THEN member || '+' ELSE member END AS member, lng / 2 AS lng, lat * 1.2 AS lat FROM {_PLACES} WHERE id % 2 = 0) WHERE abs(lat) <= 85.05112878)"
_ADDS = {"any": "coalesce(n.{c}, o.{c})", "nx": "coalesce(o.{c}, n.{c})", "xx": "coalesce(n.{c}, o.{c})"}


def _register_add(mode: str) -> None:
    only = " WHERE o.member IS NOT NULL" if mode == "xx" else ""
    pick = ", ".join(f"round({_ADDS[mode].format(c=c)}, 6) AS {c}" for c in ("lng", "lat"))

    @register(f"geo_add_{mode}", f"SELECT coalesce(o.member, n.member) AS member, {pick} FROM {_PLACES} o FULL JOIN {_MOVES} n ON o.member = n.member{only}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        added = geosets.add(_places(spark, sf_dir), _moves(spark, sf_dir), mode)
        return added.select("member", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


for _mode in _ADDS:
    _register_add(_mode)


@register("geo_add_changed", f"SELECT count(*) AS changed FROM {_MOVES} n LEFT JOIN {_PLACES} o ON o.member = n.member WHERE o.member IS NULL OR o.lng <> n.lng OR o.lat <> n.lat")
def geo_add_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geosets.changed(_places(spark, sf_dir), _moves(spark, sf_dir))


@register("geo_position", f"SELECT member, lng, lat FROM {_PLACES} WHERE member IN ('Customer#000000001', 'Customer#000000002') OR id = 3")
def geo_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).where("member IN ('Customer#000000001', 'Customer#000000002') OR id = 3").select("member", "lng", "lat")


# ---------------------------------------------------------------- full text

_STOPS = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOPS}) AND strlen(x) <= 256)"
_INDEX = f"""
WITH split AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
lengths AS (SELECT doc_id, len(tokens) AS dl FROM split),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
each AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(0, len(tokens))) AS position FROM split),
postings AS (SELECT term, doc_id, count(*) AS tf FROM each GROUP BY term, doc_id),
dictionary AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT p.doc_id, p.term, greatest(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
           FROM postings p JOIN dictionary USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats)
"""
_RANKED = "GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT {n}"


_indexes: dict[tuple[str, ...], fulltext.TextIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    """The index of the documents, which the first search of a session writes and later ones read, as long as the files and their times are the same."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in system.listStatus(hadoop)]
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(files))
    if key not in _indexes:
        _indexes[key] = fulltext.TextIndex.build(table(spark, sf_dir, "documents")).written(scratch(spark, "index"))
    return _indexes[key]


def _scores(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


@register("text_tokens", f"SELECT doc_id, len({_TOKENS})::INT AS n, {_TOKENS}[1] AS first, {_TOKENS}[-1] AS last FROM documents")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return table(spark, sf_dir, "documents").select("doc_id", fulltext.tokens(F.col("text")).alias("t")).select("doc_id", F.size(t).alias("n"), F.get(t, F.lit(0)).alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"))


@register("text_search", _INDEX + f"SELECT doc_id, round(sum(score * times), 6) AS score FROM scored JOIN (VALUES ('license', 2), ('released', 1), ('idiot', 1)) q(term, times) USING (term) GROUP BY doc_id ORDER BY sum(score * times) DESC, doc_id LIMIT 10")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).search("License released; the LICENSE idiot", 10))


@register("text_search_all", _INDEX + "SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term IN ('license', 'worthless') GROUP BY doc_id")
def text_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).search("license worthless", None))


@register("text_fuzzy", _INDEX + f"SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE levenshtein(term, 'licence') <= 1 OR levenshtein(term, 'idiots') <= 1 {_RANKED.format(n=20)}")
def text_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).fuzzy("licence idiots", 1, 20))


@register("text_regexp", _INDEX + f"SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE regexp_full_match(term, 'li[a-z]*se|id.ot') {_RANKED.format(n=20)}")
def text_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).regexp("li[a-z]*se|id.ot", 20))


@register("text_wildcard", _INDEX + f"SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term GLOB 'lic?n*' {_RANKED.format(n=20)}")
def text_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).wildcard("Lic?n*", 20))


@register("text_term", _INDEX + f"SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term = 'license' {_RANKED.format(n=15)}")
def text_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).term("License", "text", 15))


@register("text_terms", _INDEX + f"SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term IN ('license', 'clown', 'pathetic') {_RANKED.format(n=15)}")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).terms(["license", "clown", "pathetic"], "text", 15))


@register(
    "text_boolean",
    _INDEX
    + """SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term IN ('mit', 'license', 'idiot')
    AND doc_id IN (SELECT doc_id FROM postings WHERE term = 'mit') AND doc_id IN (SELECT doc_id FROM postings WHERE term = 'license') AND doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'clown')
    GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 20""",
)
def text_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).boolean(["MIT license"], ["idiot"], ["clown"], 20))


@register(
    "text_boolean_should",
    _INDEX + "SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term IN ('idiot', 'clown') AND doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'license') GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 20",
)
def text_boolean_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).boolean((), ["idiot", "clown"], ["license"], 20))


@register(
    "text_phrase",
    _INDEX
    + """SELECT doc_id, round(sum(score), 6) AS score FROM scored WHERE term IN ('released', 'under', 'mit', 'license') AND doc_id IN (
      SELECT a.doc_id FROM each a JOIN each b ON a.doc_id = b.doc_id AND b.position = a.position + 1 JOIN each c ON a.doc_id = c.doc_id AND c.position = a.position + 2 JOIN each d ON a.doc_id = d.doc_id AND d.position = a.position + 3
      WHERE a.term = 'released' AND b.term = 'under' AND c.term = 'mit' AND d.term = 'license') """
    + _RANKED.format(n=10),
)
def text_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_index(spark, sf_dir).phrase("released under the MIT license", 10))


@register(
    "text_multi_field",
    _INDEX
    + """, best AS (SELECT doc_id FROM scored WHERE term IN ('license', 'idiot') GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 30),
    heads AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(split_part(text, chr(10), 1), '[\\p{L}\\p{N}_]+'), lambda x: lower(x)), lambda x: x NOT IN (%s) AND strlen(x) <= 256) AS tokens FROM documents WHERE doc_id IN (SELECT doc_id FROM best)),
    fields AS (SELECT doc_id, 2.0 AS w, len(tokens) AS dl, unnest(tokens) AS term FROM heads UNION ALL SELECT doc_id, 1.0 AS w, len(tokens) AS dl, unnest(tokens) AS term FROM split WHERE doc_id IN (SELECT doc_id FROM best)),
    counted AS (SELECT doc_id, w, dl, term, count(*) AS tf FROM fields WHERE term IN ('license', 'idiot') GROUP BY ALL),
    by_field AS (SELECT doc_id, w, sum(w * greatest(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM counted JOIN dictionary USING (term) CROSS JOIN stats GROUP BY doc_id, w)
    SELECT doc_id, round(max(s), 6) AS score FROM by_field GROUP BY doc_id ORDER BY max(s) DESC, doc_id LIMIT 10"""
    % _STOPS,
)
def text_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("head", F.split_part("text", F.lit("\n"), F.lit(1)))
    return _scores(replace(_index(spark, sf_dir), fields=docs).multi_field("license idiot", {"head": 2.0, "text": 1.0}, 10))


@register("text_suggest", _INDEX + "SELECT term, df AS doc_freq FROM dictionary WHERE starts_with(term, 'lic') OR starts_with(term, 'lic') ORDER BY df DESC, term LIMIT 10")
def text_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).suggest("Lic", 10)


@register("text_sorted", _INDEX + "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM postings WHERE term = 'license') ORDER BY n_chars DESC, doc_id LIMIT 10")
def text_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).sorted_by("license", "n_chars", True, 10).select("doc_id", "n_chars")


@register("text_highlight", "SELECT doc_id, (len(text) - len(replace(lower(text), 'license', ''))) // 7 >= 0 AS marked, len(regexp_replace(text, '(?i)\\b(license|mit)\\b', '<em>\\1</em>', 'g')) AS n FROM documents WHERE lang = 'en'")
def text_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fulltext.highlight(F.col("text"), ["license", "mit"])
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("marked"), F.char_length(marked).cast("long").alias("n"))


@register("text_range", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 1000 AND n_chars < 1500")
def text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.range_query(table(spark, sf_dir, "documents"), "n_chars", gte="1000", lt="1500").select("doc_id", "score")


@register("text_range_words", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source > 'src1' AND source <= 'src4'")
def text_range_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.range_query(table(spark, sf_dir, "documents"), "source", gt="src1", lte="src4").select("doc_id", "score")


@register("text_term_counts", "SELECT source AS key, count(*) AS doc_count FROM documents GROUP BY source ORDER BY doc_count DESC, key LIMIT 5")
def text_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.term_counts(table(spark, sf_dir, "documents"), "source", 5)


@register("text_update_by_query", _INDEX + "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM postings WHERE term = 'license') THEN 'licensed' ELSE source END AS source FROM documents")
def text_update_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fulltext.update_by_query(docs, _index(spark, sf_dir).search("license", None), "doc_id", {"source": F.lit("licensed")}).select("doc_id", "source")


@register("text_delete_by_query", _INDEX + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'license')")
def text_delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.delete_by_query(table(spark, sf_dir, "documents"), _index(spark, sf_dir).search("license", None), "doc_id").select("doc_id")


# ---------------------------------------------------------------- graphs

# Vertices: regions 1.., nations 101.., suppliers 1001.., and edges down and between them.


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit("region").alias("label"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 101).cast("long").alias("id"), F.lit("nation").alias("label"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1001).cast("long").alias("id"), F.lit("supplier").alias("label"))
    return regions.unionAll(nations).unionAll(suppliers)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") + 101).cast("long").alias("dst"), F.lit("1.5").alias("weight"))
    ring = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 101).cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25 + 101).cast("long").alias("dst"), (F.col("n_nationkey") % 4).cast("string").alias("weight"))
    has = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 101).cast("long").alias("src"), (F.col("s_suppkey") + 1001).cast("long").alias("dst"), F.when(F.col("s_suppkey") % 2 == 0, "heavy").otherwise("2").alias("weight"))
    return down.unionAll(ring).unionAll(has)


_VERTICES = "(SELECT (r_regionkey + 1)::BIGINT AS id, 'region' AS label FROM region UNION ALL SELECT n_nationkey + 101, 'nation' FROM nation UNION ALL SELECT s_suppkey + 1001, 'supplier' FROM supplier)"
_EDGES = """(SELECT (n_regionkey + 1)::BIGINT AS src, (n_nationkey + 101)::BIGINT AS dst, '1.5' AS weight FROM nation
  UNION ALL SELECT n_nationkey + 101, (n_nationkey * 7 + 3) % 25 + 101, (n_nationkey % 4)::VARCHAR FROM nation
  UNION ALL SELECT s_nationkey + 101, s_suppkey + 1001, CASE WHEN s_suppkey % 2 = 0 THEN 'heavy' ELSE '2' END FROM supplier)"""


def _sql_bfs(start: int, depth: int, edges: str = _EDGES) -> str:
    return f"WITH RECURSIVE walk AS (SELECT {start}::BIGINT AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM walk JOIN {edges} e ON walk.id = e.src WHERE depth < {depth}) SELECT id, min(depth) AS depth FROM walk GROUP BY id"


_BOTH = f"(SELECT src, dst FROM {_EDGES} UNION ALL SELECT dst, src FROM {_EDGES})"


@register("graph_neighbors", f"SELECT DISTINCT dst AS id FROM {_BOTH} WHERE src = 105")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_edges(spark, sf_dir), 105, "both")


@register("graph_neighbors_in", f"SELECT DISTINCT src AS id FROM {_EDGES} WHERE dst = 105")
def graph_neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_edges(spark, sf_dir), 105, "in")


@register("graph_bfs", _sql_bfs(1, 3))
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_edges(spark, sf_dir), 1, 3)


@register("graph_bfs_both", _sql_bfs(1005, 3, _BOTH))
def graph_bfs_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_edges(spark, sf_dir), 1005, 3, "both")


@register("graph_bfs_filtered", _sql_bfs(1, 4, f"(SELECT e.* FROM {_EDGES} e JOIN {_VERTICES} v ON v.id = e.dst WHERE v.label <> 'supplier' AND e.dst % 3 <> 0)"))
def graph_bfs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _vertices(spark, sf_dir)
    return graph.bfs(_edges(spark, sf_dir), 1, 4, allow=lambda v: (F.col("label") != "supplier") & ((v % 3 != 0) | (v == 1)), vertices=vertices)


@register("graph_k_hop", f"SELECT * FROM ({_sql_bfs(102, 2)}) WHERE id <> 102")
def graph_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(_edges(spark, sf_dir), 102, 2)


@register(
    "graph_shortest_path",
    f"""WITH RECURSIVE walk AS (SELECT 1::BIGINT AS id, [1::BIGINT] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM walk JOIN (SELECT DISTINCT src, dst FROM {_EDGES}) e ON walk.id = e.src WHERE len(path) <= 4)
    SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS length FROM walk WHERE id = 102 ORDER BY len(path), path LIMIT 1""",
)
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(_edges(spark, sf_dir), 1, 102, 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@register(
    "graph_weighted_path",
    f"""WITH RECURSIVE walk AS (SELECT 2::BIGINT AS id, 0.0::DOUBLE AS cost, 0 AS hops UNION ALL SELECT e.dst, cost + coalesce(TRY_CAST(e.weight AS DOUBLE), 1.0), hops + 1 FROM walk JOIN {_EDGES} e ON walk.id = e.src WHERE hops < 4)
    SELECT min(cost) AS cost FROM walk WHERE id = 105 HAVING count(*) > 0""",
)
def graph_weighted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_path(_edges(spark, sf_dir), 2, 105, 4, F.col("weight")).select("cost")


@register(
    "graph_degrees",
    f"""SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM {_VERTICES} v LEFT JOIN (SELECT src, count(*) AS n FROM {_EDGES} GROUP BY src) o ON v.id = o.src
    LEFT JOIN (SELECT dst, count(*) AS n FROM {_EDGES} GROUP BY dst) i ON v.id = i.dst ORDER BY coalesce(o.n, 0) + coalesce(i.n, 0) DESC, v.id LIMIT 20""",
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_vertices(spark, sf_dir), _edges(spark, sf_dir), 20)


def _sql_pagerank(rounds: int) -> str:
    shares = f"(SELECT e.src, e.dst, 1.0 / o.n AS share FROM {_EDGES} e JOIN (SELECT src, count(*) AS n FROM {_EDGES} GROUP BY src) o ON e.src = o.src)"
    ranks = f"(SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {_VERTICES}) AS rank FROM {_VERTICES})"
    ctes = [f"v AS MATERIALIZED {_VERTICES}", f"s AS MATERIALIZED {shares}", f"r0 AS MATERIALIZED {ranks}"]
    for n in range(rounds):
        ctes.append(f"r{n + 1} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(g.got, 0) AS rank FROM v LEFT JOIN (SELECT s.dst, sum(r.rank * s.share) AS got FROM r{n} r JOIN s ON r.id = s.src GROUP BY s.dst) g ON v.id = g.dst)")
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@register("graph_pagerank", _sql_pagerank(5))
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_vertices(spark, sf_dir), _edges(spark, sf_dir), rounds=5).select("id", F.round("rank", 9).alias("rank"))


@register("graph_counts", f"SELECT label, count(*) AS n FROM {_VERTICES} GROUP BY label UNION ALL SELECT 'edges', count(*) FROM {_EDGES}")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_label = _vertices(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return by_label.unionAll(_edges(spark, sf_dir).agg(F.lit("edges").alias("label"), F.count(F.lit(1)).alias("n")))


@register("graph_add_edges", f"SELECT src, dst FROM {_EDGES} UNION ALL SELECT id, id + 100 FROM {_VERTICES} WHERE id + 100 IN (SELECT id FROM {_VERTICES})")
def graph_add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _vertices(spark, sf_dir).select(F.col("id").alias("src"), (F.col("id") + 100).alias("dst"), F.lit("1").alias("weight"))
    return graph.add_edges(_vertices(spark, sf_dir), _edges(spark, sf_dir), new).select("src", "dst")


@register("graph_delete_vertices", f"SELECT src, dst FROM {_EDGES} WHERE src % 5 <> 0 AND dst % 5 <> 0")
def graph_delete_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _vertices(spark, sf_dir)
    _, edges = graph.delete_vertices(vertices, _edges(spark, sf_dir), vertices.where("id % 5 = 0").select("id"))
    return edges.select("src", "dst")


# ---------------------------------------------------------------- fusion


def _doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")


def _sql_hybrid(where: str = "TRUE") -> str:
    d = _sql_distance("cosine", "e", _sql_query(5))
    return (
        _INDEX
        + f""", t AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, sum(score) AS s FROM scored WHERE term IN ('license', 'idiot') AND {where} GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT 30)),
    v AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS r FROM (SELECT vec_id AS doc_id, {d} AS d FROM {_VECTORS} WHERE {where.replace("doc_id", "vec_id")} ORDER BY d, vec_id LIMIT 30))
    SELECT coalesce(t.doc_id, v.doc_id) AS doc_id, t.r::INT AS text_rank, v.r::INT AS vector_rank, round(coalesce(1.0 / (60 + t.r), 0) + coalesce(0.5 / (60 + v.r), 0), 9) AS rrf
    FROM t FULL JOIN v ON t.doc_id = v.doc_id ORDER BY coalesce(1.0 / (60 + t.r), 0) + coalesce(0.5 / (60 + v.r), 0) DESC, coalesce(t.doc_id, v.doc_id) LIMIT 10"""
    )


@register("fusion_hybrid", _sql_hybrid())
def fusion_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.hybrid(_index(spark, sf_dir), "license idiot", _doc_vectors(spark, sf_dir), "embedding", _query(5), 10, weights=(1.0, 0.5))
    return fused.select("doc_id", "text_rank", "vector_rank", F.round("rrf", 9).alias("rrf"))


@register("fusion_hybrid_filtered", _sql_hybrid("doc_id % 2 = 0"))
def fusion_hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.hybrid(_index(spark, sf_dir), "license idiot", _doc_vectors(spark, sf_dir), "embedding", _query(5), 10, weights=(1.0, 0.5), where=F.col("doc_id") % 2 == 0)
    return fused.select("doc_id", "text_rank", "vector_rank", F.round("rrf", 9).alias("rrf"))


def _id_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding")


_D3 = _sql_distance("cosine", "e", _sql_query(3))


@register("fusion_geo_vector", f"SELECT id, round({_TO_BERLIN}, 3) AS dist_m, round({_D3}, 6) AS distance FROM {_PLACES} JOIN {_VECTORS} ON id = vec_id WHERE {_TO_BERLIN} <= 6000000 ORDER BY {_D3}, id LIMIT 10")
def fusion_geo_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.geo_vector(_places(spark, sf_dir), 13.405, 52.52, 6_000_000, _id_vectors(spark, sf_dir), "embedding", _query(3))
    return found.select("id", F.round("dist_m", 3).alias("dist_m"), F.round("distance", 6).alias("distance"))


@register("fusion_geo_box_vector", f"SELECT id, 0.0::DOUBLE AS dist_m, round({_D3}, 6) AS distance FROM {_PLACES} JOIN {_VECTORS} ON id = vec_id WHERE lng BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 60 ORDER BY {_D3}, id LIMIT 10")
def fusion_geo_box_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.geo_box_vector(_places(spark, sf_dir), (-60, -30, 60, 60), _id_vectors(spark, sf_dir), "embedding", _query(3))
    return found.select("id", "dist_m", F.round("distance", 6).alias("distance"))


@register("fusion_graph_vector", f"SELECT w.id, depth, round({_D3}, 6) AS distance FROM ({_sql_bfs(1, 2)}) w JOIN {_VECTORS} ON w.id = vec_id WHERE w.id <> 1 AND w.id BETWEEN 100 AND 999 ORDER BY {_D3}, w.id LIMIT 8")
def fusion_graph_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _vertices(spark, sf_dir).where("label = 'nation'")
    found = fusion.graph_vector(_edges(spark, sf_dir), 1, 2, _id_vectors(spark, sf_dir), "embedding", _query(3), 8, keep=nations)
    return found.select("id", "depth", F.round("distance", 6).alias("distance"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over all documents: each leads to two others."""
    docs = table(spark, sf_dir, "documents")
    every = docs.select(F.col("doc_id").alias("src")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))
    return every.select("src", F.explode(F.array((F.col("src") * 2 + 1) % F.col("n"), (F.col("src") * 3 + 2) % F.col("n"))).alias("dst"))


_LINKS = "(SELECT doc_id AS src, unnest([(doc_id * 2 + 1) % (SELECT count(*) FROM documents), (doc_id * 3 + 2) % (SELECT count(*) FROM documents)]) AS dst FROM documents)"


@register("fusion_graph_text", _INDEX.replace("WITH split", "WITH RECURSIVE split") + f", walk AS (SELECT 5::BIGINT AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM walk JOIN {_LINKS} e ON walk.id = e.src WHERE depth < 5), around AS (SELECT id AS doc_id, min(depth) AS depth FROM walk GROUP BY id HAVING id <> 5), hits AS (SELECT doc_id, sum(score) AS s FROM scored WHERE term IN ('er', 'ed') GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT (SELECT greatest(10 * count(*), 100) FROM around)) SELECT doc_id, round(s, 6) AS score, depth FROM hits JOIN around USING (doc_id) ORDER BY s DESC, doc_id LIMIT 10")
def fusion_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.graph_text(_links(spark, sf_dir), 5, 5, _index(spark, sf_dir), "er ed", 10)
    return found.select("doc_id", F.round("score", 6).alias("score"), "depth")


@register("fusion_triple", f"SELECT w.id, depth, round({_TO_BERLIN}, 3) AS dist_m, round({_D3}, 6) AS distance FROM ({_sql_bfs(5, 5, _LINKS)}) w JOIN {_PLACES} p ON w.id = p.id JOIN {_VECTORS} ON w.id = vec_id WHERE w.id <> 5 AND {_TO_BERLIN} <= 12000000 ORDER BY {_D3}, w.id LIMIT 10")
def fusion_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.triple(_links(spark, sf_dir), 5, 5, _places(spark, sf_dir), 13.405, 52.52, 12_000_000, _id_vectors(spark, sf_dir), "embedding", _query(3), 10)
    return found.select("id", "depth", F.round("dist_m", 3).alias("dist_m"), F.round("distance", 6).alias("distance"))
