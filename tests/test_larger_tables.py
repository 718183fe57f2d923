"""Queries on tables whose keys or rows are more than those of the given ones."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import vectors
from sparkweave.operators import fulltext, nearest, sessions
from sparkweave.plans import catalog


def table(folder, name, sql):
    duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def agrees(spark, folder, name):
    connection = duckdb.connect()
    for file in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = catalog.queries()[name](spark, str(folder))
    got = sorted(tuple(r) for r in found.collect())
    wanted = connection.execute(catalog.oracle_sql()[name])
    assert [d[0] for d in wanted.description] == found.columns
    want = sorted(wanted.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6)
    return got


def test_upsert_of_vectors_with_keys_past_a_hundred_thousand(spark, tmp_path):
    table(tmp_path, "embeddings", "SELECT range AS vec_id, [1.0, range % 3]::FLOAT[] AS embedding, (range % 10)::INT AS label FROM range(0, 100300)")
    assert sum(n for _, n in agrees(spark, tmp_path, "vector_upsert")) == 100300 + 14329


def shuffled_rows(spark, run):
    """What a function gives, and the rows that its jobs wrote to shuffles."""
    context = spark.sparkContext
    group = f"measured-{id(run)}"
    context.setJobGroup(group, group)
    found = run()
    context.setJobGroup("other", "other")
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return found, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.fixture(scope="module")
def words(spark):
    """1,000 documents of 300 words out of 320, a document without words and one without text."""
    some = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), ((i * 7 + F.col("id")) % 320).cast("string")))
    docs = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(some, " ").alias("text"))
    return docs.unionAll(spark.createDataFrame([(2000, ", the"), (2001, None)], "doc_id long, text string"))


def test_index_is_written_without_a_shuffle_of_postings(spark, words, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "RUN_TOKENS", 1 << 13, raising=False)
    built = fulltext.TextIndex.build(words)
    index, moved = shuffled_rows(spark, lambda: built.written(str(tmp_path)))
    # Words by partition, and words again for their ranges, are all that meets; there are 300,000 postings.
    assert moved < 10_000
    assert index.postings.count() == 300_000
    every = lambda df: sorted(map(str, df.collect()))
    columns = ["term", "doc_id", "tf", "positions", "dl"]
    assert every(index.postings.select(*columns)) == every(built.postings.select(*columns))
    assert index.postings.schema.simpleString() == built.postings.schema.simpleString()
    for name in ("lengths", "terms_of", "totals"):
        assert every(getattr(index, name)) == every(getattr(built, name))
    for one, other in zip((index.phrase("w0 w7"), index.boolean(["w3"], ["w4"], ["w5"])), (built.phrase("w0 w7"), built.boolean(["w3"], ["w4"], ["w5"])), strict=True):
        assert every(one.select("doc_id", F.round("score", 9))) == every(other.select("doc_id", F.round("score", 9)))
    fresh = spark.createDataFrame([(1, "fresh w1"), (2000, "fresh")], "doc_id long, text string")
    again = index.with_documents(fresh).written(str(tmp_path / "again"))
    assert {r.doc_id for r in again.search("fresh").collect()} == {1, 2000} and again.totals.first().n_docs == 1002


def test_expressions_hand_their_terms_to_the_scan(spark, words, tmp_path, monkeypatch):
    index = fulltext.TextIndex.build(words).written(str(tmp_path))
    found = index.regexp("w1[01]", None)
    assert "In(term, [w10,w11])" in found._jdf.queryExecution().toString()
    rows = sorted(map(str, found.select("doc_id", F.round("score", 9)).collect()))
    assert len(rows) > 900
    monkeypatch.setattr(fulltext, "MOST_LITERALS", 1, raising=False)
    assert sorted(map(str, index.regexp("w1[01]", None).select("doc_id", F.round("score", 9)).collect())) == rows
    assert index.regexp("nothing").collect() == []


def test_fields_are_made_of_the_candidates_alone(spark, words, tmp_path, monkeypatch):
    words.withColumn("head", F.substring_index("text", " ", 2)).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = fulltext.TextIndex.build(docs).written(str(tmp_path / "index"))
    found = index.multi_field("w3 w10", {"head": 2.0, "text": 1.0}, 5)
    assert "In(doc_id, [" in found._jdf.queryExecution().toString() and "LeftSemi" not in found._jdf.queryExecution().toString()
    rows = [(r.doc_id, round(r.score, 9)) for r in found.collect()]
    monkeypatch.setattr(fulltext, "MOST_LITERALS", 1, raising=False)
    assert len(rows) == 5 and [(r.doc_id, round(r.score, 9)) for r in index.multi_field("w3 w10", {"head": 2.0, "text": 1.0}, 5).collect()] == rows


def rows_from(spark, node):
    """Rows that the nodes of a name gave in the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    nodes, values = store.planGraph(last).allNodes(), store.executionMetrics(last)
    metrics = [n.metrics().apply(j) for n in (nodes.apply(i) for i in range(nodes.size())) if n.name() == node for j in range(n.metrics().size())]
    return sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows")


def brute(rows, queries, metric):
    """(query, key, distance) of all pairs, as the expressions of functions.vectors give it; without those that have none."""
    found = []
    for q, b in queries:
        for key, a in rows:
            if a is None or len(a) != len(b):
                found += [(q, key, vectors.MISMATCH)] if a is not None else []
            elif metric == "l2":
                found.append((q, key, math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))))
            else:
                dot, lengths = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
                if metric == "dot" or lengths:
                    found.append((q, key, -dot if metric == "dot" else 1 - dot / lengths))
    return found


@pytest.fixture(scope="module")
def points():
    """Vectors with repetitions, near copies, a zero, others of another length, and none."""
    some = random.Random(3)
    rows = [[float(some.randint(-4, 4)) for _ in range(3)] for _ in range(400)] + [[1.0, 2.0, 3.0 + i * 1e-9] for i in range(20)]
    return list(enumerate([*rows, [0.0, 0.0, 0.0], [1.0, 2.0], None, []]))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_nearest_to_each_in_small_blocks(spark, points, metric, monkeypatch):
    for name, value in (("ROWS", 16), ("QUERIES", 4), ("PAIRS", 64)):
        monkeypatch.setattr(nearest, name, value, raising=False)
    asked = [(q, v) for q, v in points if q % 29 == 0 or q > 415]
    frame = spark.createDataFrame(points, "vec_id long, v array<double>").coalesce(2)
    queries = spark.createDataFrame([a for a in asked if a[1] is not None], "query_id long, query array<double>")
    found = nearest.nearest_to_each(frame, "v", queries, 4, metric).collect()
    want = []
    for q, v in asked:
        if v is not None:
            ranked = sorted((d, k) for _, k, d in brute(points, [(q, v)], metric))[:4]
            want += [(q, k, d, i + 1) for i, (d, k) in enumerate(ranked)]
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in found) == sorted((q, k, i) for q, k, _, i in want)
    assert sorted(r.distance for r in found) == pytest.approx(sorted(w[2] for w in want))


def test_tasks_hand_on_k_rows_of_each_query(spark):
    """Before, they handed on k rows of each batch, and all of equal distance."""
    frame = spark.range(0, 9000, 1, 2).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("v"))
    queries = spark.range(7).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("query"))
    found = nearest.nearest_to_each(frame, "v", queries, 2, "l2").collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(q, v) for q in range(7) for v in (0, 3)}
    assert 0 < rows_from(spark, "MapInArrow") <= 7 * 2 * 2


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.05), ("cosine", 1.0), ("l2", 1.0), ("l2", 0.0), ("dot", -9.0)])
def test_duplicates_are_found_in_small_blocks(spark, points, metric, threshold, monkeypatch):
    for name, value in (("ROWS", 16), ("QUERIES", 4), ("PAIRS", 64)):
        monkeypatch.setattr(nearest, name, value, raising=False)
    frame = spark.createDataFrame(points, "vec_id long, v array<double>").coalesce(2)
    asked = [(q, v) for q, v in points if v is not None and (q % 29 == 0 or q > 415)]
    found = sessions.duplicates_of(frame, "v", spark.createDataFrame(asked, "query_id long, query array<double>"), threshold, metric)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    want = [(q, k) for q, k, d in brute(points, asked, metric) if d <= threshold and q != k]
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == sorted(want) and want


def test_duplicates_at_any_distance(spark, points):
    frame = spark.createDataFrame(points, "vec_id long, v array<double>").coalesce(2)
    found = sessions.duplicates_of(frame, "v", spark.createDataFrame([(0, points[0][1]), (421, [1.0, 2.0])], "query_id long, query array<double>"), vectors.MISMATCH, "l2").collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == sorted((q, k) for q in (0, 421) for k, _ in points if k != q)
    assert {r.vec_id for r in found if r.query_id == 0 and r.distance == vectors.MISMATCH} == {421, 422, 423}
