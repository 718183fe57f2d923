"""Operators on small inputs whose results are plain to see."""

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import geo, predicates, segment, vectors
from sparkweave.operators import fulltext, fusion, geosets, graph, keyvalue, nearest, queue, relational, tables, timeseries
from sparkweave.sources import files


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(
        [(1, "Rust is a systems language; the borrow checker", "a"), (2, "Python is a language", "b"), (3, "learn rust, learn RUST", "c"), (4, "数据 base rust_lang", "d"), (5, "the of and", "e")],
        "doc_id long, text string, tag string",
    )
    return fulltext.TextIndex.build(docs)


def test_tokens(spark):
    frame = spark.createDataFrame([("The Quick_brown 3 foxes—数据库! " + "x" * 300,)], "t string")
    assert rows(frame.select(fulltext.tokens(F.col("t")))) == [(["quick_brown", "3", "foxes", "数", "据", "库"],)]
    assert rows(frame.select(F.slice(fulltext.tokens(F.col("t"), "whitespace"), 1, 3)))[0][0] == ["quick_brown", "3", "foxes—数据库!"]


def test_text_queries(index, tmp_path):
    assert [r[0] for r in rows(index.search("rust"))] == [3, 1]
    assert [r[0] for r in rows(index.written(str(tmp_path)).search("rust"))] == [3, 1]
    assert rows(index.search("the of")) == []
    assert {r[0] for r in rows(index.phrase("systems language"))} == {1}
    assert {r[0] for r in rows(index.phrase("learn rust learn"))} == {3}
    assert rows(index.phrase("language systems")) == []
    assert {r[0] for r in rows(index.boolean(["rust"], ["learn"], ["borrow"]))} == {3}
    assert rows(index.boolean()) == []
    assert {r[0] for r in rows(index.fuzzy("pyton", 1))} == {2}
    assert {r[0] for r in rows(index.wildcard("rust*"))} == {1, 3, 4}
    assert {r[0] for r in rows(index.regexp("rust"))} == {1, 3}
    assert {r[0] for r in rows(index.term("数"))} == {4}
    assert rows(index.suggest("r")) == [("rust", 2), ("rust_lang", 1)]


def test_highlight(spark):
    frame = spark.createDataFrame([("Rust, rusty RUST.",)], "t string")
    assert rows(frame.select(fulltext.highlight(F.col("t"), ["rust"]))) == [("<em>Rust</em>, rusty <em>RUST</em>.",)]


@pytest.fixture(scope="module")
def triangle(spark):
    edges = spark.createDataFrame([(1, 2, "1"), (1, 3, "5"), (2, 3, "1"), (3, 4, "x")], "src long, dst long, w string")
    return spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "id long"), edges


def test_graph(spark, triangle):
    vertices, edges = triangle
    assert sorted(rows(graph.bfs(edges, 1, 5))) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(graph.bfs(edges, 77, 3)) == [(77, 0)]
    assert sorted(rows(graph.bfs(edges, 1, 5, allow=lambda v: v != 3, vertices=vertices))) == [(1, 0), (2, 1)]
    assert rows(graph.shortest_path(edges, 1, 4, 5)) == [([1, 3, 4], 2)]
    assert rows(graph.shortest_path(edges, 4, 1, 5)) == []
    assert rows(graph.weighted_path(edges, 1, 4, 5, F.col("w"))) == [(3.0, [1, 2, 3, 4])]
    assert rows(graph.weighted_path(edges, 1, 4, 2, F.col("w"))) == [(6.0, [1, 3, 4])]
    assert rows(graph.degrees(vertices, edges, 2)) == [(3, 1, 2), (1, 2, 0)]
    ranks = dict(rows(graph.pagerank(vertices, edges, rounds=30)))
    assert ranks[4] > ranks[1] and ranks[9] == pytest.approx(0.03)
    left, kept = graph.delete_vertices(vertices, edges, spark.createDataFrame([(3,)], "id long"))
    assert left.count() == 4 and rows(kept.select("src", "dst")) == [(1, 2)]


def test_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0])], "vec_id long, v array<float>")
    assert [r.vec_id for r in nearest.nearest(frame, "v", [1, 0, 0], 2).collect()] == [1, 2]
    assert [r.vec_id for r in nearest.nearest(frame, "v", [1, 0, 0], 2, "dot").collect()] == [1, 2]
    assert rows(frame.where("vec_id = 4").select(vectors.distance(F.col("v"), [1, 0, 0], "l2"))) == [(vectors.MISMATCH,)]
    liked = frame.where("vec_id = 1")
    assert nearest.recommend(frame.where("vec_id < 4"), "v", liked, None, 1).first().vec_id == 1


def test_geo(spark):
    members = spark.createDataFrame([("beijing", 116.4074, 39.9042), ("shanghai", 121.4737, 31.2304)], "member string, lng double, lat double")
    ((_, _, km),) = rows(geosets.distances(members, spark.createDataFrame([("beijing", "shanghai")], "a string, b string"), "km"))
    assert km == pytest.approx(1067.6, abs=1)
    assert [r.member for r in geosets.search(members, 116.4, 39.9, 10, "km").collect()] == ["beijing"]
    assert [r.member for r in geosets.search(members, 116.4, 39.9, 2000, "km", 1).collect()] == ["beijing"]
    assert {r.geohash[:5] for r in geosets.hashes(members).collect()} == {"wx4g0", "wtw3s"}
    low, high, west, east = geo.box_around(89.9, 0, 50_000)
    assert (west, east) == (-180.0, 180.0) and low < 89.9 <= high


def test_windows_of_time(spark):
    frame = spark.createDataFrame([(0, "1", "a"), (400, "2", "a"), (1001, "x", "b"), (1500, "3", "a")], "ms long, v string, s string").withColumn("ts", F.timestamp_millis("ms"))
    assert sorted(rows(timeseries.session(frame, 500, "v", ["sum"]))) == [(0, 3.0), (1500, 3.0)]
    assert sorted(rows(timeseries.sliding(frame, 1000, 500, "v", ["count"]))) == [(0, 2), (500, 0), (1000, 1), (1500, 1)]
    assert rows(timeseries.state(frame, "s", "v", ["count"])) == [("a", 0, 3)]


def test_queue(spark):
    messages = spark.createDataFrame([("t", i, 5 - i, "k", "p", 0, 0, 0) for i in range(1, 6)], "topic string, id long, priority int, key string, payload string, deliver_at long, expire_at long, retries int")
    state = queue.initial_state(messages)
    first = queue.poll(messages, state, 2, now=1)
    assert [r.id for r in first.collect()] == [5, 4]
    held = queue.after_poll(state, first)
    assert rows(queue.ack(held, 5)) == [(3, 5, [4])]
    assert rows(queue.ack(queue.ack(held, 5), 4)) == [(5, 5, [])]
    kept, dead, _ = queue.nack(messages.withColumn("retries", F.lit(2)), held, 5)
    assert kept.count() == 4 and dead.first().id == 5


def test_changes_to_tables(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    new = spark.createDataFrame([(2, "x", 7, 1), (3, "y", 8, 2), (3, "z", 9, 3)], "id long, name string, n int, seq int")
    assert sorted(rows(tables.upsert(frame, new, "id", {"n": None}, "seq"))) == [(1, "a", 1), (2, "b", 7), (3, "y", 9)]
    assert sorted(rows(tables.replace_into(frame, new, "id", "seq"))) == [(1, "a", 1), (2, "x", 7), (3, "z", 9)]
    assert sorted(rows(tables.insert_or_ignore(frame, new, "id", "seq"))) == [(1, "a", 1), (2, "b", 2), (3, "y", 8)]
    with pytest.raises(tables.ConstraintError):
        tables.checked(frame, unique=[["id"]], checks={"small": F.col("n") < 2})


def test_subqueries_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    query = spark.createDataFrame([(1,), (None,)], "b long")
    assert rows(relational.in_subquery(left, "a", query)) == [(1,)]
    assert {r[0] for r in rows(relational.in_subquery(left, "a", query, negated=True))} == {2, None}


def test_predicates_take_null_as_a_value(spark):
    frame = spark.createDataFrame([("x",), (None,)], "a string")
    a = F.col("a")
    assert rows(frame.select(predicates.differs(a, "y"), predicates.not_in(a, "x"), predicates.not_like(a, "X%"), predicates.regexp(a, "["))) == [(True, False, False, False), (True, True, True, False)]


def test_hybrid_ranks(spark, index):
    both = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "doc_id long, v array<float>")
    found = rows(fusion.hybrid(index, "rust", both, "v", [0.0, 1.0], 3).select("doc_id", "rrf"))
    assert found[0][0] == 1 and found[0][1] == pytest.approx(1 / 62 + 1 / 61)


def test_line_protocol():
    name, tags, fields, ms = files.parse_point(r'cpu\ load,host=a\,b,dc=x v=5i,ok=T,s="p q" 1700000000000000000', 0)
    assert (name, tags, fields, ms) == (r"cpu\ load", {"host": r"a\,b", "dc": "x"}, {"v": "5", "ok": "true", "s": "p q"}, 1_700_000_000_000)
    with pytest.raises(ValueError):
        files.parse_point("cpu", 0)


def test_statements_are_split_outside_quotes():
    assert files.split_statements("a 'x;y' -- c;d\n; b /* ; */; ") == ["a 'x;y'", "b"]


def test_key_value_batches_with_repeated_and_expired_keys(spark):
    kv = spark.createDataFrame([("a", "1", 0), ("old", "x", 500), ("b", "2", 2000)], "key string, value string, expire_at long")
    new = spark.createDataFrame([("a", "5", 0, 1), ("a", "6", 0, 2), ("c", "7", 0, 3), ("c", "8", 0, 4), ("old", "9", 0, 5)], "key string, value string, expire_at long, seq long")
    assert sorted(rows(keyvalue.put(kv, new))) == [("a", "6", 0), ("b", "2", 2000), ("c", "8", 0), ("old", "9", 0)]
    assert sorted(rows(keyvalue.put_new(kv, new, 1000))) == [("a", "1", 0), ("b", "2", 2000), ("c", "7", 0), ("old", "9", 0)]
    parts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("old", "new", 3), ("b", "!", 4)], "key string, part string, seq long")
    assert sorted(rows(keyvalue.append(kv, parts, 1000))) == [("a", "1yx", 0), ("b", "2!", 2000), ("old", "new", 0)]
    found, _ = keyvalue.get_and_set(kv, new, 1000)
    assert sorted(rows(found), key=str) == sorted([("a", "1"), ("a", "5"), ("c", None), ("c", "7"), ("old", None)], key=str)
    assert sorted(rows(keyvalue.rename(kv, "b", "a", 1000))) == [("a", "2", 2000), ("old", "x", 500)]
    for gone in ("old", "none"):
        with pytest.raises(KeyError):
            keyvalue.rename(kv, gone, "z", 1000)
    assert rows(keyvalue.random_key(kv, 1000)) == [("a",)]


def test_ranges_of_values_are_in_bytes(spark):
    frame = spark.createDataFrame([("aéz",)], "v string")
    assert rows(frame.select(keyvalue.get_range(F.col("v"), 0, 2), keyvalue.get_range(F.col("v"), -1, -1), keyvalue.set_range(F.col("v"), 1, "bc"))) == [("aé", "z", "abcz")]


def test_members_added_twice_in_one_batch(spark):
    held = spark.createDataFrame([("m", 1.0, 1.0)], "member string, lng double, lat double")
    new = spark.createDataFrame([("m", 2.0, 2.0, 1), ("m", 3.0, 3.0, 2), ("n", 4.0, 4.0, 3), ("n", 5.0, 5.0, 4)], "member string, lng double, lat double, seq long")
    assert sorted(rows(geosets.add(held, new))) == [("m", 3.0, 3.0), ("n", 5.0, 5.0)]
    assert sorted(rows(geosets.add(held, new, "nx"))) == [("m", 1.0, 1.0), ("n", 4.0, 4.0)]


def test_fill_keeps_long_grids_and_null_groups(spark):
    data = [("long", 0, 1.0), ("long", 10_000_000, 2.0), (None, 0, 3.0), (None, 20, 4.0)]
    buckets = spark.createDataFrame(data, "tag string, bucket long, v double")
    found = rows(timeseries.fill(buckets, 10, "v", "value", constant=-1.0, by=["tag"]))
    assert sorted(found, key=str) == sorted([*data, (None, 10, -1.0)], key=str)
    alone = spark.createDataFrame([(0, 1.0), (10_000_000, 2.0)], "bucket long, v double")
    assert sorted(rows(timeseries.fill(alone, 10, "v", "linear"))) == [(0, 1.0), (10_000_000, 2.0)]


def test_upsert_folds_rows_in_order(spark):
    held = spark.createDataFrame([(1, 10.0, "a")], "k long, v double, t string")
    new = spark.createDataFrame([(1, 1.0, "x", 1), (1, 2.0, "y", 2), (1, 3.0, "z", 3), (2, 5.0, "p", 4), (2, 6.0, "q", 5)], "k long, v double, t string, seq long")
    found = tables.upsert(held, new, "k", {"v": "base.v + last.v", "t": None}, "seq")
    assert sorted(rows(found)) == [(1, 16.0, "z"), (2, 11.0, "q")]


def test_segmenting_by_a_dictionary(spark):
    words = {"数据": 50, "数据库": 30, "全文": 20, "检索": 20, "全文检索": 5, "支持": 40, "北京": 10, "大学": 10, "北京大学": 12}
    assert segment.best_words("数据库支持全文检索", words, sum(words.values()), 4) == ["数据库", "支持", "全文检索"]
    assert segment.best_words("北京大学生", words, sum(words.values()), 4) == ["北京大学", "生"]
    docs = spark.createDataFrame([(1, "数据库支持全文检索"), (2, "北京大学 rust"), (3, None), (4, "plain words")], "doc_id long, text string")
    cut = segment.segmenter(words, every_part=True)
    index = fulltext.TextIndex.build(docs, analyze=lambda t: fulltext.tokens(cut(t), "words"))
    assert [r[0] for r in rows(index.search("全文检索"))] == [1]
    assert [r[0] for r in rows(index.search("大学"))] == [2]
    assert {r[0] for r in rows(index.dictionary())} >= {"数据库", "数据", "全文", "支持", "北京大学", "rust", "plain"}


def test_index_upkeep_by_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} common text") for i in range(30)], "doc_id long, text string")
    index = fulltext.TextIndex.build(docs).written(str(tmp_path))
    new = spark.createDataFrame([(0, "fresh words"), (99, "fresh common")], "doc_id long, text string")
    changed = index.with_documents(new)
    plain = fulltext.TextIndex.build(docs.where("doc_id > 0").unionAll(new))
    for text in ("word0", "fresh", "common text"):
        assert rows(changed.search(text, None)) and sorted(map(str, rows(changed.search(text, None)))) == sorted(map(str, rows(plain.search(text, None))))
    assert rows(changed.without(new).search("fresh")) == []


def test_states_across_ranges(spark):
    import itertools

    states = [s for s, n in [("a", 40), ("b", 1), ("a", 7), (None, 30), ("c", 22)] for _ in range(n)]
    data = [(i, s, 1.0) for i, s in enumerate(states)]
    frame = spark.createDataFrame(data, "n long, s string, v double").repartition(3).withColumn("ts", F.timestamp_millis("n"))
    found = sorted(rows(timeseries.state(frame, "s", "v", ["count"]).select("bucket", "state", "count")))
    want, at = [], 0
    for s, group in itertools.groupby(states):
        n = len(list(group))
        want.append((at, s or "", n))
        at += n
    assert found == want
