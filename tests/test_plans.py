"""Plans have the shape that large tables need: filters and columns reach the scan, and nothing is gathered that needn't be."""

from pathlib import Path

import pytest

from sparkweave.plans import catalog

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    frame = catalog.queries()[name](spark, str(TABLES))
    return frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize(
    "name, filters",
    [
        ("point_lookup", ["EqualTo(c_custkey,42)"]),
        ("index_equality", ["EqualTo(o_custkey,7)"]),
        ("index_range", ["GreaterThanOrEqual(o_orderdate", "LessThanOrEqual(o_orderdate"]),
        ("scan_columns", ["GreaterThan(l_quantity,45.0)", "EqualTo(l_returnflag,R)"]),
        ("ts_query", ["EqualTo(event_type,click)", "GreaterThanOrEqual(ts", "LessThan(ts"]),
        ("join_filtered_side", ["EqualTo(c_mktsegment,BUILDING)", "EqualTo(o_orderstatus,F)"]),
        ("pricing_summary", ["LessThanOrEqual(l_shipdate"]),
    ],
)
def test_filters_reach_the_scan(spark, name, filters):
    text = plan(spark, name)
    pushed = " ".join(line for line in text.splitlines() if "PushedFilters" in line)
    for f in filters:
        assert f in pushed, text


@pytest.mark.parametrize("name, columns", [("scan_columns", {"l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"}), ("count_star", set()), ("index_equality", {"o_orderkey", "o_custkey", "o_totalprice"})])
def test_scans_read_the_columns_they_need(spark, name, columns):
    (schema,) = {line.split("ReadSchema: struct<")[1].split(">")[0] for line in plan(spark, name).splitlines() if "ReadSchema" in line}
    assert {c.split(":")[0] for c in schema.split(",") if c} == columns


@pytest.mark.parametrize("name", ["top_n", "limit_offset", "vector_nearest_cosine", "vector_filtered", "geo_search"])
def test_top_n_needs_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["distinct_on", "vector_batch_search", "context_recent"])
def test_top_k_of_groups_is_limited_below_the_exchange(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


@pytest.mark.parametrize("name", ["ts_keep_last", "insert_or_replace", "update_from"])
def test_the_last_row_of_a_key_is_an_aggregate(spark, name):
    text = plan(spark, name)
    assert "partial_max_by" in text and "Window" not in text


@pytest.mark.parametrize("name", ["predicates_patterns", "functions_string", "functions_date_parts", "vector_l2", "geo_hash", "text_tokens"])
def test_expressions_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Arrow" not in text
