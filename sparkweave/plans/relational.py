"""Scans, predicates, joins, set operations and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import predicates as P
from sparkweave.operators import relational as R
from sparkweave.plans.registry import register
from sparkweave.tables import table


@register(
    "revenue_by_nation",
    """
    SELECT n_name, date_trunc('month', o_orderdate)::TIMESTAMP AS order_month, count(*) AS n_lines,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    GROUP BY 1, 2
    HAVING sum(l_quantity) > 10
    ORDER BY revenue DESC NULLS FIRST, n_name, order_month
    LIMIT 200
    """,
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    grouped = joined.groupBy("n_name", F.date_trunc("month", "o_orderdate").alias("order_month")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
    )
    kept = grouped.where("quantity > 10").drop("quantity")
    return R.top(kept, [R.order("revenue", descending=True), R.order("n_name"), R.order("order_month")], 200)


@register("scan_full", "SELECT * FROM nation")
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@register("scan_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@register("scan_limited", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def scan_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [R.order("o_orderkey")], 25)


@register("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 42")


@register("index_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def index_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@register("index_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-02-01'")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-02-01'").select("o_orderkey", "o_orderdate")


@register("count_star", "SELECT count(*) AS n FROM lineitem")
def count_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def _nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with NULLs for one market segment and for negative balances."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))


NULLABLE = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)"


@register(
    "predicates_two_valued",
    f"""
    SELECT c_custkey,
           segment IS NOT DISTINCT FROM 'MACHINERY' AS eq, segment IS NULL AS eq_null, segment IS DISTINCT FROM 'MACHINERY' AS ne,
           coalesce(segment IN ('MACHINERY', 'FURNITURE'), false) AS in_list, coalesce(segment NOT IN ('MACHINERY', 'FURNITURE'), true) AS not_in_list,
           coalesce(segment = 'MACHINERY', false) OR segment IS NULL AS in_null_list,
           coalesce(balance BETWEEN 100 AND 5000, false) AS between_, coalesce(balance NOT BETWEEN 100 AND 5000, true) AS not_between_,
           coalesce(balance > 1000, false) AS gt, segment IS NULL AS is_null, balance IS NOT NULL AS not_null
    FROM {NULLABLE}
    """,
)
def predicates_two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = F.col("segment"), F.col("balance")
    return _nullable(spark, sf_dir).select(
        "c_custkey",
        P.equals(s, "MACHINERY").alias("eq"),
        P.equals(s, None).alias("eq_null"),
        P.differs(s, "MACHINERY").alias("ne"),
        P.is_in(s, "MACHINERY", "FURNITURE").alias("in_list"),
        P.not_in(s, "MACHINERY", "FURNITURE").alias("not_in_list"),
        P.is_in(s, "MACHINERY", None).alias("in_null_list"),
        P.between(b, 100, 5000).alias("between_"),
        P.not_between(b, 100, 5000).alias("not_between_"),
        F.coalesce(b > 1000, F.lit(False)).alias("gt"),
        s.isNull().alias("is_null"),
        b.isNotNull().alias("not_null"),
    )


@register(
    "predicates_patterns",
    f"""
    SELECT c_custkey, coalesce(segment ILIKE 'mach%', false) AS like_, coalesce(NOT segment ILIKE '%u_n%', true) AS not_like_,
           coalesce(segment ILIKE 'x!%%' ESCAPE '!', false) AS like_escape,
           coalesce(segment GLOB '*O*', false) AS glob_, coalesce(NOT segment GLOB '?U*', true) AS not_glob_,
           coalesce(regexp_matches(segment, 'H(I|O)'), false) AS regexp_, coalesce(NOT regexp_matches(segment, '^A'), true) AS not_regexp_, false AS bad_pattern
    FROM {NULLABLE}
    """,
)
def predicates_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("segment")
    return _nullable(spark, sf_dir).select(
        "c_custkey",
        P.like(s, "mach%").alias("like_"),
        P.not_like(s, "%u_n%").alias("not_like_"),
        P.like(s, "x!%%", "!").alias("like_escape"),
        P.glob(s, "*O*").alias("glob_"),
        P.not_glob(s, "?U*").alias("not_glob_"),
        P.regexp(s, "H(I|O)").alias("regexp_"),
        P.not_regexp(s, "^A").alias("not_regexp_"),
        P.regexp(s, "(").alias("bad_pattern"),
    )


@register(
    "predicates_tree",
    """
    SELECT o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'O' AND (o_orderpriority = '1-URGENT' OR o_custkey < 20))
    """,
)
def predicates_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    test = ((status == "F") & (price > 100000)) | ((status == "O") & ((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_custkey") < 20)))
    return table(spark, sf_dir, "orders").where(test).select("o_orderkey")


@register("predicate_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey OR l_tax > l_discount + 0.05")
def predicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_partkey") == F.col("l_suppkey")) | (F.col("l_tax") > F.col("l_discount") + 0.05)).select("l_orderkey", "l_linenumber")


@register("predicate_json", "SELECT event_id FROM events WHERE TRY_CAST(props ->> '$.k' AS BIGINT) >= 50")
def predicate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(P.json_text(F.col("props"), "k").try_cast("bigint") >= 50).select("event_id")


@register("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_custkey")
    return R.in_subquery(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rich)


@register("not_in_subquery", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def not_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_custkey")
    return R.in_subquery(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rich, negated=True)


@register("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)")
def exists_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exists(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "orders").where("o_totalprice > 1000"))


@register("not_exists_uncorrelated", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def not_exists_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exists(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "orders").where("o_totalprice < 0"), negated=True)


@register(
    "projection_arithmetic",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS product, round(l_extendedprice / nullif(l_tax, 0), 4) AS quotient,
           l_quantity + l_linenumber AS total, l_orderkey - l_partkey AS difference,
           CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size
    FROM lineitem
    """,
)
def projection_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.col("l_extendedprice") * F.col("l_discount"), 6).alias("product"),
        F.round(F.try_divide("l_extendedprice", "l_tax"), 4).alias("quotient"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("total"),
        (F.col("l_orderkey") - F.col("l_partkey")).alias("difference"),
        size.alias("size"),
    )


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@register("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.distinct_on(rows, ["o_custkey"], [R.order("o_totalprice", descending=True), R.order("o_orderkey")])


@register("bind_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000.0")
def bind_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey = :customer AND o_totalprice > :price", args={"customer": 10, "price": 1000.0}, orders=table(spark, sf_dir, "orders"))


def _orders_and_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole tables, with keys that only one side has and keys that are null: customer numbers are doubled, and orders of every third customer have none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name")
    return orders, customers


_SIDES = "(SELECT o_orderkey, CASE WHEN o_custkey % 3 != 0 THEN o_custkey END AS o_custkey FROM orders) o {} JOIN (SELECT c_custkey * 2 AS c_custkey, c_name FROM customer) c ON o_custkey = c_custkey"


def _register_join(kind: str, sql: str) -> None:
    @register(f"join_{kind}", f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM {_SIDES.format(sql)}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, customers = _orders_and_customers(spark, sf_dir)
        return R.join(orders, customers, [("o_custkey", "c_custkey")], kind)


for _kind, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _register_join(_kind, _sql)


@register("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.join(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), [], "cross")


@register("join_natural", "SELECT a.k, a.n_name, b.k AS k_right, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b ON a.k = b.k")
def join_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return R.natural_join(nations, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"))


@register(
    "join_null_safe",
    "SELECT a.k, customers, suppliers FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS customers FROM customer GROUP BY 1) a "
    "JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k",
)
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, grouped by the key before the join, so that a hot key or null meets once."""
    left = table(spark, sf_dir, "customer").groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    right = table(spark, sf_dir, "supplier").groupBy(F.nullif("s_nationkey", F.lit(3)).alias("k2")).agg(F.count(F.lit(1)).alias("suppliers"))
    return R.join(left, right, [("k", "k2")], null_safe=True).select("k", "customers", "suppliers")


@register("join_semi", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "lineitem").where("l_quantity > 49"), [("s_suppkey", "l_suppkey")], "left_semi")


@register("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.05)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.join(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").where("l_discount > 0.05"), [("p_partkey", "l_partkey")], "left_anti")


@register("join_two_keys", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    b = a.select(F.col("l_partkey").alias("p2"), F.col("l_suppkey").alias("s2"))
    return R.join(a, b, [("l_partkey", "p2"), ("l_suppkey", "s2")]).agg(F.count(F.lit(1)).alias("n"))


@register("join_filtered_side", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def join_filtered_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])
    return joined.where("c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'").select("o_orderkey", "c_name")


@register(
    "join_chain_grouped",
    "SELECT r_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def join_chain_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.join(R.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), [("s_nationkey", "n_nationkey")]), table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")])
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("mean_balance"))


_LOW, _HIGH = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 1000"


def _register_set(kind: str) -> None:
    @register("set_" + kind.replace(" ", "_"), f"{_LOW} {kind.upper()} {_HIGH}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = table(spark, sf_dir, "customer").where("c_acctbal < 5000").select(F.col("c_nationkey").alias("k"))
        high = table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_nationkey").alias("k"))
        return R.set_operation(low, high, kind)


for _kind in ("union", "union all", "intersect", "intersect all", "except", "except all"):
    _register_set(_kind)


@register("order_nulls_default", f"SELECT c_custkey, segment FROM {NULLABLE} ORDER BY segment ASC NULLS LAST, c_custkey DESC NULLS FIRST LIMIT 700")
def order_nulls_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(_nullable(spark, sf_dir).select("c_custkey", "segment"), [R.order("segment"), R.order("c_custkey", descending=True)], 700)


@register("order_nulls_stated", f"SELECT c_custkey, segment FROM {NULLABLE} ORDER BY segment DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 300")
def order_nulls_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(_nullable(spark, sf_dir).select("c_custkey", "segment"), [R.order("segment", True, "last"), R.order("c_custkey", nulls="first")], 300)


@register("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [R.order("o_totalprice", True), R.order("o_orderkey")], 20, 30)


@register("top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 10")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys: list[Column] = [R.order("l_extendedprice", True), R.order("l_orderkey"), R.order("l_linenumber")]
    return R.top(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), keys, 10)


@register("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
def cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", orders=table(spark, sf_dir, "orders"))


@register("view", "SELECT category, count(*) AS n FROM (SELECT p_size AS category, p_retailprice FROM part WHERE p_retailprice > 950) GROUP BY category")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").where("p_retailprice > 950").select(F.col("p_size").alias("category"), "p_retailprice").createOrReplaceTempView("costly_parts")
    return spark.sql("SELECT category, count(*) AS n FROM costly_parts GROUP BY category")
