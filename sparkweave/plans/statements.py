"""Statements of the dialect as text, run through a database of the tables, each beside the standard SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.plans.database import Database
from sparkweave.plans.registry import register
from sparkweave.tables import table

#: Of each table the columns that statements name, so that a changed copy of it holds no more.
_COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
}


def _database(spark: SparkSession, sf_dir: str, names: str) -> Database:
    return Database(spark, {n: table(spark, sf_dir, n).select(*_COLUMNS[n]) for n in names.split()})


def _statement(name: str, tables: str, sql: str, *statements: str) -> None:
    """Registers statements that run one after the other; the rows are those of the last."""

    @register(f"sql_{name}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _database(spark, sf_dir, tables)
        for statement in statements[:-1]:
            db.run(statement)
        return db.run(statements[-1])


# ---------------------------------------------------------------- predicates with two values

_statement("not_equal", "customer", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NULL OR nullif(c_nationkey, 3) <> 5", "SELECT c_custkey FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) t WHERE k != 5")
_statement("not_in", "customer", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NULL OR nullif(c_nationkey, 3) NOT IN (1, 2)", "SELECT c_custkey FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) t WHERE k NOT IN (1, 2)")
_statement("not_between", "customer", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NULL OR nullif(c_nationkey, 3) NOT BETWEEN 5 AND 20", "SELECT c_custkey FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) t WHERE k NOT BETWEEN 5 AND 20")
_statement("like_ignores_case", "part", "SELECT p_partkey FROM part WHERE p_type ILIKE '%promo%'", "SELECT p_partkey FROM part WHERE p_type LIKE '%promo%'")
_statement("like_escape", "part", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1_'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'brand!#1_' ESCAPE '!'")
_statement("glob", "part", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#?5'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#?5'")
_statement("regexp", "part", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^S.*L$')", "SELECT p_partkey FROM part WHERE p_type REGEXP '^S.*L$'")
_statement("not_in_query", "customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(n_nationkey, 0) FROM nation WHERE n_regionkey = 1) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_statement("exists", "supplier nation", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'A%')", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_name LIKE 'a%')")
_statement("scalar_query", "supplier", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier)")
_statement("case", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'much' END AS kind FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'much' END AS kind FROM customer")

# ---------------------------------------------------------------- joins, sets, order

_statement("join", "customer nation region", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r.r_name, COUNT(*) AS n FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
_statement("left_join", "nation supplier", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name", "SELECT n_name, COUNT(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name")
_statement("full_join", "customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 3")
_statement("cross_join", "region nation", "SELECT count(*) AS n FROM region CROSS JOIN nation", "SELECT COUNT(*) AS n FROM region CROSS JOIN nation")
_statement("union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_statement("except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
_statement("order_nulls", "customer", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k NULLS LAST, c_custkey LIMIT 40", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY k, c_custkey LIMIT 40")
_statement("order_descending", "customer", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 40", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY k DESC, c_custkey FETCH FIRST 40 ROWS ONLY")
_statement("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
_statement("distinct_on", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS n FROM orders) WHERE n = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_statement("with", "orders", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey HAVING count(*) > 2", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey HAVING n > 2")
_statement("view", "part", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY p_brand", "CREATE VIEW large AS SELECT p_brand, p_size FROM part WHERE p_size > 20", "SELECT p_brand, COUNT(*) AS n FROM large GROUP BY p_brand")

# ---------------------------------------------------------------- aggregates and windows

_statement("sum_of_nothing", "orders", "SELECT 0.0::DOUBLE AS total, 0::BIGINT AS n", "SELECT SUM(o_totalprice) AS total, COUNT(*) AS n FROM orders WHERE o_orderkey < 0")
_statement("group_concat", "nation", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, GROUP_CONCAT(n_name, ';') AS names FROM nation GROUP BY n_regionkey")
_statement("group_concat_distinct", "customer", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, STRING_AGG(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
_statement("deviation", "supplier", "SELECT s_nationkey, round(stddev_pop(s_acctbal), 4) AS dev, round(var_pop(s_acctbal), 2) AS var FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey, ROUND(STDDEV(s_acctbal), 4) AS dev, ROUND(VARIANCE(s_acctbal), 2) AS var FROM supplier GROUP BY s_nationkey")
_statement("percentile", "customer", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.25), 4) AS q FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, ROUND(PERCENTILE_CONT(0.25, c_acctbal), 4) AS q FROM customer GROUP BY c_nationkey")
_statement("bool_aggregates", "customer", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS all_of, bool_or(c_acctbal > 9900) AS any_of FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, BOOL_AND(c_acctbal > -900) AS all_of, BOOL_OR(c_acctbal > 9900) AS any_of FROM customer GROUP BY c_nationkey")
_statement("row_number", "customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS n FROM customer", "SELECT c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS n FROM customer")
_statement("rank", "part", "SELECT p_partkey, rank() OVER (ORDER BY p_size) AS r, dense_rank() OVER (ORDER BY p_size) AS d FROM part", "SELECT p_partkey, CAST(RANK() OVER (ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (ORDER BY p_size) AS BIGINT) AS d FROM part")
_statement("lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
_statement("running_sum", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total FROM orders", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total FROM orders")
_statement("frame", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders")
_statement("ntile", "supplier", "SELECT s_suppkey, (floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) * 3 / count(*) OVER (PARTITION BY s_nationkey)) + 1)::INT AS bucket FROM supplier", "SELECT s_suppkey, NTILE(3) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS bucket FROM supplier")

# ---------------------------------------------------------------- functions

_statement("strings", "part", "SELECT p_partkey, upper(p_name) AS up, substr(p_name, 1, 5) AS head, right(p_name, 3) AS tail, p_brand || '-x' AS cat, length(p_type)::INT AS len FROM part", "SELECT p_partkey, UCASE(p_name) AS up, SUBSTR(p_name, 0, 5) AS head, SUBSTR(p_name, -3) AS tail, CONCAT(p_brand, '-', NULL, 'x') AS cat, LEN(p_type) AS len FROM part")
_statement("replace_empty", "nation", "SELECT n_nationkey, replace(n_name, 'A', '_') AS a, regexp_replace(n_name, '', '.', 'g') AS b FROM nation", "SELECT n_nationkey, REPLACE(n_name, 'A', '_') AS a, REPLACE(n_name, '', '.') AS b FROM nation")
_statement("regexp_replace", "part", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS one, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS every FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '_') AS one, REGEXP_REPLACE(p_type, '[AEIOU]', '_', 'g') AS every FROM part")
_statement("split_part", "part", "SELECT p_partkey, split_part(p_type, ' ', 2) AS second, '' AS none FROM part", "SELECT p_partkey, SPLIT_PART(p_type, ' ', 2) AS second, SPLIT_PART(p_type, ' ', -1) AS none FROM part")
_statement("numbers", "supplier", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, floor(s_acctbal)::BIGINT AS f, sign(s_acctbal)::INT AS s, s_suppkey % 7 AS m, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 6) END AS r FROM supplier", "SELECT s_suppkey, ROUND(ABS(s_acctbal), 2) AS a, FLOOR(s_acctbal) AS f, SIGN(s_acctbal) AS s, MOD(s_suppkey, 7) AS m, ROUND(SQRT(s_acctbal), 6) AS r FROM supplier")
_statement("round_half", "region", "SELECT 3.0::DOUBLE AS a, -3.0::DOUBLE AS b, 2.35::DOUBLE AS c FROM region", "SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, ROUND(2.345, 2) AS c FROM region")
_statement("null_functions", "customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, coalesce(nullif(c_nationkey, 3), 99) AS b, CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'n' END AS c FROM customer", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS a, IFNULL(NULLIF(c_nationkey, 3), 99) AS b, IIF(c_acctbal > 0, 'p', 'n') AS c FROM customer")
_statement("cast", "part", "SELECT p_partkey, NULL::BIGINT AS none, p_partkey::VARCHAR AS text, trunc(p_retailprice)::BIGINT AS whole FROM part", "SELECT p_partkey, CAST(p_name AS INT) AS none, CAST(p_partkey AS TEXT) AS text, CAST(p_retailprice AS INT) AS whole FROM part")
_statement("dates", "orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate::TIMESTAMP) AS days FROM orders", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DATEDIFF(o_orderdate, CAST('1990-01-01' AS TIMESTAMP)) AS days FROM orders")
_statement("json", "nation", "SELECT n_nationkey, n_name AS name, 'object' AS kind, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\",\"x\":1}' AS longer FROM nation", """SELECT n_nationkey, JSON_EXTRACT(j, '$.n') AS name, JSON_TYPE(j) AS kind, JSON_SET(j, '$.x', 1) AS longer FROM (SELECT n_nationkey, CONCAT('{"k":', n_nationkey, ',"n":"', n_name, '"}') AS j FROM nation) t""")
_statement("vectors", "region", "SELECT r_regionkey, round(sqrt(pow(r_regionkey - 1.0, 2) + 4), 6) AS l2 FROM region", "SELECT r_regionkey, ROUND(VEC_L2(ARRAY(CAST(r_regionkey AS DOUBLE), 2.0), [1, 0]), 6) AS l2 FROM region")

# ---------------------------------------------------------------- changes, each followed by a look at the table

_STOCK = "CREATE TABLE stock (id INTEGER PRIMARY KEY, name TEXT NOT NULL, amount FLOAT DEFAULT 1.5)"
_FILL = "INSERT INTO stock SELECT s_suppkey, s_name, s_acctbal FROM supplier"

_statement("insert_values", "supplier", "SELECT * FROM (VALUES (1::BIGINT, 'a', 1.5::DOUBLE), (2, 'it''s', 2.25)) t(id, name, amount)", _STOCK, "INSERT INTO stock (id, name) VALUES (1, 'a')", "INSERT INTO stock VALUES (2, 'it''s', 2.25)", "SELECT * FROM stock")
_statement("insert_select", "supplier", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, 1.5 FROM supplier WHERE s_acctbal > 0", _STOCK, _FILL, "INSERT INTO stock (id, name) SELECT s_suppkey + 100000, s_name FROM supplier WHERE s_acctbal > 0", "SELECT * FROM stock")
_statement("insert_returning", "supplier", "SELECT s_suppkey AS id, upper(s_name) AS name FROM supplier", _STOCK, "INSERT INTO stock SELECT s_suppkey, s_name, s_acctbal FROM supplier RETURNING id, UPPER(name) AS name")
_statement("insert_or_replace", "supplier", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS amount FROM supplier", _STOCK, _FILL, "INSERT OR REPLACE INTO stock SELECT s_suppkey, 'new', 0 FROM supplier WHERE s_suppkey % 3 = 0", "SELECT * FROM stock")
_statement("insert_or_ignore", "supplier", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 100000, 'late' FROM supplier", _STOCK, _FILL, "INSERT OR IGNORE INTO stock SELECT s_suppkey + shift, 'late', 0 FROM supplier CROSS JOIN (SELECT 0 AS shift UNION ALL SELECT 100000) t", "SELECT id, name FROM stock")
_statement("on_conflict_update", "supplier", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' ELSE s_name END AS name FROM supplier", _STOCK, _FILL, "INSERT INTO stock SELECT s_suppkey, CONCAT(s_name, '!'), 0 FROM supplier WHERE s_suppkey % 2 = 0 ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name", "SELECT id, name FROM stock")
_statement("on_conflict_adds", "supplier", "SELECT s_suppkey AS id, round(s_acctbal + 6, 4) AS amount FROM supplier", _STOCK, _FILL, "INSERT INTO stock SELECT s_suppkey, 'x', v FROM supplier CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) t ON CONFLICT (id) DO UPDATE SET amount = stock.amount + EXCLUDED.amount", "SELECT id, ROUND(amount, 4) AS amount FROM stock")
_statement("on_conflict_nothing", "supplier", "SELECT s_suppkey AS id, s_name AS name FROM supplier", _STOCK, _FILL, "INSERT INTO stock SELECT s_suppkey, 'x', 0 FROM supplier ON CONFLICT (id) DO NOTHING", "SELECT id, name FROM stock")
_statement("update", "supplier", "SELECT s_suppkey AS id, round(CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 ELSE s_acctbal END, 4) AS amount FROM supplier", _STOCK, _FILL, "UPDATE stock SET amount = amount * 2 WHERE amount < 0", "SELECT id, ROUND(amount, 4) AS amount FROM stock")
_statement("update_returning", "supplier", "SELECT s_suppkey AS id, 'rich' AS name FROM supplier WHERE s_acctbal > 5000", _STOCK, _FILL, "UPDATE stock SET name = 'rich' WHERE amount > 5000 RETURNING id, name")
_statement("update_limit", "supplier", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5", _STOCK, _FILL, "UPDATE stock SET name = 'top' WHERE amount > 0 ORDER BY amount DESC LIMIT 5", "SELECT id FROM stock WHERE name = 'top'")
_statement("update_from", "supplier nation", "SELECT s_suppkey AS id, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT, nation INT)", "INSERT INTO places SELECT s_suppkey, s_name, s_nationkey FROM supplier", "UPDATE places SET name = nation.n_name FROM nation WHERE places.nation = nation.n_nationkey", "SELECT id, name FROM places")
_statement("delete", "supplier", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal >= 1000", _STOCK, _FILL, "DELETE FROM stock WHERE amount < 1000", "SELECT id FROM stock")
_statement("delete_using", "supplier nation", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "CREATE TABLE far (k INT)", "INSERT INTO far SELECT n_nationkey FROM nation WHERE n_regionkey = 2", "DELETE FROM supplier USING far WHERE supplier.s_nationkey = far.k", "SELECT s_suppkey FROM supplier")
_statement("delete_returning", "supplier", "SELECT s_name FROM supplier WHERE s_acctbal < 0", "DELETE FROM supplier WHERE s_acctbal < 0 RETURNING s_name")
_statement("auto_increment", "region", "SELECT row_number() OVER (ORDER BY r_name) AS id, r_name AS name FROM region", "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT)", "INSERT INTO t (name) SELECT r_name FROM region ORDER BY r_name", "SELECT id, name FROM t")

# ---------------------------------------------------------------- definitions, metadata, transactions

_statement("alter_table", "nation", "SELECT n_nationkey AS id, n_name, 'none' AS state FROM nation", "ALTER TABLE nation ADD COLUMN state TEXT DEFAULT 'none'", "ALTER TABLE nation RENAME COLUMN n_nationkey TO id", "ALTER TABLE nation DROP COLUMN n_regionkey", "SELECT id, n_name, state FROM nation")
_statement("truncate", "nation", "SELECT count(*) AS n FROM nation WHERE false", "TRUNCATE TABLE nation", "SELECT COUNT(*) AS n FROM nation")
_statement("drop_table", "nation region", "SELECT 'region' AS name", "DROP TABLE nation", "DROP TABLE IF EXISTS nothing", "SHOW TABLES")
_statement("show_indexes", "nation", "SELECT * FROM (VALUES ('by_name', 'nation', 'n_name', false), ('by_pair', 'nation', 'n_regionkey,n_name', true)) t(index_name, table_name, columns, is_unique)", "CREATE INDEX by_name ON nation (n_name)", "CREATE UNIQUE INDEX by_pair ON nation (n_regionkey, n_name)", "CREATE INDEX gone ON nation (n_name)", "DROP INDEX gone", "SHOW INDEXES FROM nation")
_statement("describe", "nation", "SELECT * FROM (VALUES ('id', 'bigint', true, NULL, true, NULL), ('name', 'string', false, '''x''', false, NULL::VARCHAR)) t(column_name, type, nullable, default_value, primary_key, comment)", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x')", "DESCRIBE t")
_statement("rollback", "nation", "SELECT n_nationkey FROM nation", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "ROLLBACK", "SELECT n_nationkey FROM nation")
_statement("savepoint", "nation", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "SAVEPOINT s", "DELETE FROM nation WHERE n_regionkey = 2", "ROLLBACK TO SAVEPOINT s", "COMMIT", "SELECT n_nationkey FROM nation")
