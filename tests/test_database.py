import pytest

from sparkweave.operators.tables import ConstraintError
from sparkweave.plans.database import Database
from sparkweave.plans.dialect import DialectError


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.run("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, dept_id INT, score FLOAT DEFAULT 1.5, CHECK (score >= 0))")
    d.run("INSERT INTO users (id, name, dept_id) VALUES (1, 'Alice', 10), (2, 'Bob', 20), (3, 'Charlie', 10), (4, 'Dan''a', NULL)")
    d.run("CREATE TABLE depts (id INT PRIMARY KEY, dept_name TEXT)")
    d.run("INSERT INTO depts VALUES (10, 'Engineering'), (20, 'Marketing')")
    return d


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_select_with_dialect_semantics(db):
    assert rows(db.run("SELECT id FROM users WHERE dept_id != 10 ORDER BY id")) == [(2,), (4,)]
    assert rows(db.run("SELECT id FROM users WHERE dept_id NOT IN (10) ORDER BY id")) == [(2,), (4,)]
    assert rows(db.run("SELECT id FROM users WHERE dept_id NOT BETWEEN 5 AND 15 ORDER BY id")) == [(2,), (4,)]
    assert rows(db.run("SELECT id FROM users WHERE name LIKE 'a%'")) == [(1,)]
    assert rows(db.run("SELECT id FROM users WHERE name NOT LIKE '%a%' ORDER BY id")) == [(2,)]
    assert rows(db.run("SELECT id FROM users WHERE name GLOB '?o*'")) == [(2,)]
    assert rows(db.run("SELECT id FROM users WHERE name REGEXP '^C.*e$'")) == [(3,)]
    assert rows(db.run("SELECT id FROM users ORDER BY dept_id, id")) == [(1,), (3,), (2,), (4,)]
    assert rows(db.run("SELECT id FROM users ORDER BY dept_id DESC, id LIMIT 2 OFFSET 0")) == [(4,), (2,)]
    assert rows(db.run("SELECT id FROM users ORDER BY id FETCH FIRST 2 ROWS ONLY")) == [(1,), (2,)]
    assert rows(db.run("SELECT DISTINCT ON (dept_id) dept_id, id FROM users ORDER BY dept_id, id DESC")) == [(10, 3), (20, 2), (None, 4)]
    assert rows(db.run("SELECT id FROM users WHERE dept_id IN (SELECT id FROM depts WHERE dept_name = 'Marketing')")) == [(2,)]
    assert rows(db.run("SELECT id FROM users WHERE dept_id NOT IN (SELECT id FROM depts WHERE dept_name = 'Marketing') ORDER BY id")) == [(1,), (3,), (4,)]
    assert rows(db.run("SELECT id FROM users WHERE name = ? AND id < $2".replace("$2", "?"), ["Dan'a", 9])) == [(4,)]


def test_functions(db):
    one = "SELECT CONCAT(name, NULL, '!'), SUBSTR('hello', -10, 2), TRIM(' \t x '), REGEXP_REPLACE('aaa', 'a', 'b'), REGEXP_REPLACE('aaa', 'a', 'b', 'g'), SPLIT_PART('a,b', ',', -1), CHAR(8364), CAST('x' AS INT), TRUNCATE(-2.567, 2), IIF(NULL, 1, 2) FROM users WHERE id = 1"
    assert rows(db.run(one)) == [("Alice!", "he", "x", "baa", "bbb", "", "€", None, pytest.approx(-2.56), 2)]
    dates = "SELECT DATEDIFF(CAST('2024-01-02 01:00:00' AS TIMESTAMP), CAST('2024-01-01 23:00:00' AS TIMESTAMP)), WEEKDAY(CAST('2024-01-07' AS TIMESTAMP)), WEEK(CAST('2024-01-07' AS TIMESTAMP)), DATE_FORMAT(CAST('2024-03-05 07:08:09' AS TIMESTAMP), '%Y/%c/%d %H:%i'), TIMESTAMPDIFF(MONTH, CAST('2024-01-31' AS TIMESTAMP), CAST('2024-02-01' AS TIMESTAMP)) FROM users WHERE id = 1"
    assert rows(db.run(dates)) == [(0, 0, 1, "2024/3/05 07:08", 1)]


def test_json_vectors_and_places(spark):
    d = Database(spark)
    d.run("CREATE TABLE docs (id INT PRIMARY KEY, meta JSONB, emb VECTOR(3), loc GEOPOINT)")
    d.run("INSERT INTO docs VALUES (1, '{\"k\":5}', [1.0, 0, 0], GEOPOINT(39.9042, 116.4074)), (2, '{\"k\":\"x\"}', [0, 1, 0], GEOPOINT(31.2304, 121.4737))")
    assert rows(d.run("SELECT id FROM docs WHERE meta->>'k' = 'x'")) == [(2,)]
    assert rows(d.run("SELECT id, VEC_COSINE(emb, [1, 0, 0]) AS dist FROM docs ORDER BY dist LIMIT 2")) == [(1, 0.0), (2, 1.0)]
    assert rows(d.run("SELECT id FROM docs WHERE ST_WITHIN(loc, 39.9, 116.4, 20000)")) == [(1,)]
    ((metres,),) = rows(d.run("SELECT ST_DISTANCE(loc, GEOPOINT(31.2304, 121.4737)) AS m FROM docs WHERE id = 1"))
    assert metres == pytest.approx(1_067_000, rel=0.01)


def test_json_functions(db):
    one = "SELECT JSON_SET('{\"a\":1}', '$.b.c', 'x'), JSON_SET('{\"a\":1}', '$.a', 2.5), JSON_SET('{\"a\":1}', '$.a', NULL), JSON_REMOVE('{\"a\":1,\"b\":2}', '$.a'), JSON_TYPE('[1]'), JSON_TYPE('nope'), JSON_KEYS('{\"b\":1,\"a\":2}'), JSON_VALID(NULL), JSON_ARRAY_LENGTH('{\"a\":[1,2]}', '$.a'), JSON_EXTRACT('{\"a\":{\"b\":[5]}}', '$.a.b[0]'), JSON_CONTAINS('[1,2]', 2) FROM users WHERE id = 1"
    assert rows(db.run(one)) == [('{"a":1,"b":{"c":"x"}}', '{"a":2.5}', '{"a":null}', '{"b":2}', "array", None, "a,b", False, 2, "5", True)]
    assert rows(db.run("SELECT JSON_OBJECTAGG(name, id) FROM users WHERE dept_id = 10")) == [('{"Alice":1,"Charlie":3}',)]
    assert rows(db.run("SELECT STDDEV(id), SUM(id), PERCENTILE_CONT(0.5, id), BOOL_AND(id), ARRAY_AGG(dept_id) FROM users WHERE id < 3")) == [(0.5, 3, 1.5, True, "[10,20]")]


def test_joins_groups_and_windows(db):
    assert rows(db.run("SELECT u.id, d.dept_name FROM users u LEFT JOIN depts d ON u.dept_id = d.id ORDER BY u.id")) == [(1, "Engineering"), (2, "Marketing"), (3, "Engineering"), (4, None)]
    assert rows(db.run("SELECT dept_id, COUNT(*) AS n, GROUP_CONCAT(id) AS ids FROM users GROUP BY dept_id HAVING n > 1"))[0][:2] == (10, 2)
    assert rows(db.run("SELECT id, ROW_NUMBER() OVER (PARTITION BY dept_id ORDER BY id) AS rn FROM users ORDER BY id")) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    frame = "SELECT id, SUM(id) OVER (PARTITION BY dept_id ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM users ORDER BY id"
    assert rows(db.run(frame)) == [(1, 1), (2, 2), (3, 4), (4, 4)]
    assert rows(db.run("SELECT id, CASE WHEN dept_id != 10 THEN 'other' WHEN dept_id IN (10) THEN 'ten' END FROM users ORDER BY id LIMIT 2")) == [(1, "ten"), (2, "other")]
    assert rows(db.run("WITH x AS (SELECT id FROM users) SELECT COUNT(*) FROM x UNION ALL SELECT 0")) == [(4,), (0,)]


def test_changes(db):
    assert rows(db.run("INSERT INTO users VALUES (5, 'Eve', 20, 3) RETURNING id, name")) == [(5, "Eve")]
    db.run("INSERT OR REPLACE INTO users VALUES (5, 'Eva', 30, 4)")
    db.run("INSERT OR IGNORE INTO users VALUES (5, 'Nobody', 1, 1), (6, 'Fay', 1, 1)")
    db.run("INSERT INTO users VALUES (6, 'Faye', 2, 2) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name")
    assert rows(db.run("SELECT id, name, dept_id FROM users WHERE id > 4 ORDER BY id")) == [(5, "Eva", 30), (6, "Faye", 1)]
    assert rows(db.run("UPDATE users SET score = score * 2 WHERE dept_id = 10 RETURNING id, score")) == [(1, 3.0), (3, 3.0)]
    db.run("UPDATE users SET score = 9 WHERE score > 0 ORDER BY id DESC LIMIT 1")
    assert rows(db.run("SELECT id FROM users WHERE score = 9")) == [(6,)]
    db.run("UPDATE users SET name = d.dept_name FROM depts d WHERE users.dept_id = d.id")
    assert rows(db.run("SELECT name FROM users WHERE id <= 2 ORDER BY id")) == [("Engineering",), ("Marketing",)]
    db.run("DELETE FROM users USING depts WHERE users.dept_id = depts.id")
    assert rows(db.run("SELECT id FROM users ORDER BY id")) == [(4,), (5,), (6,)]
    assert rows(db.run("DELETE FROM users WHERE id = 4 RETURNING name")) == [("Dan'a",)]


def test_constraints(db):
    for statement in ("INSERT INTO users VALUES (1, 'Again', 1, 1)", "INSERT INTO users VALUES (7, NULL, 1, 1)", "INSERT INTO users VALUES (8, 'X', 1, -1)"):
        with pytest.raises(ConstraintError):
            db.run(statement)
    db.run("CREATE TABLE child (id INTEGER PRIMARY KEY AUTOINCREMENT, pid INTEGER REFERENCES depts(id))")
    db.run("INSERT INTO child (pid) VALUES (10), (20)")
    assert rows(db.run("SELECT id, pid FROM child ORDER BY id")) == [(1, 10), (2, 20)]
    for statement in ("INSERT INTO child (pid) VALUES (99)", "DELETE FROM depts WHERE id = 10"):
        with pytest.raises(ConstraintError):
            db.run(statement)


def test_definitions_and_transactions(db):
    db.run("ALTER TABLE depts ADD COLUMN floor INT DEFAULT 2")
    db.run("ALTER TABLE depts RENAME COLUMN dept_name TO title")
    assert rows(db.run("SELECT title, floor FROM depts WHERE id = 10")) == [("Engineering", 2)]
    db.run("CREATE VIEW top AS SELECT id FROM users WHERE dept_id = 10")
    assert rows(db.run("SELECT COUNT(*) FROM top")) == [(2,)]
    db.run("BEGIN")
    db.run("DELETE FROM users WHERE id = 1")
    db.run("SAVEPOINT s")
    db.run("TRUNCATE TABLE depts")
    db.run("ROLLBACK TO SAVEPOINT s")
    assert rows(db.run("SELECT COUNT(*) FROM depts")) == [(2,)]
    db.run("ROLLBACK")
    assert rows(db.run("SELECT COUNT(*) FROM users")) == [(4,)]
    assert ("depts",) in rows(db.run("SHOW TABLES"))
    assert rows(db.run("DESCRIBE users"))[0][:2] == ("id", "bigint")
    db.run("DROP TABLE IF EXISTS nothing")
    with pytest.raises(DialectError):
        db.run("DROP TABLE nothing")
    with pytest.raises(DialectError):
        db.run("SELECT id FROM users WHERE id = ?")


def test_inserts_append_and_vacuum_deletes_what_nothing_names(spark):
    d = Database(spark)
    d.run("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    for i in range(3):
        d.run(f"INSERT INTO t VALUES ({i}, {i * i})")
    assert len(d.tables["t"].paths) == 3 and d.vacuum() == 0
    with pytest.raises(ConstraintError):
        d.run("INSERT INTO t VALUES (1, 5)")
    d.run("BEGIN")
    d.run("UPDATE t SET v = 7 WHERE id = 1")
    assert d.vacuum() == 0  # a rollback needs the folders
    d.run("COMMIT")
    assert d.vacuum() == 3
    assert sorted(rows(d.run("SELECT id, v FROM t"))) == [(0, 0), (1, 7), (2, 4)]
    d.most_folders = 2
    d.run("INSERT INTO t VALUES (5, 5)")
    d.run("INSERT INTO t VALUES (6, 6)")
    assert len(d.tables["t"].paths) == 1 and d.run("SELECT COUNT(*) FROM t").first()[0] == 5
