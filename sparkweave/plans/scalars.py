"""Scalar functions, one query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import dates as D
from sparkweave.functions import documents as J
from sparkweave.functions import numbers as N
from sparkweave.functions import strings as S
from sparkweave.plans.registry import register
from sparkweave.tables import table


@register(
    "functions_string",
    """
    SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name)::INT AS len, substr(p_name, 2, 4) AS sub, substr(p_name, 1, 5) AS sub0,
           right(p_name, 3) AS sub_end, left(p_name, 2) AS sub_clamped, trim(p_name) AS trimmed, left(p_name, 3) AS l, right(p_name, 2) AS r,
           reverse(p_brand) AS rev, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(left(p_brand, 2), 3) AS rep, translate(p_brand, 'Ba', 'b') AS tr,
           replace(p_type, 'E', '#') AS repl, instr(p_type, 'E')::INT AS pos, concat(p_brand, '-', p_size) AS cat, concat(p_brand, '') AS cat_null
    FROM part
    """,
)
def functions_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(name).alias("up"),
        F.lower(brand).alias("low"),
        F.length(name).alias("len"),
        S.substr(name, 2, 4).alias("sub"),
        S.substr(name, 0, 5).alias("sub0"),
        S.substr(name, -3).alias("sub_end"),
        S.substr(name, -1000, 2).alias("sub_clamped"),
        S.trim(F.concat(F.lit("\t "), name, F.lit("  \n"))).alias("trimmed"),
        F.left(name, F.lit(3)).alias("l"),
        F.right(name, F.lit(2)).alias("r"),
        F.reverse(brand).alias("rev"),
        F.lpad(brand, 12, "*").alias("lp"),
        F.rpad(brand, 12, "-").alias("rp"),
        S.repeat(F.left(brand, F.lit(2)), 3).alias("rep"),
        F.translate(brand, "Ba", "b").alias("tr"),
        S.replace(kind, "E", "#").alias("repl"),
        F.instr(kind, "E").alias("pos"),
        S.concat(brand, F.lit("-"), F.col("p_size")).alias("cat"),
        S.concat(brand, F.lit(None)).alias("cat_null"),
    )


@register(
    "functions_string_search",
    """
    SELECT p_partkey, instr(p_type, 'A')::INT AS at, (CASE WHEN instr(substr(p_type, 4), 'A') = 0 THEN 0 ELSE instr(substr(p_type, 4), 'A') + 3 END)::INT AS at_later,
           chr((65 + p_size)::INT) AS letter, chr((19968 + p_size)::INT) AS ideograph, ascii(p_brand)::INT AS code, NULL::INT AS no_code, 195 AS first_byte,
           regexp_replace(p_type, '[AEIOU]', '_') AS first_vowel, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS vowels,
           regexp_matches(p_type, 'S.*E') AS has, split_part(p_type, ' ', 1) AS word, '' AS no_part, split_part(p_type, ' ', 9) AS past, '' AS no_repeat, 'xaxbx' AS spread
    FROM part
    """,
)
def functions_string_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.charindex(F.lit("A"), kind).alias("at"),
        S.charindex(F.lit("A"), kind, 4).alias("at_later"),
        S.char(F.lit(65) + F.col("p_size")).alias("letter"),
        S.char(F.lit(19968) + F.col("p_size")).alias("ideograph"),
        S.ascii(F.col("p_brand")).alias("code"),
        S.ascii(F.lit("")).alias("no_code"),
        S.ascii(F.lit("é")).alias("first_byte"),
        S.regexp_replace(kind, "[AEIOU]", "_").alias("first_vowel"),
        S.regexp_replace(kind, "[AEIOU]", "_", "g").alias("vowels"),
        F.regexp_like(kind, F.lit("S.*E")).alias("has"),
        S.split_part(kind, " ", 1).alias("word"),
        S.split_part(kind, " ", -1).alias("no_part"),
        S.split_part(kind, " ", 9).alias("past"),
        S.repeat(kind, -2).alias("no_repeat"),
        S.replace(F.lit("ab"), "", "x").alias("spread"),
    )


@register(
    "functions_conditional",
    """
    SELECT c_custkey, coalesce(v, -1) AS co, coalesce(v, 0) AS ifn, nullif(c_nationkey, 5) AS nul, CASE WHEN c_nationkey <> 0 THEN 'yes' ELSE 'no' END AS iff,
           CASE WHEN v > 0 THEN 'plus' ELSE 'none' END AS iif, TRY_CAST(substr(c_name, 10) AS BIGINT) AS as_int, trunc(c_acctbal)::BIGINT AS cut, NULL::BIGINT AS bad,
           c_nationkey::VARCHAR AS as_text, c_nationkey = 1 AS as_bool, c_nationkey::DOUBLE AS as_float
    FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)
    """,
)
def functions_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.coalesce(v, F.lit(-1)).alias("co"),
        F.ifnull(v, F.lit(0)).alias("ifn"),
        F.nullif(nation, F.lit(5)).alias("nul"),
        N.choose(nation, F.lit("yes"), F.lit("no")).alias("iff"),
        N.choose(v > 0, F.lit("plus"), F.lit("none")).alias("iif"),
        N.cast(F.substring("c_name", 10, 20), "INTEGER").alias("as_int"),
        N.cast(F.col("c_acctbal"), "INT").alias("cut"),
        N.cast(F.lit("not a number"), "BIGINT").alias("bad"),
        N.cast(nation, "TEXT").alias("as_text"),
        N.cast(nation, "BOOLEAN").alias("as_bool"),
        N.cast(nation, "FLOAT").alias("as_float"),
    )


@register(
    "functions_math",
    """
    SELECT c_custkey, abs(c_acctbal) AS ab, round(c_acctbal, 1) AS ro, round(c_acctbal)::BIGINT AS ro0, ceil(c_acctbal)::BIGINT AS ce, floor(c_acctbal)::BIGINT AS fl,
           (c_custkey % nullif(c_nationkey, 0))::BIGINT AS mo, round(power(c_nationkey, 3), 6) AS po, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS sq,
           sign(c_acctbal)::INT AS si, trunc(c_acctbal * 10) / 10 AS tr, round(pi(), 6) AS p, round(exp(c_nationkey / 10.0), 6) AS ex,
           CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS lo, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS lo10,
           c_acctbal / nullif(c_nationkey, 0) AS di
    FROM customer
    """,
)
def functions_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.abs(x).alias("ab"),
        N.round_half_up(x, 1).alias("ro"),
        N.round_half_up(x).alias("ro0"),
        F.ceil(x).alias("ce"),
        F.floor(x).alias("fl"),
        N.mod(F.col("c_custkey"), nation).alias("mo"),
        F.round(F.pow(nation, F.lit(3)), 6).alias("po"),
        F.round(N.sqrt(x), 6).alias("sq"),
        N.sign(x).alias("si"),
        N.truncate(x, 1).alias("tr"),
        F.round(F.pi(), 6).alias("p"),
        F.round(F.exp(nation / 10.0), 6).alias("ex"),
        F.round(F.when(x > 0, F.ln(x)), 6).alias("lo"),
        F.round(F.when(x > 0, F.log10(x)), 6).alias("lo10"),
        N.divide(x, nation).alias("di"),
    )


@register("functions_random", "SELECT count(*) AS n, 0::BIGINT AS outside FROM region")
def functions_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").withColumn("x", F.rand()).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") < 0) | (F.col("x") >= 1)).alias("outside"))


@register(
    "functions_date_parts",
    """
    SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, quarter(ts)::INT AS q,
           dayofweek(ts)::INT AS wd, dayofweek(ts)::INT + 1 AS dow, ((dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7)::INT AS wk,
           month(ts)::INT AS mm, quarter(ts)::INT AS qq, last_day(ts)::TIMESTAMP + (ts - date_trunc('day', ts)) AS ld
    FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)
    """,
)
def functions_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.year(ts).alias("y"),
        F.month(ts).alias("mo"),
        F.dayofmonth(ts).alias("d"),
        F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"),
        F.second(ts).alias("s"),
        F.quarter(ts).alias("q"),
        D.weekday(ts).alias("wd"),
        F.dayofweek(ts).alias("dow"),
        D.week(ts).alias("wk"),
        D.part("MM", ts).alias("mm"),
        D.part("QQ", ts).alias("qq"),
        D.last_day(ts).alias("ld"),
    )


@register(
    "functions_date_arithmetic",
    """
    SELECT o_orderkey, trunc((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-17 12:00:00')) / 86400000.0)::BIGINT AS days,
           o_orderdate + INTERVAL 3 DAY AS plus_days, o_orderdate + INTERVAL 90 MINUTE AS plus_minutes, o_orderdate + INTERVAL 1 MONTH AS plus_month, o_orderdate - INTERVAL 1 YEAR AS minus_year, o_orderdate AS unknown,
           (year(TIMESTAMP '1999-03-01') - year(o_orderdate)) * 12 + month(TIMESTAMP '1999-03-01') - month(o_orderdate) AS months, year(TIMESTAMP '1999-03-01') - year(o_orderdate) AS years,
           trunc((epoch_ms(TIMESTAMP '1999-03-01') - epoch_ms(o_orderdate)) / 3600000.0)::BIGINT AS hours
    FROM orders
    """,
)
def functions_date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, fixed, later = F.col("o_orderdate"), F.lit("1995-06-17 12:00:00").cast("timestamp"), F.lit("1999-03-01").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.datediff(ts, fixed).alias("days"),
        D.add(ts, 3).alias("plus_days"),
        D.add(ts, 90, "minute").alias("plus_minutes"),
        D.add(ts, 1, "MONTH").alias("plus_month"),
        D.sub(ts, 1, "year").alias("minus_year"),
        D.add(ts, 1, "fortnight").alias("unknown"),
        D.timestampdiff("MONTH", ts, later).alias("months"),
        D.timestampdiff("YEAR", ts, later).alias("years"),
        D.timestampdiff("HOUR", ts, later).alias("hours"),
    )


@register(
    "functions_date_text",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%y/') || month(ts) || '/' || day(ts) || ' ' || hour(ts) AS short,
           strftime(ts, '%j') || ' ' || lpad(((dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7)::VARCHAR, 2, '0') || ' ' || dayofweek(ts) || '%' AS week,
           make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000) AS bucket, date_trunc('hour', ts) AS tr_hour, date_trunc('week', ts)::TIMESTAMP AS tr_week,
           date_trunc('month', ts)::TIMESTAMP AS tr_month, date_trunc('quarter', ts)::TIMESTAMP AS tr_quarter, TIMESTAMP '2020-01-01' AS tr_decade, TIMESTAMP '2000-01-01' AS tr_century
    FROM events
    """,
)
def functions_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        D.date_format(ts, "%Y-%m-%d").alias("day"),
        D.date_format(ts, "%H:%i:%s").alias("time"),
        D.date_format(ts, "%y/%c/%e %k").alias("short"),
        D.date_format(ts, "%j %U %w%%").alias("week"),
        D.time_bucket("5 minutes", ts).alias("bucket"),
        *[D.date_trunc(u, ts).alias(f"tr_{u}") for u in ("hour", "week", "month", "quarter", "decade", "century")],
    )


@register(
    "functions_json",
    """
    SELECT event_id, props ->> '$.k' AS k, TRY_CAST(props ->> '$.k' AS DOUBLE) AS number, 'object' AS kind, 'k' AS keys, true AS valid, true AS has, false AS has_not,
           (2 + event_id % 2)::INT AS n, (event_id % 7)::VARCHAR AS first, NULL::INT AS none, 'array' AS list_kind, false AS bad
    FROM events
    """,
)
def functions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    numbers = F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_id") % 7, F.lit(1))).otherwise(F.array(F.col("event_id") % 7, F.lit(1), F.lit(2)))
    nested = F.concat(F.lit('{"a":{"b":'), F.to_json(numbers), F.lit("}}"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        J.extract(props, "$.k").alias("k"),
        J.extract_double(props, "$.k").alias("number"),
        J.kind(props).alias("kind"),
        J.keys(props).alias("keys"),
        J.valid(props).alias("valid"),
        J.contains(props, "k").alias("has"),
        J.contains(props, "z").alias("has_not"),
        J.array_length(nested, "$.a.b").alias("n"),
        J.extract(nested, "$.a.b[0]").alias("first"),
        J.array_length(props).alias("none"),
        J.kind(J.extract(nested, "$.a.b")).alias("list_kind"),
        J.valid(F.concat(F.lit("{"), props)).alias("bad"),
    )


@register(
    "functions_json_change",
    """SELECT event_id, '{"k":' || (props ->> '$.k') || ',"n":{"v":1}}' AS added, '{"k":5}' AS replaced, '{}' AS removed, '{"k":' || (props ->> '$.k') || '}' AS unchanged FROM events""",
)
def functions_json_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        J.set_value(props, "$.n.v", 1).alias("added"),
        J.set_value(props, "$.k", 5).alias("replaced"),
        J.remove(props, "$.k").alias("removed"),
        J.set_value(props, "$.k[3]", 5).alias("unchanged"),
    )


@register("functions_hash", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, sha256(c_name) AS s0, NULL::VARCHAR AS s512 FROM customer")
def functions_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(name).alias("m"), F.sha1(name).alias("s1"), S.sha2(name).alias("s2"), S.sha2(name, 0).alias("s0"), S.sha2(name, 512).alias("s512"))


@register("functions_system", "SELECT r_regionkey, 0 AS row_count, 0 AS last_insert_id FROM region")
def functions_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.lit(0).alias("row_count"), F.lit(0).alias("last_insert_id"))
