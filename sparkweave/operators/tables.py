"""Changes to tables: each gives the table that a statement leaves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.scratch import scratch


def _struct(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def replace_into(df: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """INSERT OR REPLACE: of rows with one key the last written."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*df.columns), sequence).alias("fresh")).withColumnRenamed(key, "__k")
    both = df.select(F.col(key).alias("__k"), _struct(df, "old")).join(last, "__k", "full")
    return both.select(F.coalesce("fresh", "old").alias("r")).select("r.*")


def insert_or_ignore(df: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Rows whose key exists are left out; of new ones the first."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*df.columns), sequence).alias("fresh")).withColumnRenamed(key, "__k")
    both = df.select(F.col(key).alias("__k"), _struct(df, "old")).join(first, "__k", "full")
    return both.select(F.coalesce("old", "fresh").alias("r")).select("r.*")


def upsert(df: DataFrame, new: DataFrame, key: str, assign: Mapping[str, str | None], sequence: str) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE: columns of ``assign`` get the new row's value (None) or that of a SQL expression over ``base``, the row that is there, and
    ``last``, the new one, such as "base.v + last.v". Rows apply one after the other."""
    rows = new.groupBy(key)
    if any(text is not None for text in assign.values()):
        # Each row sees what the one before left, so a key's new rows are folded in their order.
        listed = F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))))
        grouped = rows.agg(F.transform(listed, lambda x: x["row"]).alias("__rows")).withColumnRenamed(key, "__k")
        both = df.select(F.col(key).alias("__k"), _struct(df, "old")).join(grouped, "__k", "full")
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        fields = []
        for c in df.columns:
            text = f"base.`{c}`" if c == key or c not in assign else f"last.`{c}`" if assign[c] is None else f"CAST({assign[c]} AS {kinds[c]})"
            fields.append(f"'{c}', {text}")
        merged = f"aggregate(CASE WHEN old IS NULL THEN slice(__rows, 2, size(__rows)) ELSE __rows END, coalesce(old, __rows[0]), (base, last) -> named_struct({', '.join(fields)}))"
        return both.select(F.expr(f"CASE WHEN __rows IS NULL THEN old ELSE {merged} END").alias("r")).select("r.*")
    ordered = rows.agg(F.min_by(F.struct(*df.columns), sequence).alias("first"), F.max_by(F.struct(*df.columns), sequence).alias("last"), F.count(F.lit(1)).alias("__n")).withColumnRenamed(key, "__k")
    both = df.select(F.col(key).alias("__k"), _struct(df, "old")).join(ordered, "__k", "full")
    base = both.withColumn("base", F.coalesce("old", "first")).withColumn("__conflict", F.col("last").isNotNull() & (F.col("old").isNotNull() | (F.col("__n") > 1)))
    out = []
    for c in df.columns:
        if c in assign and c != key:
            out.append(F.when(F.col("__conflict"), F.col(f"last.`{c}`")).otherwise(F.col(f"base.`{c}`")).alias(c))
        else:
            out.append(F.col(f"base.`{c}`").alias(c))
    return base.select(*out)


def update(df: DataFrame, where: Column, assign: Mapping[str, Column]) -> DataFrame:
    test = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in assign.items()})


def update_first(df: DataFrame, where: Column, assign: Mapping[str, Column], key: str, ordering: Sequence[Column], limit: int) -> DataFrame:
    """UPDATE ... ORDER BY ... LIMIT."""
    chosen = df.where(where).orderBy(*ordering).limit(limit).select(F.col(key).alias("__k")).distinct()
    marked = df.join(chosen.withColumn("__hit", F.lit(True)), df[key] == chosen["__k"], "left")
    return marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in assign.items()}).select(*df.columns)


def update_from(df: DataFrame, source: DataFrame, on: tuple[str, str], assign: Mapping[str, str], sequence: str) -> DataFrame:
    """UPDATE ... FROM and UPDATE ... JOIN: columns get those of the matching source row, the last of several; NULL keys match nothing."""
    mine, theirs = on
    last = source.groupBy(F.col(theirs).alias("__k")).agg(F.max_by(F.struct(*source.columns), sequence).alias("__s"))
    both = df.join(last, df[mine] == last["__k"], "left")
    hit = F.col("__s").isNotNull()
    return both.withColumns({c: F.when(hit, F.col(f"__s.`{s}`")).otherwise(F.col(c)) for c, s in assign.items()}).select(*df.columns)


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_using(df: DataFrame, source: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """DELETE ... USING and DELETE ... FROM ... JOIN: without rows that match any of the source."""
    condition = df[on[0][0]] == source[on[0][1]]
    for a, b in on[1:]:
        condition = condition & (df[a] == source[b])
    return df.join(source, condition, "left_anti")


class ConstraintError(ValueError):
    """Rows that a table's constraints forbid."""


def checked(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), checks: Mapping[str, Column] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows with defaults for NULLs, or ConstraintError. A check is unsatisfied only where it is false. One pass tests the row constraints, one aggregation each unique key."""
    df = df.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()}) if defaults else df
    tests = {f"NOT NULL {c}": F.col(c).isNull() for c in not_null} | {f"CHECK {n}": ~F.coalesce(t, F.lit(True)) for n, t in (checks or {}).items()}
    if tests:
        names = list(tests)
        counts = df.agg(*[F.count_if(tests[n]).alias(f"c{i}") for i, n in enumerate(names)]).first()
        for i, n in enumerate(names):
            if counts[f"c{i}"]:
                raise ConstraintError(f"{n}: {counts[f'c{i}']} rows")
    for columns in unique:
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        if not df.where(known).groupBy(*columns).count().where("count > 1").isEmpty():
            raise ConstraintError(f"UNIQUE {', '.join(columns)}")
    return df


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of a child whose foreign key names no parent; NULL keys name none and are allowed."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def number_rows(df: DataFrame, by: Sequence[str], start: int = 1, name: str = "id") -> DataFrame:
    """AUTOINCREMENT in the order of ``by``. Consecutive numbers need one order over all rows: ranges are sorted and written once, numbered by themselves and moved by what comes
    before. The numbers of the ranges come from the files that hold them, so both readings agree."""
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__p", (F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__off"))
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*by)))
    return local.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__n") + F.col("__off") + start - 1).cast("long")).drop("__p", "__n", "__off")
