"""A database of tables that runs the dialect's statements: queries, changes, definitions and transactions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import documents
from sparkweave.operators import aggregates
from sparkweave.operators import tables as DML
from sparkweave.plans.dialect import DialectError, Token, closing, find, name_of, rewrite, split_at, text_of, tokenize, type_of
from sparkweave.scratch import scratch

_SEQUENCE = "__sequence"


@dataclass(frozen=True)
class Table:
    """Rows and what a table's definition demands of them. The first column is the primary key where one is declared."""

    rows: DataFrame
    key: str | None = None
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    foreign: tuple[tuple[str, str, str], ...] = ()
    auto: str | None = None
    comments: Mapping[str, str] = field(default_factory=dict)
    #: The folders that hold the rows; none for rows that the caller gave, and for a definition that has no rows yet.
    paths: tuple[str, ...] = ()
    defined: bool = False


class Database:
    """Tables, views and indexes by name. Rows lie in folders that never change: an INSERT writes the new rows alone and adds their folder to the table's, other changes write
    the table anew, so plans don't grow with the number of statements and a lost executor costs no more than the statement at hand.

    A transaction is a copy of the dictionaries. Folders that no table and no open transaction names any more stay for results that still read them, until vacuum() deletes them.
    """

    #: A table in more folders than this is written anew by the next INSERT.
    most_folders = 64

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        documents.register(spark)
        self.tables: dict[str, Table] = {k: Table(v) for k, v in (tables or {}).items()}
        self.views: dict[str, str] = {}
        #: (table, columns, whether unique) by name.
        self.indexes: dict[str, tuple[str, tuple[str, ...], bool]] = {}
        self._begun: tuple[dict, dict, dict] | None = None
        self._savepoints: dict[str, tuple[dict, dict, dict]] = {}
        self._written: set[str] = set()

    # ------------------------------------------------------------ entry

    def run(self, sql: str, parameters: Sequence[Any] = ()) -> DataFrame:
        """The result of one statement; of one that changes a table, the rows of RETURNING or a count."""
        tokens = tokenize(sql.strip().rstrip(";"))
        if not tokens:
            raise DialectError("an empty statement")
        marks = sum(t.text == "?" for t in tokens) or len({t.text for t in tokens if re.fullmatch(r"\$\d+", t.text)})
        if marks != len(parameters):
            raise DialectError(f"{marks} parameters are wanted, {len(parameters)} given")
        if parameters:
            tokens = self._bound(tokens, parameters)
        words = [t.word for t in tokens[:6]]
        first = words[0]
        if first in ("SELECT", "WITH", "("):
            return self._query(tokens)
        handler = {
            "CREATE": self._create, "DROP": self._drop, "ALTER": self._alter, "TRUNCATE": self._truncate, "INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update,
            "DELETE": self._delete, "SHOW": self._show, "DESCRIBE": self._describe, "DESC": self._describe, "EXPLAIN": self._explain, "ANALYZE": self._analyze, "COMMENT": self._comment,
            "BEGIN": self._begin, "START": self._begin, "COMMIT": self._commit, "ROLLBACK": self._rollback, "SAVEPOINT": self._savepoint, "RELEASE": self._release, "VACUUM": lambda _: self._done(self.vacuum()),
        }.get(first)
        if handler is None:
            raise DialectError(f"no statement begins with {first}")
        return handler(tokens)

    def _bound(self, tokens: list[Token], parameters: Sequence[Any]) -> list[Token]:
        out, n = [], 0
        for t in tokens:
            if t.text == "?":
                out.append(Token(self._literal(parameters[n])))
                n += 1
            elif re.fullmatch(r"\$\d+", t.text):
                out.append(Token(self._literal(parameters[int(t.text[1:]) - 1])))
            else:
                out.append(t)
        return out

    @staticmethod
    def _literal(value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        return repr(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise DialectError(f"no table {name}")
        return self.tables[name]

    def _views(self) -> None:
        for name, t in self.tables.items():
            t.rows.createOrReplaceTempView(name)
        for name, sql in self.views.items():
            self.spark.sql(sql).createOrReplaceTempView(name)

    def _query(self, tokens: list[Token]) -> DataFrame:
        self._views()
        return self.spark.sql(rewrite(tokens))

    def _expression(self, tokens: list[Token]) -> Column:
        return F.expr(rewrite(tokens))

    def _written_to(self, name: str, rows: DataFrame) -> str:
        path = scratch(self.spark, f"table-{name}")
        rows.write.parquet(path)
        self._written.add(path)
        return path

    def _held(self, table: Table, paths: tuple[str, ...]) -> Table:
        return replace(table, rows=self.spark.read.schema(table.rows.schema).parquet(*paths), paths=paths)

    def _stored(self, name: str, rows: DataFrame) -> None:
        """The table with these rows instead of its own."""
        self.tables[name] = self._held(self._table(name), (self._written_to(name, rows),))

    def _appended(self, name: str, new: DataFrame) -> None:
        """The table with more rows; only these are written, unless the table has come apart into many folders."""
        table = self._table(name)
        if (not table.paths and not table.defined) or len(table.paths) >= self.most_folders:
            self._stored(name, table.rows.unionByName(new))
        else:
            self.tables[name] = self._held(table, (*table.paths, self._written_to(name, new)))

    def vacuum(self) -> int:
        """Deletes the folders that no table, open transaction or savepoint names; how many there were. Results of earlier statements that haven't been read can't be read any more."""
        states = [self.tables, *[s[0] for s in (self._begun, *self._savepoints.values()) if s]]
        used = {path for tables in states for table in tables.values() for path in table.paths}
        gone = self._written - used
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in gone:
            folder = hadoop(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self._written -= gone
        return len(gone)

    def _done(self, count: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(count,)], "affected long")

    # ------------------------------------------------------------ definitions

    def _create(self, tokens: list[Token]) -> DataFrame:
        words = [t.word for t in tokens]
        if "VIEW" in words[:4]:
            at = words.index("AS")
            name = name_of(tokens[at - 1])
            self._views()
            self.views[name] = rewrite(tokens[at + 1 :])
            self.spark.sql(self.views[name])
            return self._done()
        if "INDEX" in words[:3]:
            at = words.index("ON")
            table, of = self._table(name_of(tokens[at + 1])), name_of(tokens[at + 1])
            open_ = find(tokens, "USING", start=at)
            open_ = open_ + 2 if open_ > 0 and tokens[at + 2].word == "USING" else at + 2
            columns = tuple(name_of(p[0]) for p in split_at(tokens[open_ + 1 : closing(tokens, open_)]))
            unique = "UNIQUE" in words[:3]
            if unique:
                self.tables[of] = self._valid(replace(table, unique=(*table.unique, columns)))
            # An index is a name and, if unique, a constraint; partitioning and file statistics take the place of its structure.
            self.indexes[name_of(tokens[at - 1])] = (of, columns, unique)
            return self._done()
        if "TABLE" not in words[:3]:
            raise DialectError("CREATE of TABLE, VIEW or INDEX")
        at = words.index("TABLE") + 1
        exists = words[at : at + 3] == ["IF", "NOT", "EXISTS"]
        at += 3 if exists else 0
        name = name_of(tokens[at])
        if name in self.tables:
            if exists:
                return self._done()
            raise DialectError(f"table {name} exists")
        self.tables[name] = self._definition(split_at(tokens[at + 2 : closing(tokens, at + 1)]))
        return self._done()

    def _definition(self, parts: list[list[Token]]) -> Table:
        columns, not_null, unique, checks, defaults, foreign, key, auto = [], [], [], [], {}, [], None, None
        for part in parts:
            words = [t.word for t in part]
            if words[0] == "CONSTRAINT":
                part, words = part[2:], words[2:]
            if words[0] in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                open_ = words.index("(")
                inside = part[open_ + 1 : closing(part, open_)]
                names = tuple(name_of(x[0]) for x in split_at(inside))
                if words[0] == "CHECK":
                    checks.append((f"c{len(checks)}", rewrite(inside)))
                elif words[0] == "FOREIGN":
                    at = words.index("REFERENCES")
                    foreign.append((names[0], name_of(part[at + 1]), name_of(part[at + 3])))
                else:
                    unique.append(names)
                    key = names[0] if words[0] == "PRIMARY" else key
                continue
            name = name_of(part[0])
            kind = part[1].text.lower() if len(part) > 1 else "text"
            has_arguments = len(part) > 2 and part[2].text == "("
            columns.append(f"`{name}` {type_of(kind, has_arguments)}")
            for i, w in enumerate(words):
                if w == "NOT" and words[i + 1 : i + 2] == ["NULL"]:
                    not_null.append(name)
                elif w == "UNIQUE":
                    unique.append((name,))
                elif w == "PRIMARY":
                    key = name
                    unique.append((name,))
                elif w in ("AUTOINCREMENT", "AUTO_INCREMENT") or (i == 1 and w == "SERIAL"):
                    auto = name
                elif w == "DEFAULT":
                    end = i + 2 if part[i + 1].text != "-" else i + 3
                    if end < len(part) and part[end].text == "(":
                        end = closing(part, end) + 1
                    defaults[name] = rewrite(part[i + 1 : end])
                elif w == "CHECK":
                    checks.append((f"{name}_{len(checks)}", rewrite(part[i + 2 : closing(part, i + 1)])))
                elif w == "REFERENCES":
                    foreign.append((name, name_of(part[i + 1]), name_of(part[i + 3])))
        rows = self.spark.createDataFrame([], ", ".join(columns))
        return Table(rows, key, tuple(not_null), tuple(unique), tuple(checks), defaults, tuple(foreign), auto, defined=True)

    def _valid(self, table: Table) -> Table:
        """The table, if its rows keep its constraints. Foreign keys are tested against the tables as they are."""
        checks = {n: F.expr(t) for n, t in table.checks}
        if table.not_null or table.unique or checks:
            DML.checked(table.rows, table.not_null, table.unique, checks)
        for column, parent, key in table.foreign:
            if not DML.orphans(table.rows, column, self._table(parent).rows, key).isEmpty():
                raise DML.ConstraintError(f"FOREIGN KEY {column}")
        return table

    def _valid_new(self, table: Table, new: DataFrame) -> None:
        """Tests rows that are to be added: by themselves, and their unique keys and foreign keys against what is there."""
        checks = {n: F.expr(t) for n, t in table.checks}
        if table.not_null or table.unique or checks:
            DML.checked(new, table.not_null, table.unique, checks)
        for columns in table.unique:
            known = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]
            same = [f"k{i}" for i in range(len(columns))]
            if not new.select(*known).join(table.rows.select(*known), same, "left_semi").isEmpty():
                raise DML.ConstraintError(f"UNIQUE {', '.join(columns)}")
        for column, parent, key in table.foreign:
            held = self._table(parent).rows
            if self._table(parent) is table:
                held = held.unionByName(new)
            if not DML.orphans(new, column, held, key).isEmpty():
                raise DML.ConstraintError(f"FOREIGN KEY {column}")

    def _drop(self, tokens: list[Token]) -> DataFrame:
        words = [t.word for t in tokens]
        optional = words[2:4] == ["IF", "EXISTS"]
        name = name_of(tokens[4 if optional else 2])
        if words[1] == "INDEX":
            if name in self.indexes:
                table, columns, unique = self.indexes.pop(name)
                if unique and table in self.tables:
                    left = list(self.tables[table].unique)
                    left.remove(columns)
                    self.tables[table] = replace(self.tables[table], unique=tuple(left))
            elif not optional:
                raise DialectError(f"no index {name}")
            return self._done()
        held = self.views if words[1] == "VIEW" else self.tables
        if name not in held and not optional:
            raise DialectError(f"no {words[1].lower()} {name}")
        held.pop(name, None)
        if words[1] == "TABLE":
            self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}
        return self._done()

    def _truncate(self, tokens: list[Token]) -> DataFrame:
        name = name_of(tokens[-1])
        table = self._table(name)
        self.tables[name] = replace(table, rows=self.spark.createDataFrame([], table.rows.schema), paths=(), defined=True)
        return self._done()

    def _alter(self, tokens: list[Token]) -> DataFrame:
        name = name_of(tokens[2])
        table, rest = self._table(name), tokens[3:]
        words = [t.word for t in rest]
        rows = table.rows
        if words[0] == "ADD" and "UNIQUE" in words:
            at = words.index("(")
            changed = replace(table, unique=(*table.unique, tuple(name_of(p[0]) for p in split_at(rest[at + 1 : closing(rest, at)]))))
        elif words[0] == "ADD":
            part = rest[2:] if words[1] == "COLUMN" else rest[1:]
            new = self._definition([part])
            column = new.rows.columns[0]
            value = F.expr(new.defaults[column]) if column in new.defaults else F.lit(None)
            changed = replace(table, rows=rows.withColumn(column, value.cast(new.rows.schema[column].dataType)), not_null=(*table.not_null, *new.not_null), unique=(*table.unique, *new.unique), defaults={**table.defaults, **new.defaults})
        elif words[0] == "DROP":
            changed = replace(table, rows=rows.drop(name_of(rest[-1])))
        elif words[0] == "RENAME" and words[1] == "TO":
            del self.tables[name]
            name, changed = name_of(rest[2]), table
        elif words[0] == "RENAME":
            old, new_name = name_of(rest[words.index("TO") - 1]), name_of(rest[words.index("TO") + 1])
            changed = replace(table, rows=rows.withColumnRenamed(old, new_name), key=new_name if table.key == old else table.key)
        elif words[0] in ("ALTER", "MODIFY"):
            column = name_of(rest[2] if words[1] == "COLUMN" else rest[1])
            if "DEFAULT" in words:
                at = words.index("DEFAULT")
                defaults = {k: v for k, v in table.defaults.items() if k != column}
                changed = replace(table, defaults=defaults if "DROP" in words else {**defaults, column: rewrite(rest[at + 1 :])})
            else:
                changed = replace(table, rows=rows.withColumn(column, F.expr(f"try_cast(`{column}` AS {type_of(rest[-1].text.lower())})")))
        else:
            raise DialectError(f"no ALTER TABLE {words[0]}")
        changed = self._valid(changed)
        self.tables[name] = changed if changed.rows is table.rows else replace(changed, paths=(), defined=False)
        return self._done()

    # ------------------------------------------------------------ changes

    def _returning(self, tokens: list[Token]) -> tuple[list[Token], list[Token] | None]:
        at = find(tokens, "RETURNING")
        return (tokens, None) if at < 0 else (tokens[:at], tokens[at + 1 :])

    def _projected(self, rows: DataFrame, items: list[Token] | None) -> DataFrame:
        if items is None:
            return self._done(rows.count())
        return rows.selectExpr(*[rewrite(i) for i in split_at(items)])

    def _new_rows(self, table: Table, columns: list[str], source: list[Token]) -> DataFrame:
        """Rows of VALUES or of a query, with defaults and automatic numbers, in the table's types and in their order."""
        kinds = {f.name: f.dataType for f in table.rows.schema.fields}
        if source[0].word == "VALUES":
            tuples = [rewrite(x[1:-1]) for x in split_at(source[1:])]
            rows = self.spark.sql(f"SELECT * FROM VALUES {', '.join(f'({n}, {t})' for n, t in enumerate(tuples))} AS t({_SEQUENCE}, {', '.join(f'`{c}`' for c in columns)})")
        else:
            rows = self._query(source).toDF(*columns).withColumn(_SEQUENCE, F.monotonically_increasing_id())
        out = []
        for c, kind in kinds.items():
            if c in columns:
                value = F.col(f"`{c}`")
                value = value.cast(kind) if kind.typeName() in ("struct", "array") else value.try_cast(kind)
            elif c in table.defaults:
                value = F.expr(table.defaults[c]).cast(kind)
            else:
                value = F.lit(None).cast(kind)
            out.append(value.alias(c))
        rows = rows.select(*out, F.col(_SEQUENCE).cast("long").alias(_SEQUENCE))
        if table.auto:
            start = table.rows.agg(F.coalesce(F.max(table.auto), F.lit(0))).first()[0]
            given = rows.where(F.col(table.auto).isNotNull())
            fresh = DML.number_rows(rows.where(F.col(table.auto).isNull()).drop(table.auto), [_SEQUENCE], start + 1, table.auto)
            rows = given.unionByName(fresh)
        return rows

    def _insert(self, tokens: list[Token]) -> DataFrame:
        tokens, returning = self._returning(tokens)
        words = [t.word for t in tokens]
        mode = "replace" if words[0] == "REPLACE" or words[1:3] == ["OR", "REPLACE"] else "ignore" if words[1:3] == ["OR", "IGNORE"] else "plain"
        at = words.index("INTO") + 1
        name = name_of(tokens[at])
        table = self._table(name)
        at += 1
        columns = list(table.rows.columns)
        if tokens[at].text == "(" and tokens[at + 1].word not in ("SELECT", "WITH"):
            end = closing(tokens, at)
            columns = [name_of(p[0]) for p in split_at(tokens[at + 1 : end])]
            at = end + 1
        conflict = find(tokens, "ON", start=at)
        conflict = conflict if conflict > 0 and tokens[conflict + 1].word == "CONFLICT" else -1
        new = self._new_rows(table, columns, tokens[at : conflict if conflict > 0 else len(tokens)])
        key = table.key or table.rows.columns[0]
        if conflict > 0:
            close = closing(tokens, conflict + 2) if tokens[conflict + 2].text == "(" else conflict + 1
            if tokens[conflict + 2].text == "(":
                key = name_of(tokens[conflict + 3])
            action = tokens[close + 2 :]
            if action[0].word == "NOTHING":
                rows = DML.insert_or_ignore(table.rows, new, key, _SEQUENCE)
            else:
                rows = DML.upsert(table.rows, new, key, self._assignments(action[2:], name, table.rows.columns), _SEQUENCE)
        elif mode == "replace":
            rows = DML.replace_into(table.rows, new, key, _SEQUENCE)
        elif mode == "ignore":
            rows = DML.insert_or_ignore(table.rows, new, key, _SEQUENCE)
        else:
            self._valid_new(table, new.drop(_SEQUENCE))
            self._appended(name, new.drop(_SEQUENCE))
            return self._projected(new.orderBy(_SEQUENCE).drop(_SEQUENCE), returning)
        self._valid(replace(table, rows=rows))
        self._stored(name, rows)
        return self._projected(new.orderBy(_SEQUENCE).drop(_SEQUENCE), returning)

    @staticmethod
    def _assignments(tokens: list[Token], table: str, columns: Sequence[str]) -> dict[str, str | None]:
        """Of DO UPDATE SET: None for EXCLUDED.column alone, else an expression in which EXCLUDED is ``last`` and the table's own columns are those of ``base``."""
        out: dict[str, str | None] = {}
        for part in split_at(tokens):
            value = part[2:]
            if len(value) == 3 and value[0].word == "EXCLUDED" and name_of(value[2]) == name_of(part[0]):
                out[name_of(part[0])] = None
                continue
            named: list[Token] = []
            for i, t in enumerate(value):
                qualified = i > 0 and value[i - 1].text == "."
                before_dot = i + 1 < len(value) and value[i + 1].text == "."
                if before_dot and t.word == "EXCLUDED":
                    named.append(Token("last"))
                elif before_dot and t.is_name and name_of(t) == table:
                    named.append(Token("base"))
                elif t.is_name and not qualified and not before_dot and name_of(t) in columns:
                    named += [Token("base"), Token("."), t]
                else:
                    named.append(t)
            out[name_of(part[0])] = rewrite(named)
        return out

    def _update(self, tokens: list[Token]) -> DataFrame:
        tokens, returning = self._returning(tokens)
        name = name_of(tokens[1])
        table = self._table(name)
        set_at = find(tokens, "SET")
        where_at, from_at = find(tokens, "WHERE", start=set_at), find(tokens, "FROM", start=set_at)
        order_at, limit_at = find(tokens, "ORDER", start=set_at), find(tokens, "LIMIT", start=set_at)
        ends = [x for x in (where_at, from_at, order_at, limit_at, len(tokens)) if x >= 0]
        parts = split_at(tokens[set_at + 1 : min(ends)])
        join_at = find(tokens[:set_at], "JOIN")
        if from_at >= 0 or join_at >= 0:
            return self._update_from(name, tokens, parts, set_at, where_at, from_at, join_at, returning)
        where_end = min([x for x in (order_at, limit_at, len(tokens)) if x > where_at])
        test = self._expression(tokens[where_at + 1 : where_end]) if where_at >= 0 else F.lit(True)
        kinds = {f.name: f.dataType for f in table.rows.schema.fields}
        assign = {name_of(p[0]): self._expression(p[2:]).cast(kinds[name_of(p[0])]) for p in parts}
        if limit_at >= 0:
            keys = split_at(tokens[order_at + 2 : limit_at]) if order_at >= 0 else []
            ordering = [F.col(name_of(k[0])).desc_nulls_first() if k[-1].word == "DESC" else F.col(name_of(k[0])).asc_nulls_last() for k in keys]
            key = table.key or table.rows.columns[0]
            rows = DML.update_first(table.rows, test, assign, key, [*ordering, F.col(key)], int(tokens[limit_at + 1].text))
        else:
            rows = DML.update(table.rows, test, assign)
        self._valid(self._touched(replace(table, rows=rows), set(assign)))
        before = table.rows
        self._stored(name, rows)
        # The rows are named by the test as it held before the update.
        changed = DML.update(before.where(F.coalesce(test, F.lit(False))), F.lit(True), assign) if limit_at < 0 else rows.exceptAll(before)
        return self._projected(changed, returning)

    @staticmethod
    def _touched(table: Table, columns: set[str]) -> Table:
        """The table with the constraints alone that a change of these columns can break. A check may name any column."""
        return replace(
            table, not_null=tuple(c for c in table.not_null if c in columns), unique=tuple(u for u in table.unique if columns & set(u)), foreign=tuple(f for f in table.foreign if f[0] in columns)
        )

    def _pair(self, tokens: list[Token], mine: set[str], theirs: set[str]) -> tuple[str, str]:
        """The columns of mine.a = theirs.b."""
        for part in re.split(r"\bAND\b", " ".join(t.text for t in tokens), flags=re.IGNORECASE):
            match = re.fullmatch(r"\s*(\w+) \. (\w+) = (\w+) \. (\w+)\s*", part)
            if match:
                a, x, b, y = (g.lower() for g in match.groups())
                if a in mine and b in theirs:
                    return x, y
                if b in mine and a in theirs:
                    return y, x
        raise DialectError("an equality of a column of each table is wanted")

    def _update_from(self, name, tokens, parts, set_at, where_at, from_at, join_at, returning) -> DataFrame:  # noqa: ANN001
        table = self._table(name)
        if from_at >= 0:
            named = tokens[from_at + 1 : where_at]
            condition = tokens[where_at + 1 :]
        else:
            on_at = find(tokens[:set_at], "ON")
            named = tokens[join_at + 1 : on_at]
            condition = tokens[on_at + 1 : set_at]
        source = self._table(name_of(named[0])).rows
        pair = self._pair(condition, {name, name_of(tokens[2]) if tokens[2].is_name else name}, {name_of(named[0]), name_of(named[-1])})
        assign = {name_of(p[2] if p[1].text == "." else p[0]): name_of(p[-1]) for p in parts}
        rows = DML.update_from(table.rows, source.withColumn(_SEQUENCE, F.monotonically_increasing_id()), pair, assign, _SEQUENCE)
        self._valid(self._touched(replace(table, rows=rows), set(assign)))
        self._stored(name, rows)
        return self._projected(rows, returning)

    def _delete(self, tokens: list[Token]) -> DataFrame:
        tokens, returning = self._returning(tokens)
        words = [t.word for t in tokens]
        using_at, join_at, where_at = find(tokens, "USING"), find(tokens, "JOIN"), find(tokens, "WHERE")
        if words[1] != "FROM":  # DELETE t FROM t JOIN s ON ...
            name, source = name_of(tokens[1]), name_of(tokens[join_at + 1])
            condition = tokens[find(tokens, "ON") + 1 : where_at if where_at > 0 else len(tokens)]
        elif using_at > 0:
            name, source, condition = name_of(tokens[2]), name_of(tokens[using_at + 1]), tokens[where_at + 1 :]
        else:
            name, source, condition = name_of(tokens[2]), None, tokens[where_at + 1 :] if where_at >= 0 else None
        table = self._table(name)
        if source:
            rows = DML.delete_using(table.rows, self._table(source).rows, [self._pair(condition, {name}, {source})])
        else:
            rows = DML.delete(table.rows, self._expression(condition) if condition is not None else F.lit(True))
        gone = table.rows.exceptAll(rows)
        for other_name, other in self.tables.items():
            for column, parent, key in other.foreign:
                if parent == name and other_name != name and not DML.orphans(other.rows, column, rows, key).isEmpty():
                    raise DML.ConstraintError(f"FOREIGN KEY {other_name}.{column}")
        self._stored(name, rows)
        return self._projected(gone, returning)

    # ------------------------------------------------------------ metadata and transactions

    def _show(self, tokens: list[Token]) -> DataFrame:
        if tokens[1].word == "TABLES":
            return self.spark.createDataFrame([(n,) for n in sorted({*self.tables, *self.views})], "name string")
        of = name_of(tokens[-1]) if len(tokens) > 2 else None
        rows = [(name, table, ",".join(columns), unique) for name, (table, columns, unique) in sorted(self.indexes.items()) if of in (None, table)]
        return self.spark.createDataFrame(rows, "index_name string, table_name string, columns string, is_unique boolean")

    def _describe(self, tokens: list[Token]) -> DataFrame:
        table = self._table(name_of(tokens[-1]))
        rows = [(f.name, f.dataType.simpleString(), f.name not in table.not_null, table.defaults.get(f.name), f.name == table.key, table.comments.get(f.name)) for f in table.rows.schema.fields]
        return self.spark.createDataFrame(rows, "column_name string, type string, nullable boolean, default_value string, primary_key boolean, comment string")

    def _comment(self, tokens: list[Token]) -> DataFrame:
        name = name_of(tokens[3])
        table = self._table(name)
        column = name_of(tokens[5]) if tokens[2].word == "COLUMN" else ""
        self.tables[name] = replace(table, comments={**table.comments, column: text_of(tokens[-1])})
        return self._done()

    def _explain(self, tokens: list[Token]) -> DataFrame:
        self._views()
        return self.spark.sql("EXPLAIN FORMATTED " + rewrite(tokens[1:]))

    def _analyze(self, tokens: list[Token]) -> DataFrame:
        return aggregates.analyze(self._table(name_of(tokens[-1])).rows)

    def _state(self) -> tuple[dict, dict, dict]:
        return dict(self.tables), dict(self.views), dict(self.indexes)

    def _begin(self, tokens: list[Token]) -> DataFrame:
        if self._begun is not None:
            raise DialectError("a transaction is open")
        self._begun = self._state()
        return self._done()

    def _commit(self, tokens: list[Token]) -> DataFrame:
        if self._begun is None:
            raise DialectError("no transaction is open")
        self._begun = None
        self._savepoints.clear()
        return self._done()

    def _rollback(self, tokens: list[Token]) -> DataFrame:
        if len(tokens) > 2:
            state = self._savepoints.get(name_of(tokens[-1]))
            if state is None:
                raise DialectError(f"no savepoint {name_of(tokens[-1])}")
        elif self._begun is None:
            raise DialectError("no transaction is open")
        else:
            state, self._begun = self._begun, None
            self._savepoints.clear()
        self.tables, self.views, self.indexes = (dict(x) for x in state)
        return self._done()

    def _savepoint(self, tokens: list[Token]) -> DataFrame:
        if self._begun is None:
            raise DialectError("no transaction is open")
        self._savepoints[name_of(tokens[-1])] = self._state()
        return self._done()

    def _release(self, tokens: list[Token]) -> DataFrame:
        self._savepoints.pop(name_of(tokens[-1]), None)
        return self._done()
