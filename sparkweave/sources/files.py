"""Readers and writers of files that other systems give and take."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP = {"bigint", "double", "string"}


def import_csv(spark: SparkSession, path: str, sample: float = 1.0) -> DataFrame:
    """CSV with a header: columns become whole numbers, doubles or text; rows that don't fit are left out."""
    options = {"header": True, "mode": "DROPMALFORMED", "multiLine": False, "encoding": "UTF-8", "enforceSchema": False}
    guessed = spark.read.options(inferSchema=True, samplingRatio=sample, **options).csv(path)
    fields = []
    for field in guessed.schema.fields:
        kind = {"int": "bigint", "integer": "bigint", "float": "double"}.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind.startswith("decimal"):
            kind = "double"
        fields.append(T.StructField(field.name.lstrip("﻿"), T.StructType.fromDDL(f"c {kind if kind in KEEP else 'string'}").fields[0].dataType))
    return spark.read.options(**options).schema(T.StructType(fields)).csv(path)


def import_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per line, with doc_id from doc_id, id or _id; lines without any are left out."""
    reader = spark.read.options(mode="DROPMALFORMED")
    rows = (reader.schema(schema) if schema else reader).json(path)
    names = [c for c in ("doc_id", "id", "_id") if c in rows.columns]
    if not names:
        raise ValueError("no column doc_id, id or _id")
    key = F.coalesce(*[F.col(c).cast("string") for c in names])
    return rows.select(key.alias("doc_id"), *[F.col(f"`{c}`") for c in rows.columns if c not in names and not c.startswith("_corrupt")]).where("doc_id IS NOT NULL")


def _split(text: str, at: str) -> list[str]:
    """Cuts at a character that stands outside quotes and not behind a backslash."""
    parts, start, quoted, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == at and not quoted:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [*parts, text[start:]]


def _value(text: str) -> str:
    """5i is 5, t and T are true, f and F are false, quotes go."""
    if re.fullmatch(r"-?\d+[iu]", text):
        return text[:-1]
    if text in ("t", "T", "true", "True", "TRUE"):
        return "true"
    if text in ("f", "F", "false", "False", "FALSE"):
        return "false"
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def parse_point(line: str, now_ms: int) -> tuple[str, dict[str, str], dict[str, str], int]:
    """measurement,tag=value field=value timestamp(ns); a backslash protects the next character from splitting and stays."""
    parts = [p for p in _split(line.strip(), " ") if p]
    if not 2 <= len(parts) <= 3:
        raise ValueError(f"no point: {line!r}")
    measurement, *tags = _split(parts[0], ",")
    pairs = [_split(t, "=") for t in tags]
    fields = [_split(f, "=") for f in _split(parts[1], ",")]
    if not measurement or any(len(p) != 2 or not p[0] or not p[1] for p in [*pairs, *fields]):
        raise ValueError(f"no point: {line!r}")
    return measurement, dict(map(tuple, pairs)), {k: _value(v) for k, v in fields}, int(parts[2]) // 1_000_000 if len(parts) == 3 else now_ms


def import_lines(spark: SparkSession, path: str, now_ms: int = 0) -> DataFrame:
    """Line protocol: measurement, tags, fields (maps of text), ts. Comments and empty lines are skipped; a line that is no point fails the read.

    Escapes and quotes need a scanner, so batches of lines go to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = [parse_point(x, now_ms) for x in batch["value"] if x.strip() and not x.startswith("#")]
            yield pd.DataFrame(points, columns=["measurement", "tags", "fields", "ms"])

    parsed = spark.read.text(path).mapInPandas(run, "measurement string, tags map<string,string>, fields map<string,string>, ms long")
    return parsed.select("measurement", "tags", "fields", F.timestamp_millis("ms").alias("ts"))


def import_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of action and document lines: (index_name, doc_id, document) of index and create actions; update and delete are skipped.

    A file's lines keep their order within a split, and an action may stand at the end of one, so files are read whole: a bulk request is bounded by its sender.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.length(F.trim("line")) > 0)
    action = F.coalesce(*[F.get_json_object("line", f"$.{a}") for a in ("index", "create", "update", "delete")])
    kind = F.when(F.get_json_object("line", "$.index").isNotNull(), "index").when(F.get_json_object("line", "$.create").isNotNull(), "create").when(F.get_json_object("line", "$.update").isNotNull(), "update").when(F.get_json_object("line", "$.delete").isNotNull(), "delete")
    only_key = F.size(F.json_object_keys("line")) == 1
    ordered = Window.partitionBy("file").orderBy("n")
    marked = lines.withColumns({"kind": F.when(only_key, kind), "action": action}).withColumns({"before": F.lag("kind").over(ordered), "document": F.lead("line").over(ordered)})
    # A document may look like an action; it is one only if the line before is no action that has a document.
    return marked.where("kind IN ('index', 'create') AND (before IS NULL OR before = 'delete')").select(
        F.get_json_object("action", "$._index").alias("index_name"), F.get_json_object("action", "$._id").alias("doc_id"), "document"
    )


def split_statements(script: str) -> list[str]:
    """Statements of a SQL script: semicolons in quotes and comments don't end one."""
    out, current, i = [], [], 0
    pattern = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|.", re.DOTALL)
    for match in pattern.finditer(script, i):
        text = match[0]
        if text == ";":
            out.append("".join(current).strip())
            current = []
        elif not text.startswith(("--", "/*")):
            current.append(text)
    return [s for s in [*out, "".join(current).strip()] if s]


_TYPES = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint", "real": "double", "float": "double", "double": "double", "numeric": "bigint", "decimal": "double", "text": "string", "varchar": "string", "char": "string", "blob": "binary", "boolean": "boolean", "timestamp": "timestamp", "datetime": "timestamp", "date": "date"}


def import_dump(spark: SparkSession, script: str) -> dict[str, DataFrame]:
    """The tables of a SQL dump's CREATE TABLE and INSERT statements; other statements are skipped. The rows are literals of the script, so they are in it already; those of all
    INSERTs that name the same columns make one list, so the plan doesn't grow with their number."""
    schemas: dict[str, list[tuple[str, str]]] = {}
    values: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for statement in split_statements(script):
        created = re.match(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?(\w+)[\"`]?\s*\((.*)\)\s*$", statement, re.IGNORECASE | re.DOTALL)
        if created:
            columns = []
            for part in re.split(r",(?![^(]*\))", created[2]):
                words = part.strip().split()
                if words and words[0].upper() not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT"):
                    kind = re.match(r"[a-zA-Z]+", words[1])[0].lower() if len(words) > 1 else "text"
                    columns.append((words[0].strip('"`'), "double" if kind == "numeric" and "(" in part else _TYPES.get(kind, "string")))
            schemas[created[1]] = columns
            continue
        inserted = re.match(r"INSERT\s+INTO\s+[\"`]?(\w+)[\"`]?\s*(?:\(([^)]*)\)\s*)?VALUES\s*(.*)$", statement, re.IGNORECASE | re.DOTALL)
        if inserted and inserted[1] in schemas:
            names = [c.strip().strip('"`') for c in inserted[2].split(",")] if inserted[2] else [c for c, _ in schemas[inserted[1]]]
            literals = re.sub(r"'((?:[^']|'')*)'", lambda m: "'" + m[1].replace("\\", "\\\\").replace("''", "\\'") + "'", inserted[3])
            values.setdefault(inserted[1], {}).setdefault(tuple(names), []).append(literals)

    def rows(name: str) -> DataFrame:
        columns = schemas[name]
        if name not in values:
            return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in columns))
        branches = []
        for names, literals in values[name].items():
            selected = ", ".join(f"try_cast({c} AS {k}) AS {c}" if c in names else f"CAST(NULL AS {k}) AS {c}" for c, k in columns)
            branches.append(f"SELECT {selected} FROM VALUES {', '.join(literals)} AS t({', '.join(names)})")
        return spark.sql(" UNION ALL ".join(branches))

    return {name: rows(name) for name in schemas}


def export_keyspace(kv: DataFrame, path: str) -> None:
    """JSON lines with keys and values in base64."""
    kv.select(F.base64(F.col("key").cast("binary")).alias("k"), F.base64(F.col("value").cast("binary")).alias("v"), "expire_at").write.mode("overwrite").json(path)


def import_keyspace(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("k string, v string, expire_at long").json(path)
    return rows.select(F.unbase64("k").cast("string").alias("key"), F.unbase64("v").cast("string").alias("value"), "expire_at")


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder of Parquet for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def import_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
