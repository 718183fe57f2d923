"""JSON functions of the dialect. Paths are like $.a.b[0]."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def extract(document: Column, path: str) -> Column:
    """The value at a path as text; objects and arrays as JSON."""
    return F.get_json_object(document, path)


def extract_double(document: Column, path: str) -> Column:
    return F.get_json_object(document, path).try_cast("double")


def kind(document: Column) -> Column:
    """object, array, string, number, boolean or null; NULL for what is no JSON."""
    first = F.substring(F.ltrim(document), 1, 1)
    named = (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    )
    return F.when(valid(document), named)


def array_length(document: Column, path: str | None = None) -> Column:
    return F.json_array_length(extract(document, path) if path else document)


def keys(document: Column) -> Column:
    """The keys of the top level, sorted and comma-joined."""
    return F.array_join(F.sort_array(F.json_object_keys(document)), ",")


def valid(document: Column) -> Column:
    """NULL is not valid."""
    return F.try_parse_json(document).isNotNull()


def contains(document: Column, value: str) -> Column:
    """An object has the key, or an array the element."""
    has_key = F.array_contains(F.json_object_keys(document), value)
    has_element = F.array_contains(F.from_json(document, "array<string>"), value)
    return F.when(F.startswith(F.ltrim(document), F.lit("[")), F.coalesce(has_element, F.lit(False))).otherwise(F.coalesce(has_key, F.lit(False)))


def _steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(f"no path: {path!r}")
    return [int(i) if i else k for k, i in re.findall(r"\.([^.\[]+)|\[(\d+)\]", path)]


def _changed(text: str | None, steps: list[str | int], change: Any) -> str | None:
    """``change`` gets the container and last step of a path and alters it; paths that don't fit leave the text as it is."""
    if text is None:
        return None
    try:
        root = json.loads(text)
    except ValueError:
        return None
    holder: list[Any] = [root]
    place: tuple[Any, Any] = (holder, 0)
    for step in steps:
        parent, key = place
        node = parent[key] if not isinstance(parent, dict) or key in parent else None
        if node is None and isinstance(parent, dict) and isinstance(step, str):
            node = parent[key] = {}
        if isinstance(step, str) != isinstance(node, dict) or (isinstance(step, int) and (not isinstance(node, list) or step >= len(node))):
            return json.dumps(root, separators=(",", ":"), ensure_ascii=False)
        place = (node, step)
    change(*place)
    return json.dumps(holder[0], separators=(",", ":"), ensure_ascii=False)


def register(spark: SparkSession) -> None:
    """Gives SQL the functions json_set_value(document, path, json value) and json_remove_value(document, path)."""

    @F.pandas_udf("string")
    def json_set_value(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for text, path, value in zip(texts, paths, values, strict=True):
            new = json.loads(value)
            out.append(_changed(text, _steps(path), lambda parent, key, new=new: parent.__setitem__(key, new)))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def json_remove_value(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_changed(t, _steps(p), _drop) for t, p in zip(texts, paths, strict=True)], dtype=object)

    spark.udf.register("json_set_value", json_set_value)
    spark.udf.register("json_remove_value", json_remove_value)


def _drop(parent: Any, key: Any) -> None:
    if not isinstance(parent, dict) or key in parent:
        del parent[key]


def set_value(document: Column, path: str, value: Any) -> Column:
    """Replaces or adds a value; missing objects on the way are made, arrays are not extended. Spark has no such function, so this is a vectorised one."""
    steps = _steps(path)

    def put(parent: Any, key: Any) -> None:
        parent[key] = value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _changed(t, steps, put))

    return run(document)


def remove(document: Column, path: str) -> Column:
    """Removes what is at a path, if anything is."""
    steps = _steps(path)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _changed(t, steps, _drop))

    return run(document)
