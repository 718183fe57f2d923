"""Predicates of the dialect. A comparison is true or false, never unknown: a NULL fails a positive test and passes its negation."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def equals(left: Column, right: Any) -> Column:
    """=; two NULLs are equal."""
    return left.eqNullSafe(right)


def differs(left: Column, right: Any) -> Column:
    """!= and <>; NULL differs from every value."""
    return ~left.eqNullSafe(right)


def is_in(left: Column, *values: Any) -> Column:
    """IN; NULL is in a list that has NULL."""
    plain = [v for v in values if v is not None]
    test = _holds(left.isin(plain)) if plain else F.lit(False)
    return test | left.isNull() if len(plain) < len(values) else test


def not_in(left: Column, *values: Any) -> Column:
    return ~is_in(left, *values)


def between(left: Column, low: Any, high: Any) -> Column:
    return _holds(left.between(low, high))


def not_between(left: Column, low: Any, high: Any) -> Column:
    return ~between(left, low, high)


def like(left: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to case; % is any text, _ one character."""
    return _holds(F.ilike(left, F.lit(pattern), F.lit(escape)) if escape else F.ilike(left, F.lit(pattern)))


def not_like(left: Column, pattern: str, escape: str | None = None) -> Column:
    return ~like(left, pattern, escape)


def glob_to_regex(pattern: str) -> str:
    """* is any text, ? one character, all else itself."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(left: Column, pattern: str) -> Column:
    return _holds(F.rlike(left, F.lit(glob_to_regex(pattern))))


def not_glob(left: Column, pattern: str) -> Column:
    return ~glob(left, pattern)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def regexp(left: Column, pattern: str) -> Column:
    """An unanchored match; a pattern that is no expression matches nothing."""
    return _holds(F.rlike(left, F.lit(pattern))) if _compiles(pattern) else F.lit(False)


def not_regexp(left: Column, pattern: str) -> Column:
    return ~regexp(left, pattern)


def json_text(document: Column, key: str) -> Column:
    """document ->> 'key': a scalar of the top level as text; objects and arrays give NULL."""
    value = F.get_json_object(document, f"$.{key}")
    return F.when(F.rlike(F.ltrim(value), F.lit(r"^[\[{]")), None).otherwise(value)
