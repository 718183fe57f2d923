"""Date and time functions of the dialect, over timestamps in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MS = 86_400_000
_UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": _DAY_MS, "week": 7 * _DAY_MS}
_PARTS = {
    "yy": "year", "yyyy": "year", "mm": "month", "m": "month", "dd": "day", "d": "day", "hh": "hour", "mi": "minute", "n": "minute", "ss": "second", "s": "second",
    "qq": "quarter", "q": "quarter", "wk": "week", "ww": "week", "dw": "weekday",
}


def unit_name(unit: str) -> str:
    unit = unit.lower()
    unit = _PARTS.get(unit, unit)
    return unit[:-1] if unit.endswith("s") and len(unit) > 2 else unit


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def datediff(a: Column, b: Column) -> Column:
    """Whole days that have passed from b to a, not calendar days."""
    return ((millis(a) - millis(b)) / F.lit(_DAY_MS)).cast("long")


def add(ts: Column, amount: Column | int, unit: str = "day") -> Column:
    """DATEADD and DATE_ADD: months and years clamp to the month's end and drop what is below a second; an unknown unit changes nothing."""
    amount = F.lit(amount) if isinstance(amount, int) else amount
    unit = unit_name(unit)
    if unit in _UNIT_MS:
        return F.timestamp_millis(millis(ts) + amount * _UNIT_MS[unit])
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        return ts
    # A timestamp plus months keeps its time of day.
    return F.date_trunc("second", ts) + F.make_ym_interval(F.lit(0), (amount * months).cast("int"))


def sub(ts: Column, amount: Column | int, unit: str = "day") -> Column:
    return add(ts, -amount if isinstance(amount, int) else -amount, unit)


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def week(ts: Column) -> Column:
    """Weeks that begin on Sundays, from 0."""
    return F.floor((F.dayofyear(ts) + F.dayofweek(F.trunc(ts, "year")) - 2) / 7).cast("int")


def part(name: str, ts: Column) -> Column:
    """DATEPART with the short names of parts."""
    name = unit_name(name)
    if name == "week":
        return week(ts)
    if name == "weekday":
        return F.dayofweek(ts)
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter}[name](ts)


#: What a percent sign and a letter stand for in DATE_FORMAT.
_FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "i": "mm", "s": "ss", "S": "ss", "j": "DDD"}


def date_format(ts: Column, template: str) -> Column:
    pieces: list[Column] = []
    for literal, letter in re.findall(r"([^%]+)|%(.)", template):
        if literal:
            pieces.append(F.lit(literal))
        elif letter == "U":
            pieces.append(F.lpad(week(ts).cast("string"), 2, "0"))
        elif letter == "w":
            pieces.append(weekday(ts).cast("string"))
        elif letter in _FORMATS:
            pieces.append(F.date_format(ts, _FORMATS[letter]))
        else:
            pieces.append(F.lit(letter))
    return F.concat(*pieces) if pieces else F.lit("")


def interval_ms(text: str) -> int:
    """'5 minutes', '1hour', '30s' in milliseconds."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", text)
    units = {"ms": "millisecond", "s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week"}
    unit = match and (units.get(match[2].lower()) or unit_name(match[2]))
    if unit not in _UNIT_MS:
        raise ValueError(f"no interval: {text!r}")
    return int(match[1]) * _UNIT_MS[unit]


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the bucket that holds ts."""
    w = interval_ms(width)
    return F.timestamp_millis((millis(ts) - F.pmod(millis(ts), F.lit(w))).cast("long"))


def last_day(ts: Column) -> Column:
    """The last day of the month at the same time of day."""
    return F.timestamp_millis(millis(F.last_day(ts).cast("timestamp")) + F.pmod(millis(ts), F.lit(_DAY_MS)))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """b - a; months and years by calendar fields, smaller units by time passed."""
    unit = unit_name(unit)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if unit in ("month", "quarter"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return (months if unit == "month" else (months / 3).cast("long")).cast("long")
    return ((millis(b) - millis(a)) / F.lit(_UNIT_MS[unit])).cast("long")


def date_trunc(unit: str, ts: Column) -> Column:
    """Weeks begin on Mondays; decades and centuries with the years that 10 and 100 divide."""
    unit = unit.lower()
    span = {"decade": 10, "century": 100}.get(unit)
    if span is None:
        return F.date_trunc(unit, ts)
    return F.make_timestamp((F.floor(F.year(ts) / span) * span).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
