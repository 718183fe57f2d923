"""String functions of the dialect, where they differ from Spark's; the others are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; 0 counts as 1; a negative start counts from the end and stops at the beginning."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.when(start > 0, start).when(start == 0, F.lit(1)).otherwise(F.greatest(F.char_length(text) + start + 1, F.lit(1)))
    return F.substring(text, first, F.char_length(text) if length is None else F.greatest(F.lit(length) if isinstance(length, int) else length, F.lit(0)))


def trim(text: Column) -> Column:
    """Removes all Unicode white space, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def replace(text: Column, old: str, new: str) -> Column:
    """Literal; an empty ``old`` puts ``new`` before each character and at the end."""
    if old:
        return F.replace(text, F.lit(old), F.lit(new))
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(F.lit(new), c)), "")
    return F.when(F.char_length(text) > 0, F.concat(spread, F.lit(new))).otherwise(F.when(text.isNotNull(), F.lit(new)))


def concat(*parts: Column) -> Column:
    """NULL counts as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def charindex(part: Column, text: Column, start: int = 1) -> Column:
    """1-based position of ``part``, 0 if there is none."""
    return F.locate(part, text, start) if isinstance(part, str) else F.position(part, text, F.lit(start))


def char(code: Column) -> Column:
    """The character of a code point; a code that is none gives NULL."""
    valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))


def ascii(text: Column) -> Column:
    """The first byte of the UTF-8 text; an empty text gives NULL."""
    return F.when(F.char_length(text) > 0, F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 1)), 16, 10).cast("int"))


def regexp_replace(text: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match alone, or every one if ``flags`` has g; i ignores case. $1 in ``new`` is the pattern's first group."""
    inline = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(text, inline + pattern, new)
    # Split at the first match; the rest stays as it is. The match itself is replaced alone, so groups keep their numbers.
    found = F.regexp_substr(text, F.lit(inline + pattern))
    at = F.regexp_instr(text, F.lit(inline + pattern))
    changed = F.concat(F.substring(text, F.lit(1), at - 1), F.regexp_replace(found, inline + pattern, new), F.substring(text, at + F.char_length(found), F.char_length(text)))
    return F.when(at > 0, changed).otherwise(text)


def split_part(text: Column, delimiter: str, part: Column | int) -> Column:
    """1-based; parts before the first or past the last are empty."""
    part = F.lit(part) if isinstance(part, int) else part
    if not delimiter:
        return F.when(part == 1, text).otherwise(F.when(text.isNotNull(), F.lit("")))
    return F.when(part > 0, F.split_part(text, F.lit(delimiter), F.greatest(part, F.lit(1)))).otherwise(F.when(text.isNotNull(), F.lit("")))


def repeat(text: Column, times: Column | int) -> Column:
    return F.repeat(text, F.greatest(F.lit(times) if isinstance(times, int) else times, F.lit(0)))


def sha2(text: Column, bits: int = 256) -> Column:
    """256 bits, also named 0; other widths give NULL."""
    return F.sha2(text, 256) if bits in (0, 256) else F.lit(None).cast("string")
