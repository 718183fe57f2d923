"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the byte-wise lower(), others translate()."""
    translated = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(translated)


def word_count(text: Column) -> Column:
    """Number of words in the whole text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the caller cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
