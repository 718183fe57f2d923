"""Segmenting runs of ideographs by a dictionary that the caller gives."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+")


def best_words(run: str, words: Mapping[str, float], total: float, longest: int) -> list[str]:
    """The cut of a run into words with the greatest product of their shares; a character that is no word counts as one seen once. Of equal cuts, the one with the longer first word."""
    n = len(run)
    best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        choices = []
        for size in range(1, min(longest, n - i) + 1):
            count = words.get(run[i : i + size], 1.0 if size == 1 else 0.0)
            if count > 0:
                choices.append((math.log(count / total) + best[i + size][0], size))
        best[i] = max(choices)
    out, at = [], 0
    while at < n:
        size = best[at][1]
        out.append(run[at : at + size])
        at += size
    return out


def segmenter(words: Mapping[str, float], every_part: bool = False) -> Callable[[Column], Column]:
    """A function of a text column that puts spaces around the words of its runs of ideographs, so that any analyzer finds them. ``words``: dictionary words and how often they
    occur. With ``every_part``, the shorter dictionary words within a long one follow it, for searches.

    The dictionary goes to the workers with the function; text goes there in Arrow batches.
    """
    known = {w: float(c) for w, c in words.items() if c > 0}
    total, longest = max(sum(known.values()), 1.0), max(map(len, known), default=1)

    def spaced(text: str) -> str:
        def cut(match: re.Match[str]) -> str:
            out = []
            for word in best_words(match[0], known, total, longest):
                out.append(word)
                if every_part and len(word) > 2:
                    out += [word[i : i + k] for k in range(2, len(word)) for i in range(len(word) - k + 1) if word[i : i + k] in known]
            return f" {' '.join(out)} "

        return _RUN.sub(cut, text)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else spaced(t))

    return run
