"""Token counts of sections, from whole documents encoded once."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import small_batches
from sparkweave.llm.textblocks import chunks, text_bytes, trim_memory

SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"

RULES = ("majority", "first", "last")


def load_ranks(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A byte-level encoding from a file of ranks, and the number of bytes of each id."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and which tokens cross a boundary; both are given by the byte offsets at which they end.

    A token lies in the sections from that of its first byte to that of its last. ``first`` and ``last`` name the one that gets a
    crossing token; ``majority`` gives it to the section with the most of its bytes, the earliest of equal ones.
    """
    starts = token_ends - np.diff(token_ends, prepend=0)
    low = np.searchsorted(section_ends, starts, "right")
    high = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = high > low
    if rule == "last":
        return high, crossing
    chosen = low.copy()
    if rule == "majority":
        for i in np.flatnonzero(crossing).tolist():
            cuts = np.concatenate(([starts[i]], section_ends[low[i] : high[i]], [token_ends[i]]))
            chosen[i] = low[i] + int(np.diff(cuts).argmax())
    return chosen, crossing


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """One row per section of each row of ``docs`` (doc_id, text): its characters, its tokens, and those that cross into a later section.

    Method. A document is encoded once, whole. Ids of a byte-level vocabulary have a fixed number of bytes, so running sums give
    every token's span; an interval join by binary search attributes tokens to sections, and ``rule`` allocates the tokens that
    cross a boundary (see attribute()). A section is a line with the line feed that ends it; a text's last
    line feed begins no further section. So sections cover the text and
    the counts of a document add up to its number of tokens.

    Defined cases: a null or empty text has one empty section without tokens; a null doc_id and repeated rows give rows of their own.
    Whole texts are encoded, however long. An empty table gives an empty result. Further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = load_ranks(ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                breaks = np.flatnonzero(data == 10) + 1
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for i, text in enumerate(part.column("text").to_pylist()):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    own = breaks[np.searchsorted(breaks, begin, "right") : np.searchsorted(breaks, end, "left")]
                    ends = np.append(own, end) - begin
                    ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                    token_ends = np.cumsum(size[ids])
                    section, crossing = attribute(token_ends, ends, rule)
                    starts = np.concatenate(([0], ends[:-1]))
                    values = (
                        np.full(len(ends), i),
                        np.arange(len(ends)),
                        chars[begin + starts] - chars[begin],
                        chars[begin + ends] - chars[begin],
                        np.bincount(section, minlength=len(ends)),
                        np.bincount(section[crossing], minlength=len(ends)),
                    )
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                flat = [np.concatenate(c).astype(np.int64) for c in columns]
                ids = part.column("doc_id").cast(pa.int64()).take(pa.array(flat[0]))
                names = ("doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing")
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, flat[1:])], names=names)
                del columns, flat, data, chars, breaks
            trim_memory()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
