"""Words and hashes of whole texts, computed over the bytes of Arrow batches with numpy.

All arithmetic on hashes is modulo 2**64. A piece of text is hashed as a polynomial over its bytes and then mixed; prefix
sums give every piece of a chunk at once, so the cost per byte doesn't depend on the number or length of words.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept until trim_memory(); n is bounded by the length of a stretch."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drop_encoders() -> None:
    """Lets go of the encoders that packing keeps in this Python process: workers serve one operator after the other, and the others have no use for them."""
    if module := sys.modules.get("tokenizers"):
        vars(module).pop("_sparkweave_encoders", None)


def trim_memory() -> None:
    """Gives memory that is free in this Python process back to the system, so that workers of one executor don't each hold their peak."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each piece take about ``limit`` bytes."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run ends where a text ends."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    begins, stops = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins] |= inside[begins]
    last[stops] |= inside[stops]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _polynomial(data: np.ndarray) -> np.uint64:
    """The sum of data[i] * base**i, stretch by stretch."""
    total = 0
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES].astype(np.uint64)
        inner = int(np.sum(part * _powers(_BASE, CHUNK_BYTES + 1)[: len(part)], keepdims=True)[0])
        total = (total + inner * pow(_BASE, at, 1 << 64)) % (1 << 64)
    return np.uint64(total)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each piece and of its length. Pieces are in order and don't overlap. They are worked off in stretches, and so
    is a piece that is longer than one, so the memory this takes doesn't grow with a text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right"))
        if j <= i:
            out[i] = _polynomial(data[starts[i] : ends[i]])
            i += 1
            continue
        low, high = int(starts[i]), int(ends[j - 1])
        first, last = starts[i:j] - low, ends[i:j] - low
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(data[low:high].astype(np.uint64) * _powers(_BASE, CHUNK_BYTES + 1)[: high - low], out=sums[1:])
        out[i:j] = (sums[last] - sums[first]) * _powers(_INVERSE, CHUNK_BYTES + 1)[first]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """The words of several texts, in order. ``first``: index of each text's first word, and the number of words at the end."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(column: pa.Array, lower: bool) -> Words:
    """Runs of bytes other than white space (0x20, 0x09-0x0D), which are the same as runs of such characters."""
    data, offsets = text_bytes(column)
    if lower:
        data = lower_ascii(data)
    starts, ends = runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    return Words(data, offsets, starts, ends, piece_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words; a text with fewer words gives its whole sequence as one."""
    count = len(words.hashes)
    text = words.text
    left = words.first[1:][text] - np.arange(count)
    rolled = np.zeros(count, np.uint64)
    padded = np.concatenate((words.hashes, np.zeros(width, np.uint64)))
    for j in range(width):
        rolled = np.where(left > j, rolled * np.uint64(_BASE) + padded[j : j + count], rolled)
    keep = left >= width
    begins = words.first[:-1][words.counts > 0]
    keep[begins] = True
    length = np.minimum(left[keep], width).astype(np.uint64)
    return mix(rolled[keep] ^ (length * np.uint64(0xA0761D6478BD642F))), text[keep]


def shuffle_planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, one plane after the other, which compresses well."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return wide[:, :width].T.tobytes()


def gather_planes(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    if not count or not width:
        return wide.view("<u8").reshape(-1)
    wide[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(width, count).T
    return wide.view("<u8").reshape(-1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned values: their number, the bytes each takes, and the values in planes."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return len(values).to_bytes(4, "little") + bytes([width]) + shuffle_planes(values, width)


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """What pack() was given, and the position after it."""
    count, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
    stop = at + 5 + count * width
    return gather_planes(memoryview(data)[at + 5 : stop], count, width), stop


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values: their number, the first in eight bytes, and their differences."""
    if not len(values):
        return (0).to_bytes(4, "little")
    return len(values).to_bytes(4, "little") + int(values[0]).to_bytes(8, "little") + pack(np.diff(values))


def unpack_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    count = int.from_bytes(data[at : at + 4], "little")
    if not count:
        return np.zeros(0, np.uint64), at + 4
    values = np.empty(count, np.uint64)
    values[0] = int.from_bytes(data[at + 4 : at + 12], "little")
    values[1:], stop = unpack(data, at + 12)
    return np.cumsum(values, dtype=np.uint64), stop
