"""Packing documents into fixed-length training windows by the sum-of-squares rule."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import small_batches, written
from sparkweave.llm.textblocks import Words, chunks, lower_ascii, piece_hashes, runs, text_bytes, trim_memory

PIECES = "doc_id long, start long, length long, doc_tokens long, block long, ids binary"
PACKED = PIECES + ", sequence_id long, offset long"

#: A separator that word-wise tokenizers give one id of its own; units that contain it are encoded alone.
_SEPARATOR = "|"

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[list(b'!"#$%&()*+,-./:;=?@[]^_`{|}~')] = True


def units_of(texts: pa.Array) -> Words:
    """Words, cut further where a letter a-z meets a mark other than an apostrophe or an angle bracket, with A-Z lower-cased.

    A word-wise tokenizer that lower-cases never joins across such a place, so these parts repeat more often than words
    and have the same ids. Words with an angle bracket, as special tokens have, stay as they are.
    """
    data, offsets = text_bytes(texts)
    low = lower_ascii(data)
    first, last = runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    cut = np.flatnonzero(_LETTER[low[:-1]] & _MARK[low[1:]]) + 1
    at = np.searchsorted(first, cut, "right") - 1
    inside = cut < last[at]  # else a text begins there
    cut, at = cut[inside], at[inside]
    brackets = np.flatnonzero(low == 60)
    if len(brackets):
        special = np.unique(np.searchsorted(first, brackets, "right") - 1)
        cut = cut[~np.isin(at, special)]
        for a, b in zip(first[special].tolist(), last[special].tolist(), strict=True):
            low[a:b] = data[a:b]
    starts, ends = np.sort(np.concatenate((first, cut))), np.sort(np.concatenate((last, cut)))
    return Words(low, offsets, starts, ends, piece_hashes(low, starts, ends), np.searchsorted(starts, offsets))


class WordEncoder:
    """Ids of whole texts, from the ids of their units.

    Right for tokenizers that lower-case, drop white space and never join across it. Each distinct unit is encoded once and
    kept in arrays: an open-addressing table from its hash to its number, and the ids of all units one after the other. The table is emptied when it
    has ``limit`` units, so it is bounded; a single chunk of text with more than that gets a larger one.
    """

    def __init__(self, path: str, limit: int = 600_000, joined: int = 256):
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.joined = limit, joined
        (self.mark,) = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self._reset(limit)

    @classmethod
    def of_process(cls, path: str) -> WordEncoder:
        """The encoder that this Python process keeps from one task to the next, until drop_encoders(). It encodes on the task's own core: threads for all cores of the
        machine would each hold memory of their own, in each worker."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept = vars(tokenizers).setdefault("_sparkweave_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _reset(self, units: int) -> None:
        slots = 1 << (2 * units).bit_length()
        self.keys = np.zeros(slots, np.uint64)
        self.number = np.full(slots, -1, np.int32)
        self.units, self.used, self.room = 0, 0, max(units, self.limit)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(units + 2, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's unit, -1 where there is none."""
        last = np.uint64(len(self.keys) - 1)
        at = (hashes & last).astype(np.int64)
        found = self.number[at]
        pending = np.flatnonzero((found >= 0) & (self.keys[at] != hashes))
        while len(pending):
            step = (at[pending] + 1) & int(last)
            at[pending] = step
            found[pending] = self.number[step]
            pending = pending[(found[pending] >= 0) & (self.keys[step] != hashes[pending])]
        return found

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that the table doesn't have. Of several that want one free slot the last gets it, the others go on to the next."""
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        while len(hashes):
            free = self.number[at] < 0
            self.keys[at[free]], self.number[at[free]] = hashes[free], numbers[free]
            rest = self.number[at] != numbers
            hashes, numbers, at = hashes[rest], numbers[rest], (at[rest] + 1) & last

    def _store(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = self.units
        self.ends[at + 1 : at + 1 + len(hashes)] = self.ends[at] + np.cumsum(lengths)
        self._insert(hashes, np.arange(at, at + len(hashes), dtype=np.int32))
        self.units += len(hashes)

    def _learn(self, hashes: np.ndarray, words: list[str], odd: bool) -> None:
        plain = np.ones(len(words), bool)
        if odd:
            plain = np.array(["|" not in w and "<" not in w for w in words], bool)
            for i in np.flatnonzero(~plain).tolist():
                ids = self.tokenizer.encode(words[i], add_special_tokens=False).ids
                self._store(hashes[i : i + 1], np.array(ids, np.uint32), np.array([len(ids)]))
            words = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        hashes = hashes[plain]
        for i in range(0, len(words), 64 * self.joined):
            group = words[i : i + 64 * self.joined]
            texts = [f" {_SEPARATOR} ".join(group[j : j + self.joined]) + f" {_SEPARATOR}" for j in range(0, len(group), self.joined)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            marks = np.flatnonzero(ids == self.mark)
            self._store(hashes[i : i + len(group)], ids[ids != self.mark], np.diff(marks, prepend=-1) - 1)

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``last``, and where each text's ids begin (and the end)."""
        words = units_of(texts)
        data = words.data
        index = self._find(words.hashes)
        fresh = np.flatnonzero(index < 0)
        if len(fresh):
            distinct, where = np.unique(words.hashes[fresh], return_index=True)
            if self.units + len(distinct) > self.room:
                fresh = np.arange(len(words.hashes))
                distinct, where = np.unique(words.hashes, return_index=True)
                self._reset(max(self.limit, len(distinct)))
            where = fresh[where]
            new = [bytes(data[a:b]).decode() for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)]
            self._learn(distinct, new, odd=bool((data == 124).any() or (data == 60).any()))
            index[fresh] = self._find(words.hashes[fresh])
        begins = self.ends[index]
        lengths = self.ends[index + 1] - begins
        sums = np.concatenate(([0], np.cumsum(lengths)))
        first = sums[words.first] + np.arange(len(words.first))
        out = np.empty(int(first[-1]), np.uint32)
        # The ids of all words in a row, and where each of them goes: on by one for each text that ended before.
        source = np.arange(int(sums[-1])) + np.repeat(begins - sums[:-1], lengths)
        own = np.ones(len(out), bool)
        own[first[1:] - 1] = False
        out[own] = self.pool[source]
        out[first[1:] - 1] = last
        return out, first


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, block: str | None = None) -> DataFrame:
    """Rows of PIECES: every document's ids, cut at multiples of ``window``. ``ids`` are little-endian, of 2 bytes each where the vocabulary allows it, else 4.
    ``block`` is the value of the column of that name, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_process(tokenizer_path)
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in chunks(batch):
                ids, first = encoder.encode(part.column("text"), end_id)
                size = np.diff(first)
                pieces = -(-size // window)
                doc = np.repeat(np.arange(len(size)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(size[doc] - start, window)
                raw = ids.astype(kind)
                begins = (first[:-1][doc] + start) * raw.itemsize
                # Pieces follow each other without gaps, so their bytes are one buffer with offsets.
                blob = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(begins, first[-1] * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)])
                table = pa.table(
                    {
                        "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                        "start": start.astype(np.int64),
                        "length": length.astype(np.int64),
                        "doc_tokens": size[doc].astype(np.int64),
                        "block": part.column("block").take(pa.array(doc)),
                        "ids": blob.cast(pa.binary()),
                    }
                )
                yield from table.to_batches(max_chunksize=2000)
            trim_memory()

    number = F.col(f"`{block}`") if block else F.lit(None)
    return docs.select("doc_id", "text", number.cast("long").alias("block")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places items online: (bin, offset) of each item, and the fill of each bin.

    ``level[h]`` counts the open bins filled to h. An item of size s goes to the level, or to a new bin, for which the sum of
    squared counts of partially filled bins becomes least; of equal ones to the fullest.
    """
    level = np.zeros(window + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    after = np.empty(window + 1, np.int64)
    for i, s in enumerate(lengths.tolist()):
        # Cost of h -> h + s: the level left falls to count - 1, the level reached rises by one; full and empty bins don't count.
        now = level[: window - s + 1]
        after[: len(now)] = 2 * level[s : window + 1] + 1
        after[window - s] = 0
        cost = np.where(now > 0, after[: len(now)] - 2 * now + 1, np.iinfo(np.int64).max)
        cost[0] = after[0]
        h = len(cost) - 1 - int(cost[::-1].argmin())
        if h:
            level[h] -= 1
            b = open_at[h].pop()
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, h
        fill[b] = h + s
        if h + s < window:
            level[h + s] += 1
            open_at[h + s].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _place(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for all items.

    The sum-of-squares rule places everything first. Of the bins that it leaves open, as many of the fullest as the open bins' tokens fill stay as they
    are; the pieces of the others are cut to fill their gaps, and what is left over goes to sequences of power-of-two lengths. So no more is moved than the
    gaps of the bins that stay.
    """
    bins, offsets, fill = sum_of_squares(lengths, window)
    open_ = np.flatnonzero(fill < window)
    open_ = open_[np.argsort(-fill[open_], kind="stable")]
    total = int(fill[open_].sum())
    moved = np.zeros(len(fill), bool)
    moved[open_[total // window :]] = True
    moved = moved[bins]
    out = [(i, 0, int(lengths[i]), int(bins[i]), int(offsets[i])) for i in np.flatnonzero(~moved).tolist()]
    # Where there is room: (sequence, offset, length), the gaps first.
    room = [(b, int(fill[b]), window - int(fill[b])) for b in open_[: total // window].tolist()]
    sizes = [1 << k for k in range(window.bit_length() - 1, -1, -1) if total % window >> k & 1]
    room += [(len(fill) + n, 0, size) for n, size in enumerate(sizes)]
    room.reverse()
    rest = np.flatnonzero(moved)
    for i in rest[np.lexsort((offsets[rest], bins[rest], -fill[bins[rest]]))].tolist():
        start = 0
        while start < lengths[i]:
            sequence, at, free = room.pop()
            take = min(int(lengths[i]) - start, free)
            out.append((i, start, take, sequence, at))
            start += take
            if take < free:
                room.append((sequence, at + take, free - take))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, docs_per_group: int = 10_000, block: str | None = None) -> DataFrame:
    """Rows of PACKED, one per piece: ``ids`` (little-endian unsigned 32-bit) fill sequence ``sequence_id`` from ``offset`` on.

    Method. Documents are encoded whole. Full windows are sequences of their own. Remainders are placed online by the sum-of-squares rule in a level array, group
    by group; see _place() for the windows that stay open at a group's end, some of which are cut, so that no sequence needs padding. Groups are those of
    the column ``block`` (0 to 2**38 - 1, with some 10,000 documents for each value, such as ranges of training positions), which comes back as a column; without it documents are
    dealt by a hash into groups of about ``docs_per_group``. A group's order is doc_id, start, then length, so reruns agree.

    Defined cases: a null or empty text is ``end_id`` alone; a null doc_id and repeated rows are packed like others; very long texts give
    many full windows. An empty table gives an empty result. Further columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)
    pieces = written(encode_pieces(docs, tokenizer_path, end_id, window, block), "pack-pieces")
    if not block:
        groups = max(1, -(-pieces.where("start = 0").count() // docs_per_group))
        pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(groups)))
    whole = pieces.where(F.col("length") == window)
    rest = pieces.where(F.col("length") < window)

    def wide(blobs: list[bytes], ids: int) -> pa.Array:
        """Ids of 2 or 4 bytes as ids of 4, text by text."""
        raw = b"".join(blobs)
        width = len(raw) // max(ids, 1)
        ends = np.concatenate(([0], np.cumsum([len(b) // max(width, 1) for b in blobs]))) * 4
        values = np.frombuffer(raw, f"<u{width or 4}").astype("<u4")
        return pa.Array.from_buffers(pa.binary(), len(blobs), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids", "ascending")]).combine_chunks()
        lengths = table.column("length").to_numpy()
        placed = sorted(_place(lengths, window), key=lambda x: (x[3], x[4]))
        item, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*placed, strict=True))
        blobs = table.column("ids").combine_chunks()
        width = len(blobs[0].as_buffer()) // int(lengths[0])
        cut = [blobs[i].as_buffer()[a * width : (a + n) * width].to_pybytes() for i, a, n in zip(item.tolist(), start.tolist(), length.tolist(), strict=True)]
        taken = table.select(["doc_id", "start", "doc_tokens", "block"]).take(pa.array(item))
        out = pa.table(
            {
                "doc_id": taken.column("doc_id"),
                "start": taken.column("start").to_numpy() + start,
                "length": length,
                "doc_tokens": taken.column("doc_tokens"),
                "block": taken.column("block"),
                "ids": wide(cut, int(length.sum())),
                "sequence_id": sequence,
                "offset": offset,
            }
        )
        del table, blobs, cut, taken, placed
        trim_memory()
        return out

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                at = batch.schema.get_field_index("ids")
                ids = wide([x.as_buffer().to_pybytes() for x in batch.column(at)], int(batch.column("length").to_numpy().sum()))
                yield batch.set_column(at, "ids", ids)
            trim_memory()

    # Each group numbers its sequences from 0.
    packed = rest.groupBy("block").applyInArrow(place, PACKED).withColumn("sequence_id", (F.shiftleft("block", 24) + F.col("sequence_id")) * 2 + 1)
    alone = whole.select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.mapInArrow(widen, PACKED).unionAll(packed)
