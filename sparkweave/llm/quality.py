"""Quality rules: word and line statistics, and compression bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import small_batches
from sparkweave.llm.textblocks import Words, chunks, piece_hashes, trim_memory, windows, words_of


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``from_bytes`` bytes: compressed size over plain size, for a whole text and for one chunk."""

    from_bytes: int
    low: float
    high: float
    chunk_low: float
    chunk_high: float


#: A bounded fit, on the 3,409 clean and 571 low-quality labels of the table 0.1 (labels.parquet) at zstandard level 3: from 362 to 32,768 bytes, the lower
#: limits lie about 0.005 below the ratio that 99.5 % of the clean texts of that length reach; shorter and longer ones are carried on with more room. The upper limits lie between the
#: highest clean ratios (0.72 from 256 bytes, 0.52 from 2,048, 0.43 from 16,384) and those of random base64 words (0.80 at 600 bytes, 0.73 at 3,000).
BANDS = (
    Band(0, 0.00, 9.99, 0.00, 9.99),
    Band(256, 0.540, 0.82, 0.00, 9.99),
    Band(362, 0.535, 0.78, 0.00, 9.99),
    Band(512, 0.528, 0.74, 0.00, 9.99),
    Band(724, 0.508, 0.70, 0.00, 9.99),
    Band(1024, 0.488, 0.66, 0.42, 0.66),
    Band(1448, 0.473, 0.66, 0.42, 0.66),
    Band(2048, 0.460, 0.62, 0.42, 0.62),
    Band(2896, 0.447, 0.62, 0.42, 0.62),
    Band(4096, 0.434, 0.60, 0.42, 0.62),
    Band(5793, 0.424, 0.60, 0.42, 0.62),
    Band(8192, 0.417, 0.60, 0.42, 0.62),
    Band(11585, 0.410, 0.60, 0.42, 0.62),
    Band(16384, 0.398, 0.60, 0.42, 0.62),
    Band(32768, 0.370, 0.60, 0.42, 0.62),
    Band(65536, 0.330, 0.60, 0.42, 0.62),
)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, chunk_low double, chunk_high double, bad_chunks long, n_chunks long, kept boolean"
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeat_words(words: Words) -> np.ndarray:
    """Per text, the words that lie in a three-word window found twice or more in that text."""
    count = len(words.hashes)
    covered = np.zeros(count + 1, bool)
    if count:
        hashes, text = windows(words, 3)
        full = words.counts[text] >= 3
        hashes, text = hashes[full], text[full]
        left = words.first[1:][words.text] - np.arange(count)
        begins = np.flatnonzero(left >= 3)
        order = np.lexsort((hashes, text))
        h, t = hashes[order], text[order]
        same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        repeated = np.zeros(len(h), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        at = begins[order[repeated]]
        for j in range(3):
            covered[at + j] = True
    sums = np.concatenate(([0], np.cumsum(covered)))
    return sums[words.first[1:]] - sums[words.first[:-1]]


def _duplicate_lines(words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of that text."""
    data, offsets = words.data, words.offsets
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    text = np.concatenate((np.arange(texts), text_of_break))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(text[1:] != text[:-1], True)
    ends[last] = offsets[1:][text[last]]
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    hashes = piece_hashes(data, starts, ends)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    again = t[1:][(h[1:] == h[:-1]) & (t[1:] == t[:-1])]
    return np.bincount(again, minlength=texts)


def _base(words: Words) -> dict[str, np.ndarray]:
    data, offsets = words.data, words.offsets
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points begun before each byte
    length = letters[words.ends] - letters[words.starts]
    per_word = np.concatenate(([0], np.cumsum(length)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    n_words = words.counts
    repeat = _repeat_words(words)
    return {
        "n_words": n_words,
        "word_chars": per_word[words.first[1:]] - per_word[words.first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _duplicate_lines(words),
        "n_repeat_words": repeat,
        "base_failed": (n_words < 50) | (100 * repeat > 50 * n_words),
    }


def compression_quality(docs: DataFrame, bands: Sequence[Band] = BANDS, chunk_bytes: int = 4096, bad_share: float = 0.2, level: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): statistics of the words, compression ratios and the verdict.

    Method. Every text is compressed with zstandard, whole and in fixed chunks of ``chunk_bytes``
    bytes (a last chunk of under half that length joins the one before). The band for the text's length limits the whole ratio on both sides:
    below it the text repeats itself, above it the text can't be compressed, as random characters or encoded data. A chunk outside
    the band's chunk limits is bad; the text fails when over ``bad_share`` of its chunks are,
    or when the base rules fail it: under 50 words, or over half of its words in repeated three-word windows.

    Defined cases: a null or empty text has no words, a ratio of null, and fails; a null doc_id and repeated rows are kept as rows of
    their own. Whole texts are read, however long. An empty table gives an empty result. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    bands = sorted(bands, key=lambda b: b.from_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_content_size=False)

        def verdict(text: memoryview) -> tuple[float, float, float, int, int, bool]:
            size = len(text)
            band = next(b for b in reversed(bands) if b.from_bytes <= size)
            ratio = len(packer.compress(text)) / size
            pieces = max(1, (size + chunk_bytes // 2) // chunk_bytes)
            cuts = [i * chunk_bytes for i in range(pieces)] + [size]
            each = [ratio] if pieces == 1 else [len(packer.compress(text[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            bad = sum(not band.chunk_low <= x <= band.chunk_high for x in each)
            good = band.low <= ratio <= band.high and bad <= bad_share * pieces
            return ratio, min(each), max(each), bad, pieces, good

        for batch in batches:
            for part in chunks(batch):
                words = words_of(part.column("text"), lower=False)
                base = _base(words)
                view = memoryview(words.data)
                found = [verdict(view[a:b]) if b > a else (None, None, None, 0, 0, False) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
                ratio, low, high, bad, pieces, good = zip(*found, strict=True)
                columns = {"doc_id": part.column("doc_id").cast(pa.int64())}
                columns |= {k: pa.array(v) for k, v in base.items()}
                columns |= {k: pa.array(v, pa.float64()) for k, v in (("ratio", ratio), ("chunk_low", low), ("chunk_high", high))}
                columns |= {"bad_chunks": pa.array(bad, pa.int64()), "n_chunks": pa.array(pieces, pa.int64())}
                columns["kept"] = pa.array(~base["base_failed"] & np.array(good, bool))
                yield pa.RecordBatch.from_pydict(columns)
                del words, view
            trim_memory()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
