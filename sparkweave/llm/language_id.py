"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import small_batches
from sparkweave.llm.textblocks import CHUNK_BYTES, chunks, drop_encoders, lower_ascii, mix, text_bytes, trim_memory

SCHEMA = "lang_pred string, score double, n_grams long, hits array<double>"

#: A mask has one bit for each language; with more languages than bits, there are several masks.
MASK_BITS = 64

_LETTER = regex.compile(r"\p{L}")

#: Bytes that belong to words: ASCII letters and every byte of characters beyond ASCII; the rest counts as a space.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True


@dataclass(frozen=True)
class LanguageFilters:
    """``slices[m][p]`` has a bit for each of the m-th MASK_BITS languages whose filter has position p set. ``false_rate``: per language."""

    languages: tuple[str, ...]
    slices: tuple[np.ndarray, ...]
    false_rate: np.ndarray
    sizes: tuple[int, ...]
    hashes: int

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """Bit masks per gram, one array for each MASK_BITS languages: all languages whose filters contain it."""
        positions = np.uint64(len(self.slices[0]) - 1)
        step = grams >> np.uint64(40) | np.uint64(1)
        found: list[np.ndarray] = []
        for k in range(self.hashes):
            at = ((grams + np.uint64(k) * step) & positions).astype(np.int64)
            found = [f & s[at] for f, s in zip(found, self.slices, strict=True)] if k else [s[at] for s in self.slices]
        return found


def gram_stretches(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and text numbers of all byte n-grams of lower-cased words with a space on either side; runs of other characters count as one space.

    They come in stretches of bounded length, so a long text takes no more memory than many short ones.
    """
    low = lower_ascii(data)
    inside = _WORD_BYTE[low]
    low[~inside] = 32
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep = inside.copy()
    keep[1:] |= inside[:-1] & (text[1:] == text[:-1])
    low, text = low[keep], text[keep]
    for begin in range(0, len(low), CHUNK_BYTES):
        for n in sizes:
            part, owner = low[begin : begin + CHUNK_BYTES + n - 1], text[begin : begin + CHUNK_BYTES + n - 1]
            count = len(part) - n + 1
            if count <= 0:
                continue
            packed = np.zeros(count, np.uint64)
            for j in range(n):
                packed = packed << np.uint64(8) | part[j : j + count].astype(np.uint64)
            whole = owner[n - 1 :] == owner[:count]
            yield mix(packed[whole] ^ np.uint64(n << 59)), owner[:count][whole]


def grams_of(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """All stretches together."""
    every = list(gram_stretches(data, offsets, sizes))
    if not every:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate([g for g, _ in every]), np.concatenate([o for _, o in every])


def fit_filters(
    docs: DataFrame,
    trains: Column | None = None,
    rows_per_language: int = 4000,
    grams_per_language: int = 60_000,
    min_share: float = 2e-6,
    sizes: Sequence[int] = (3, 4, 5),
    bits: int = 22,
    hashes: int = 3,
) -> LanguageFilters:
    """Fits filters on a bounded sample of labelled rows (text, lang) for which ``trains`` holds.

    The sample has at most ``rows_per_language`` rows of each language, the first ones by a hash of text and doc_id, and is
    read whole. A language's filter gets its ``grams_per_language`` most frequent n-grams, of those with a share
    of over ``min_share``. Only these, and one row for each language, reach the driver: the filters take 2**bits positions times
    one bit for each language, whatever the size of the input. There may be any number of languages.
    """
    rows = pick(docs if trains is None else docs.where(trains), "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["of"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")).collect()}
    # A hash under a language's threshold pre-selects rows where they are read; the window then takes the exact number.
    limits = [x for lang, of in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, (1.3 * rows_per_language + 200) / of) * (1 << 30)))]
    threshold = F.coalesce(F.element_at(F.create_map(*limits), F.col("lang")), F.lit(0.0)) if limits else F.lit(0.0)
    keyed = rows.select("lang", "text", F.xxhash64("text", "doc_id").alias("key")).where(F.pmod("key", F.lit(1 << 30)) < threshold)
    first = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "text")
    sample = keyed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for part in chunks(batch):
                grams, owner = grams_of(*text_bytes(part.column("text")), sizes)
                names, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                for k, name in enumerate(names):
                    gram, n = np.unique(grams[code[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(gram), pa.string()), "gram": gram.view(np.int64), "n": n.astype(np.int64)})
                del grams, owner
            trim_memory()

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    shares = total.withColumn("all", F.sum("n").over(Window.partitionBy("lang"))).withColumn("rank", F.row_number().over(best))
    chosen = shares.where((F.col("rank") <= grams_per_language) & (F.col("n") > min_share * F.col("all"))).select("lang", "gram").toArrow()

    languages = tuple(sorted(chosen.column("lang").unique().to_pylist()))
    width = next((w for w in (1, 2, 4) if 8 * w >= len(languages)), MASK_BITS // 8)
    slices = tuple(np.zeros(1 << bits, np.dtype(f"u{width}")) for _ in range(max(1, -(-len(languages) // MASK_BITS))))
    grams = chosen.column("gram").to_numpy().view(np.uint64)
    number = {lang: i for i, lang in enumerate(languages)}
    code = np.array([number[x] for x in chosen.column("lang").to_pylist()], np.int64)
    step = grams >> np.uint64(40) | np.uint64(1)
    for m, part in enumerate(slices):
        own = code // MASK_BITS == m
        bit = (np.uint64(1) << (code[own] % MASK_BITS).astype(np.uint64)).astype(part.dtype)
        for k in range(hashes):
            np.bitwise_or.at(part, ((grams[own] + np.uint64(k) * step[own]) & np.uint64(len(part) - 1)).astype(np.int64), bit)
    filled = np.array([bits_of(slices, i).mean() for i in range(len(languages))])
    return LanguageFilters(languages, slices, filled**hashes, tuple(sizes), hashes)


def bits_of(masks: Sequence[np.ndarray], language: int) -> np.ndarray:
    """One language's bits, 0 or 1, of masks or slices."""
    mask = masks[language // MASK_BITS]
    return (mask >> mask.dtype.type(language % MASK_BITS)) & mask.dtype.type(1)


def identify_languages(docs: DataFrame, filters: LanguageFilters, carry: Sequence[str] = ("doc_id",), explained: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the columns that ``carry`` names, lang_pred, score, n_grams and the corrected
    hits of each language.

    Method. Every n-gram of a text asks the bit-sliced filters once and gets the mask of all languages that contain it. Population
    counts of each bit over the text, less the hits that a filter of that fill would give by chance
    (hits - n * rate) / (1 - rate), decide; n-grams that all languages contain cancel out. ``score`` is the winner's share of the n-grams, 0 to 1.
    With ``explained``, a column of that name has the share of the n-grams that any language contains, corrected in the same way.

    Defined cases: lang_pred is ``und`` with a score of 0 if the text is null, has no letters, or no language was learned; equal hits go to
    the language that sorts first. A null doc_id and repeated rows are rows of their own. Whole texts count, however long.
    An empty table gives an empty result. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slices, filters.false_rate, filters.sizes, filters.hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        f = LanguageFilters(*shared.value)
        for batch in batches:
            for part in chunks(batch):
                texts = part.num_rows
                total, hits, anywhere = np.zeros(texts, np.int64), np.zeros((texts, max(1, len(f.languages)))), np.zeros(texts)
                grams = owner = masks = None
                for grams, owner in gram_stretches(*text_bytes(part.column("text")), f.sizes):
                    total += np.bincount(owner, minlength=texts)
                    masks = f.masks(grams)
                    if explained:
                        anywhere += np.bincount(owner, functools.reduce(np.logical_or, masks), texts)
                    for i in range(len(f.languages)):
                        hits[:, i] += np.bincount(owner, bits_of(masks, i), texts)
                rate = f.false_rate if len(f.languages) else np.zeros(1)
                corrected = np.maximum(hits - total[:, None] * rate, 0) / (1 - rate)
                best = corrected.argmax(1)
                letters = np.array([bool(t) and _LETTER.search(t) is not None for t in part.column("text").to_pylist()], bool)
                known = letters & bool(f.languages)
                score = np.where(known, np.minimum(corrected[np.arange(texts), best] / np.maximum(total, 1), 1.0), 0.0)
                by_chance = 1 - np.prod(1 - rate)
                share = np.maximum(anywhere / np.maximum(total, 1) - by_chance, 0) / (1 - by_chance)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: part.column(c) for c in carry},
                        "lang_pred": pa.array([f.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                        "score": score,
                        "n_grams": total,
                        "hits": pa.array(list(corrected), pa.list_(pa.float64())),
                        **({"explained": share} if explained else {}),
                    }
                )
                del grams, owner, masks
            trim_memory()

    rows = pick(docs, *dict.fromkeys((*carry, "text")))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in carry], *T.StructType.fromDDL(SCHEMA + ", explained double" * explained).fields]))
