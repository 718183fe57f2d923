"""Texts of over a mebibyte, which take several chunks or stretches, and rows that repeat or have no doc_id, against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweave.llm import katz, language_id, packing, pii, quality, secret_scan, textblocks, token_counts

from .test_models import BASE, LOWER, Brute
from .test_texts import TOKENIZER, brute_quality, brute_spans


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(21)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=250_000)) for _ in range(2)]
    one_word = "x" * (textblocks.CHUNK_BYTES * 2 + 7)
    texts += [one_word, "é" * textblocks.CHUNK_BYTES + " end", " ".join(rng.choices(words, k=40)) + "\n" * 5]
    texts[1] += " mail: someone@example.com token=abcdefgh12 +1 (555) 010-2000\n" * 3
    return [(i, t) for i, t in enumerate(texts)] + [(None, "short text"), (None, "short text"), (3, "another text of the same number")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_hashes_of_long_pieces_do_not_depend_on_stretches():
    data = np.frombuffer(bytes(random.Random(1).choices(range(256), k=3 * textblocks.CHUNK_BYTES)), np.uint8)
    whole = textblocks.piece_hashes(data, np.array([0]), np.array([len(data)]))[0]
    value, power, base = 0, 1, textblocks._BASE
    for at in range(0, len(data), 4096):
        block = data[at : at + 4096].tolist()
        for b in block:
            value = (value + b * power) % (1 << 64)
            power = power * base % (1 << 64)
    want = textblocks.mix(np.array([value], np.uint64) ^ (np.array([len(data)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[0]
    assert whole == want


def test_quality_of_long_texts(long_docs, long_rows):
    found = quality.compression_quality(long_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == Counter((i, *brute_quality(t)) for i, t in long_rows)


def test_packing_of_long_texts(long_docs, long_rows):
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in long_rows:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        want[i, len(ids), sum(ids)] += 1
    pieces = packing.pack_documents(long_docs, TOKENIZER).collect()
    assert sum(p.length for p in pieces) == sum(n * k for (_, n, _), k in want.items())
    for i, n, total in want:
        if i in (0, 1, 2, 4):
            own = sorted((p.start, p.length, sum(np.frombuffer(p.ids, "<u4").tolist())) for p in pieces if p.doc_id == i)
            assert [s for s, _, _ in own] == np.cumsum([0] + [k for _, k, _ in own])[:-1].tolist() and sum(k for _, k, _ in own) == n and sum(x for *_, x in own) == total


def test_sections_of_long_texts(long_docs, long_rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    found = Counter()
    for r in token_counts.section_token_counts(long_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        found[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t in long_rows:
        want[i] += len(plain.encode(t, add_special_tokens=False).ids)
    assert found == want


def test_katz_of_long_texts(long_docs, long_rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + ["</s>"]
    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 0
    assert any(learns(i) for i, _ in long_rows) and not all(learns(i) for i, _ in long_rows)
    model = Brute([words(t) for i, t in long_rows if learns(i)], 3)
    found = katz.katz_scores(long_docs, katz.crc32_of_id(F.col("doc_id")) % 3 != 0, order=3).collect()
    want = sorted(((i is None, i or 0, len(words(t))), model.score(words(t))) for i, t in long_rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.score) for r in found)
    for (a, x), (b, y) in zip(got, want, strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-7)


def test_secrets_and_personal_data_of_long_texts(long_docs, long_rows):
    found = secret_scan.scan_secrets(long_docs).collect()
    assert Counter((r.doc_id, tuple(map(tuple, r.found))) for r in found) == Counter((i, tuple(brute_spans(t))) for i, t in long_rows)
    spans = pii.find_personal_data(long_docs).collect()
    want = Counter()
    for i, t in long_rows:
        want[i, tuple(sorted((m.start(), m.end(), kind) for kind, pattern, good in BASE if kind != "email" or "@" in t for m in re.finditer(pattern, t) if good(m[0])))] += 1  # the plain expression is quadratic in a long word
    assert Counter((r.doc_id, tuple(sorted((s.start, s.end, s.kind) for s in r.spans if s.base))) for r in spans) == want


def test_languages_of_long_texts_and_repeated_rows(long_docs, long_rows):
    labelled = long_docs.withColumn("lang", F.when(F.col("doc_id") < 2, "a").otherwise("b"))
    found = language_id.identify_languages(long_docs, language_id.fit_filters(labelled, bits=18)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in long_rows)
    assert all(r.lang_pred == "a" for r in found if r.doc_id in (0, 1))
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id is None}) == 1
