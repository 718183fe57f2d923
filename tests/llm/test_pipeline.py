"""The pipeline's stages against plain Python, and the columns that the registered queries return."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparkweave.llm import registry, textblocks
from sparkweave.llm.ngram_join import _blocks
from sparkweave.llm.packing import WordEncoder
from sparkweave.llm.storage import written

from .test_pairs_and_copies import LOWER, shingles

SYLLABLES = {"en": "the ing er on th sh ly", "de": "sch ein ung ü keit cht pf", "fr": "eau oi é ment que è oux"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents in three languages with exact and near copies, a document without letters, and nulls."""
    rng = random.Random(11)
    rows = []
    for i in range(90):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        rows.append([i, " ".join(words), lang, f"s{i % 4}", 0])
    for i in range(20):
        rows.append([100 + i, rows[i][1].upper(), rows[i][2], "s0", 0])
        words = rows[i + 30][1].split(" ")
        words[len(words) // 2] = words[0] + "x"
        rows.append([200 + i, " ".join(words), rows[i + 30][2], "s1", 0])
    rows += [[300, "12345 678 !!!", "en", "s2", 0], [301, None, None, None, None], [302, "", "de", None, 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, {r[0]: r for r in rows}


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{n}-{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        yield docs


def test_stages_match_brute_force(spark, corpus):
    folder, rows = corpus
    identified, unique, apart, mixed, packed = stages(spark, folder)

    clean = {i for i, r in rows.items() if re.search(r"[^\W\d_]", r[1] or "")}
    assert {r.doc_id for r in identified.collect()} == clean
    assert all(r.lang == rows[r.doc_id][2] for r in identified.collect())

    groups = defaultdict(list)
    for i in clean:
        groups[rows[i][1].translate(LOWER)].append(i)
    kept = {min(ids) for ids in groups.values()}
    assert Counter(r.doc_id for r in unique.collect()) == Counter(kept)

    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(rows[i][1]) for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    leaders = {i for i in kept if find(i) == i}
    assert len(leaders) < len(kept)
    assert Counter(r.doc_id for r in apart.collect()) == Counter(leaders)

    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= leaders and max(taken.values()) <= 3
    words = lambda i: len(rows[i][1].split())
    sizes, wanted = Counter(), Counter()
    for i in leaders:
        sizes[rows[i][3]] += words(i)
    for i, n in taken.items():
        wanted[rows[i][3]] += n * words(i)
    shares = dict(zip(sorted(sizes), (5, 2, 1, 5), strict=True))
    total, capped = sum(sizes.values()), {}
    while over := [s for s in shares if s not in capped and (total - sum(capped.values())) * shares[s] / sum(shares[x] for x in shares if x not in capped) > 3 * sizes[s]]:
        capped |= {s: 3 * sizes[s] for s in over}
    for s in shares:
        target = capped.get(s) or (total - sum(capped.values())) * shares[s] / sum(shares[x] for x in shares if x not in capped)
        assert target - 1 <= wanted[s] <= target + 120  # the last document of a source comes whole

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(rows[i][1], add_special_tokens=False).ids, 1] for i in taken}
    pieces = packed.collect()
    assert sum(p.length for p in pieces) == sum(n * len(ids[i]) for i, n in taken.items())
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def test_run_applies_the_stages(spark, corpus):
    folder, _ = corpus
    *_, last = stages(spark, folder)
    assert corpus_pipeline.run(spark, folder).agg({"length": "sum"}).first()[0] == last.agg({"length": "sum"}).first()[0]


COLUMNS = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6": {"doc_id": "bigint", "section": "bigint", "n_tokens": "bigint"},
    "op7": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_return_their_columns(spark, corpus, name):
    folder, rows = corpus
    found = registry.queries()[name](spark, folder)
    assert COLUMNS[name.split("_")[0]].items() <= dict(found.dtypes).items()
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    assert ids == set(rows)


def test_short_and_mixed_documents_are_identified_or_kept(spark):
    rng = random.Random(3)

    def prose(lang, n):
        return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(2, 4))) for _ in range(n))

    rows = [(n, prose(lang, 80), lang) for n, lang in enumerate(list(SYLLABLES) * 20)]
    noise = "".join(rng.choice("qxzjvwkybg") + " " * (rng.random() < 0.2) for _ in range(3000))
    odd = {
        100: ("A.", "en"),
        101: ("x zq 7", None),
        102: (prose("de", 5) + ' token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add"', "de"),
        103: (prose("fr", 4) + " zqxj wvkk", "fr"),
        104: (" ".join(prose(lang, 60) for lang in SYLLABLES), "en"),
        105: (prose("de", 60) + " " + prose("fr", 50) + " " + prose("en", 50), "de"),
    }
    none = {200: (noise, "en"), 201: ("Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "en"), 202: ("12 34", "en"), 203: (None, "en")}
    rows += [(i, t, lang) for i, (t, lang) in (odd | none).items()]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    trained = corpus_pipeline.fit_filters(docs.where("doc_id < 100"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "fit_filters", lambda _: trained)
        found = {r.doc_id: r.lang for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert set(found) == {i for i, *_ in rows} - set(none)
    assert found[100] == "en" and found[101] is None and found[102] == "de" and found[103] == "fr"
    assert all(found[i] == lang for i, _, lang in rows if i < 100)


def test_null_and_repeated_ids_keep_their_own_decisions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(SYLLABLES["en"].split(), k=3))
    a, b, c, d, e, f = ([word() for _ in range(60)] for _ in range(6))
    near = [*a[:30], "zzz", *a[31:]]
    words = [(None, a), (None, near), (7, b), (7, b), (7, c), (None, d), (8, d), (9, e), (9, [*e[:30], "zzz", *e[31:]]), (None, f), (None, f)]
    rows = [(i, " ".join(w), "en", f"s{n % 2}", 0) for n, (i, w) in enumerate(words)]
    text = {name: " ".join(w) for name, w in zip("abcdef", (a, b, c, d, e, f), strict=True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    identified = corpus_pipeline.identify(spark, docs, "")
    assert pairs(identified) == Counter((i, t) for i, t, *_ in rows)

    unique = written(corpus_pipeline.drop_copies(spark, identified, ""), "test")
    assert pairs(unique) == Counter({(i, t) for i, t, *_ in rows} - {(None, text["d"])})

    apart = written(corpus_pipeline.drop_near_copies(spark, unique, ""), "test")
    found = pairs(apart)
    assert sorted(found.values()) == [1] * 6
    assert {(7, text["b"]), (7, text["c"]), (8, text["d"]), (None, text["f"])} < set(found)
    assert sum(i == 9 for i, _ in found) == 1 and len({t for i, t in found if i is None}) == 2

    # Every row once more as it is: rows that share a doc_id are read one by one, none by the decision of another.
    doubled = written(apart.unionAll(apart), "test")
    mixed = written(corpus_pipeline.mix(spark, doubled, ""), "test")
    reads = Counter()
    for r in registry.mix_sources(doubled).collect():
        reads[r.doc_id] += r.copies
    taken = pairs(mixed)
    assert Counter(r.doc_id for r in mixed.collect()) == +reads
    assert set(taken) <= set(found) and max(taken.values()) <= 6

    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.pack(spark, mixed, "").collect()
    assert len({p.block for p in packed}) >= 1 and all(p.block >= 0 for p in packed)
    assert sum(p.length for p in packed) == sum(n * (len(tokens.encode(t, add_special_tokens=False).ids) + 1) for (_, t), n in taken.items())


def test_training_order_reaches_the_packer(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["red", "green", "blue"], k=rng.randrange(5, 60))), "en", f"s{i % 3}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs = written(docs, "test")
    position = {(r.doc_id, n): p for r in registry.mix_sources(docs).collect() for n, p in enumerate(r.positions)}
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix(spark, docs, "").write.parquet(path)
    mixed = spark.read.parquet(path)
    at = corpus_pipeline._in_blocks(mixed, rows_per_block=7)
    blocks = Counter(r.block for r in at.select("block").collect())
    assert max(blocks.values()) <= 7 and sum(blocks.values()) == len(position)
    # Blocks are stretches of the order of positions.
    want = [i for (i, _), _ in sorted(position.items(), key=lambda x: x[1])]
    sums = defaultdict(list)
    for r in at.select("doc_id", "block").collect():
        sums[r.block].append(r.doc_id)
    place = 0
    for block in sorted(sums):
        expected = Counter(want[place : place + len(sums[block])])
        assert Counter(sums[block]) == expected
        place += len(sums[block])
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert set(packed.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "block"}


def test_stages_of_an_empty_table_and_clashing_columns(spark, empty):
    docs = empty
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs.selectExpr("*", "1 AS row", "2 AS position") if n < 4 else docs, ""), "test")
        assert docs.count() == 0


def test_a_stage_begins_with_collected_garbage(spark):
    """Heap that one stage has grown would be held, beside the Python workers, while the next one runs."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def full_collections():
        return sum(b.getCollectionCount() for b in beans() if any(x in b.getName() for x in ("Old", "MarkSweep")))

    before = full_collections()
    stage = corpus_pipeline._stage(lambda spark, docs, folder: docs)
    assert stage(spark, spark.range(3), "").count() == 3
    assert full_collections() > before


def test_other_operators_let_go_of_packing_encoders(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = WordEncoder.of_process(path)
    assert WordEncoder.of_process(path) is encoder and os.environ["TOKENIZERS_PARALLELISM"] == "false"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b c d e f", None]})
    (block,) = _blocks(iter([batch]), 5)
    assert block.n.tolist() == [2, 0]
    assert not vars(tokenizers).get("_sparkweave_encoders")


def test_trimming_lets_go_of_powers():
    textblocks.words_of(pa.array(["a b c"]), lower=True)
    assert textblocks._powers.cache_info().currsize
    textblocks.trim_memory()
    assert not textblocks._powers.cache_info().currsize
