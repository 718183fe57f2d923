import hashlib
import random
import re
from collections import Counter, defaultdict

from sparkweave.llm.components import components
from sparkweave.llm.exact_dedup import exact_dedup
from sparkweave.llm.ngram_join import ngram_jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute_components(rows):
    """Smallest doc_id reachable, by all pairs; rows of one doc_id are one node, rows without one link others."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(a & b)
            if same_id or (a and b and 100 * both >= 75 * (len(a) + len(b) - both)):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows))


def test_components_match_brute_force(docs, fixture_docs):
    found = ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(fixture_docs)


def test_components_do_not_depend_on_shards_or_fragments(docs, fixture_docs):
    found = ngram_jaccard_join(docs, shards=1, fragments=3).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(fixture_docs)


def test_join_of_empty_table(empty):
    assert ngram_jaccard_join(empty).count() == 0


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 99), (99, 100), (7, 7), (None, 3), (200, 300), (300, 250)]
    found = dict(components(spark.createDataFrame(links, "src long, dst long")).collect())
    assert found == {**dict.fromkeys(range(31), 0), 99: 99, 100: 99, 200: 200, 250: 200, 300: 200}


def test_exact_dedup_matches_brute_force(docs, fixture_docs):
    for keep, best in (("max", max), ("min", min)):
        groups = defaultdict(list)
        for i, text, *_ in fixture_docs:
            groups[(text or "").translate(LOWER)].append(i)
        found = exact_dedup(docs, keep=keep, fan_in=2, runs=5).collect()
        assert len(found) == len(fixture_docs)
        want = Counter()
        for text, ids in groups.items():
            winner = best((i for i in ids if i is not None), default=None)
            for i in ids:
                want[i, winner, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
        assert Counter(r.text_sha256 for r in found if r.kept) == Counter(dict.fromkeys({r.text_sha256 for r in found}, 1))
        assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_of_empty_table(empty):
    assert exact_dedup(empty).count() == 0


def test_texts_made_of_the_same_passages(spark, tmp_path):
    """Texts that are chosen from few passages share shingles with many others that they aren't similar to."""
    rng = random.Random(3)
    passages = [" ".join(f"p{p}w{i}" for i in range(30)) for p in range(9)]
    rows = []
    for i in range(150):
        chosen = sorted(rng.sample(range(9), rng.choice([2, 3, 4, 5])))
        rows.append((i, " ".join(passages[p] for p in chosen) + (f" own{i % 40}" if i % 3 else "")))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    found = ngram_jaccard_join(spark.read.parquet(path)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(rows)


def test_one_shingle_in_many_dissimilar_texts_makes_no_pairs(spark, tmp_path, monkeypatch):
    from sparkweave.llm import ngram_join

    counted = []
    plain = ngram_join.written

    def counting(df, name):
        out = plain(df, name)
        if name == "shingle-pairs":
            counted.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counting)
    rng = random.Random(4)
    rows = [(i, "all rights are reserved here " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30)))) for i in range(10_000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    found = ngram_jaccard_join(spark.read.parquet(path))
    assert found.where("doc_id != component_id").count() == 0
    assert sum(counted) <= len(rows)


def test_sketches_never_rule_out_similar_sets():
    import numpy as np

    from sparkweave.llm import ngram_join

    codes = ngram_join._frequency_code(np.arange(1, 10**6, 37))
    assert (np.diff(codes) >= 0).all() and codes.max() < 2048


def test_blocks_and_chunks_of_any_size_give_the_same(docs, fixture_docs, monkeypatch):
    """Texts above a chunk's bytes, and many blocks, change nothing."""
    from sparkweave.llm import ngram_join, textblocks

    long = [(9000, " ".join(f"x{i}" for i in range(250_000))), (9001, " ".join(f"x{i}" for i in range(250_001))), (9002, "word " * 400_000)]
    spark = docs.sparkSession
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(long, "doc_id long, text string"))
    found = ngram_jaccard_join(more).select("doc_id", "component_id").where("doc_id >= 9000").collect()
    assert Counter(map(tuple, found)) == Counter({(9000, 9000): 1, (9001, 9000): 1, (9002, 9002): 1})
    assert textblocks.CHUNK_BYTES < len(long[0][1]) and ngram_join.BLOCK_BYTES > 0
    exact = {r.doc_id: r for r in exact_dedup(more).where("doc_id >= 9000").collect()}
    assert [exact[i].text_sha256 for i, _ in long] == [hashlib.sha256(t.encode()).hexdigest() for _, t in long]
