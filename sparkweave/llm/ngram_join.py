"""N-gram Jaccard join by vertical partitioning.

Shingles get one global order, rarest first. Texts are read in blocks; a block sends each distinct shingle once, so a shingle that
a third of all rows share costs one entry for each block. Everything that leaves a block is in packed arrays.

1. frequencies: blocks send their distinct shingles to shards by range of the hash; a shard sums counts, numbers the shingles that
   two or more texts have, and answers each block.
2. segments: a block turns each text into its shared shingles in global order, as (frequency, shard, number), and
   keeps them only if a pair of the wanted similarity is possible at all: a text whose rare shingles alone fill
   the prefix has no partner.
3. classes: texts with equal shingle sets become one class, by a 128-bit digest and the number of shingles.
4. candidates: classes that share a shingle of their prefixes, against one hub for each shingle, the class whose
   shingles are most frequent. Then, for shingles whose classes still lie in several components, each class outside the largest
   component against the others, of sizes in reach and only if their parity sketches don't rule out the overlap. Pairs inside one component need no
   test, so groups of near copies cost linear work.
5. overlaps: the global order is cut into fragments; a candidate pair's partial overlaps are counted in each fragment
   separately and summed per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.columns import pick
from sparkweave.llm.components import components
from sparkweave.llm.storage import small_batches, text_size, written
from sparkweave.llm.textblocks import chunks, drop_encoders, mix, pack, pack_sorted, trim_memory, unpack, unpack_sorted, windows, words_of

#: Bytes of text in a block. Its hashes and text numbers take some ten times as much memory while they are sorted.
BLOCK_BYTES = 6 << 20

_ANSWER = "block long, shard int, payload binary"
_TEXTS = "doc_id long, n long, digest long, digest2 long, alone int, weight double, tokens array<bigint>, sketch array<bigint>"

#: A shared shingle in global order: 11 bits of frequency, 26 of shard, 26 of the number within the shard.
_SHARD_BITS, _RANK_BITS = 26, 26

#: Bytes of text for each shard, so that what one task sorts doesn't grow with the input.
SHARD_BYTES = 4 << 20

#: Bits of a text's parity sketch.
SKETCH_BITS = 256


def _frequency_code(frequency: np.ndarray) -> np.ndarray:
    """Frequencies up to 1024 as they are, greater ones by their logarithm, below 2048: the order only has to put rare shingles first."""
    beyond = 1024 + 64 * np.log2(np.maximum(frequency, 1024) / 1024)
    return np.minimum(np.where(frequency <= 1024, frequency, beyond), 2047).astype(np.int64)


class _Block:
    """Texts of one block: identifiers, shingle counts, digests, and all (shingle, text) occurrences of texts that differ, sorted by shingle."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], ids: list[pa.Array]):
        ids = pa.concat_arrays(ids)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        base, hashes, owners, counts, digests = 0, [], [], [], []
        for h, owner, n, digest in parts:
            hashes.append(h)
            owners.append((owner + base).astype(np.int32))
            counts.append(n)
            digests.append(digest)
            base += len(n)
        self.n, self.digest = np.concatenate(counts), np.concatenate(digests)
        # Equal sets within a block are one: the first text stands for all.
        _, first, which = np.unique(np.stack((self.digest[:, 0], self.digest[:, 1], self.n.astype(np.uint64)), 1), axis=0, return_index=True, return_inverse=True)
        self.leads = first[which.reshape(-1)] == np.arange(base)
        parts.clear()
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        del hashes, owners
        if not self.leads.all():
            keep = self.leads[owner]
            h, owner = h[keep], owner[keep]
        order = np.argsort(h, kind="stable")
        self.owner, h = owner[order], h[order]
        del owner, order
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(new)
        self.distinct = h[starts]
        self.times = np.diff(np.append(starts, len(h)))
        # The block's name comes from what it holds, so the two readings agree on it. Blocks that hold the same share a name.
        held = mix(self.ids.view(np.uint64) + self.known) ^ self.digest[:, 0] ^ mix(self.digest[:, 1] + self.n.astype(np.uint64))
        place = np.arange(base, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.name = int(np.sum(mix(held * place), keepdims=True).view(np.int64)[0])

    def shard_starts(self, shards: int) -> np.ndarray:
        """Positions in ``distinct`` at which each shard begins, and the end."""
        limits = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
        return np.concatenate(([0], np.searchsorted(self.distinct, limits), [len(self.distinct)]))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Block]:
    drop_encoders()
    parts, ids, size = [], [], 0
    for batch in batches:
        for part in chunks(batch):
            text = part.column("text")
            words = words_of(text, lower=True)
            hashes, owner = windows(words, width)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            keep = np.ones(len(hashes), bool)
            keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[keep], owner[keep]
            n = np.bincount(owner, minlength=part.num_rows)
            ends = np.concatenate(([0], np.cumsum(n)))
            digest = np.empty((part.num_rows, 2), np.uint64)
            for j, value in enumerate((mix(hashes), mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                digest[:, j] = sums[ends[1:]] - sums[ends[:-1]]
            parts.append((hashes, owner.astype(np.int32), n, digest))
            ids.append(part.column("doc_id").cast(pa.int64()))
            size += len(words.data)
            if size >= BLOCK_BYTES:
                yield _Block(parts, ids)
                parts, ids, size = [], [], 0
    if parts:
        yield _Block(parts, ids)


def _frequencies(rows: DataFrame, width: int, shards: int) -> DataFrame:
    """(block, shard, payload): for a block's distinct shingles of one shard, which are shared, their numbers and frequencies."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, width):
            starts = block.shard_starts(shards)
            shard, payload = [], []
            for s in range(shards):
                a, b = starts[s], starts[s + 1]
                if b > a:
                    several = np.flatnonzero(block.times[a:b] > 1)
                    shard.append(s)
                    payload.append(pack_sorted(block.distinct[a:b]) + pack(several) + pack(block.times[a:b][several]))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block.name] * len(shard), pa.int64()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary())})
            trim_memory()

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, times = [], []
        for x in table.column("payload"):
            data = x.as_py()
            h, at = unpack_sorted(data)
            several, at = unpack(data, at)
            more, _ = unpack(data, at)
            t = np.ones(len(h), np.int64)
            t[several.astype(np.int64)] = more
            hashes.append(h)
            times.append(t)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        sorted_ = every[order]
        new = np.ones(len(every), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        group = np.cumsum(new) - 1
        frequency = np.bincount(group, np.concatenate(times)[order]).astype(np.int64)
        number = np.cumsum(frequency > 1) - 1
        if len(number) and number[-1] >= 1 << _RANK_BITS:
            raise ValueError("a shard has too many shared shingles for its number; shards are to be sized by SHARD_BYTES")
        back = np.empty(len(every), np.int64)
        back[order] = group
        out, at = [], 0
        for h in hashes:
            g = back[at : at + len(h)]
            at += len(h)
            shared = frequency[g] > 1
            out.append(len(h).to_bytes(4, "little") + np.packbits(shared).tobytes() + pack_sorted(number[g[shared]].astype(np.uint64)) + pack(_frequency_code(frequency[g[shared]])))
        del hashes, times, every, order, sorted_, back, group
        trim_memory()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(out, pa.binary())})

    return rows.mapInArrow(send, _ANSWER).groupBy("shard").applyInArrow(answer, _ANSWER)


def _texts(rows: DataFrame, answers: DataFrame, width: int, numerator: int) -> DataFrame:
    """One row per text: digest, number of shingles that no other text has, mean frequency, and, if a partner is possible, shared shingles in global order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, width):
            fields = (block.n, block.digest[:, 0], block.digest[:, 1], block.leads, block.times, block.owner, block.known, block.ids.view(np.uint64))
            payload = b"".join(map(pack, fields))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block.name], pa.int64()), "shard": pa.array([-1], pa.int32()), "payload": pa.array([payload], pa.binary())})
            trim_memory()

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by_shard: dict[int, bytes] = {}
        alike = 0
        for shard, payload in zip(table.column("shard").to_pylist(), table.column("payload"), strict=True):
            alike += shard == -1
            by_shard.setdefault(shard, payload.as_py())
        data = by_shard.pop(-1, None)
        if data is None:
            raise RuntimeError("the two readings of the input differ; write it to a table first")
        at, fields = 0, []
        for _ in range(8):
            value, at = unpack(data, at)
            fields.append(value)
        digest, digest2, ids = fields[1].view(np.int64), fields[2].view(np.int64), fields[7].view(np.int64)
        n, leads, times, owner, known = (fields[i].astype(np.int64) for i in (0, 3, 4, 5, 6))
        flags, tokens = [], []
        for shard, raw in sorted(by_shard.items()):
            count = int.from_bytes(raw[:4], "little")
            stop = 4 + (count + 7) // 8
            flags.append(np.unpackbits(np.frombuffer(raw[4:stop], np.uint8), count=count).astype(bool))
            number, stop = unpack_sorted(raw, stop)
            frequency, _ = unpack(raw, stop)
            tokens.append((frequency << np.uint64(_SHARD_BITS + _RANK_BITS)) | np.uint64(shard << _RANK_BITS) | number)
        shared = np.concatenate(flags) if flags else np.zeros(0, bool)
        if len(shared) != len(times):
            raise RuntimeError("the two readings of the input differ; write it to a table first")
        token = np.zeros(len(shared), np.uint64)
        token[shared] = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        token = np.repeat(token, times)
        texts = len(n)
        common = np.bincount(owner[token > 0], minlength=texts)
        weight = np.bincount(owner, np.maximum(token >> np.uint64(_SHARD_BITS + _RANK_BITS), 1), texts) / np.maximum(n, 1)
        alone = n - common
        prefix = n - (numerator * n + 99) // 100 + 1
        possible = (n > 0) & (leads > 0) & (alone < prefix)
        keep = (token > 0) & possible[owner]
        token, owner = token[keep], owner[keep]
        order = np.lexsort((token, owner))
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=texts)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token[order].view(np.int64)), mask=pa.array(~possible))
        # Parities of the shared shingles by bucket; two texts' sketches differ in no more bits than their sets do in shingles.
        bucket, times_in = np.unique(owner * SKETCH_BITS + (mix(token) % np.uint64(SKETCH_BITS)).astype(np.int64), return_counts=True)
        bucket = bucket[times_in % 2 == 1]
        words = np.zeros(texts * SKETCH_BITS // 64, np.uint64)
        np.bitwise_or.at(words, bucket // 64, np.uint64(1) << (bucket % 64).astype(np.uint64))
        sketches = pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words.view(np.int64)), mask=pa.array(~possible))
        out = pa.table(
            {
                "doc_id": pa.array(ids, mask=known == 0),
                "n": n,
                "digest": digest,
                "digest2": digest2,
                "alone": pa.array(alone.astype(np.int32), mask=leads == 0),
                "weight": pa.array(weight, mask=leads == 0),
                "tokens": lists,
                "sketch": sketches,
            }
        )
        del bucket, words, token, owner, order, shared, times, tokens, flags, fields, data
        trim_memory()
        return pa.concat_tables([out] * alike)

    return answers.unionAll(rows.mapInArrow(send, _ANSWER)).groupBy("block").applyInArrow(finish, _TEXTS)


def _needed(a: Column, b: Column, numerator: int) -> Column:
    """The least overlap of sets of these sizes with 100 * overlap >= numerator * union."""
    return F.ceil(numerator * (a + b) / F.lit(100.0 + numerator) - 1e-9)


def _reachable(left: str, right: str, numerator: int) -> Column:
    """Whether a shared shingle at these positions, if it is the first, leaves room for the overlap that is needed."""
    rest = F.least(F.col(f"{left}.n") - F.col(f"{left}.at"), F.col(f"{right}.n") - F.col(f"{right}.at"))
    return rest >= _needed(F.col(f"{left}.n"), F.col(f"{right}.n"), numerator)


def _apart(left: str, right: str, numerator: int) -> Column:
    """Whether shingles that no other text has and the bits in which two sketches differ already are more than two similar sets differ by."""
    bits = F.aggregate(F.zip_with(f"{left}.sketch", f"{right}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    both = F.col(f"{left}.n") + F.col(f"{right}.n")
    return bits + F.col(f"{left}.alone") + F.col(f"{right}.alone") > both - 2 * _needed(F.col(f"{left}.n"), F.col(f"{right}.n"), numerator)


def _band(n: str, numerator: int) -> Column:
    """Sizes of similar sets lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n)) / math.log(100 / numerator) + 1e-9).cast("int")


def _verified(pairs: DataFrame, classes: DataFrame, cuts: list[int], numerator: int) -> DataFrame:
    """The pairs (a, b) that are similar: partial overlaps by fragment of the global order, summed per pair."""
    limits = F.array(*[F.lit(x) for x in cuts])
    segment = F.filter("tokens", lambda t: (t >= F.element_at(limits, F.col("fragment"))) & (t < F.element_at(limits, F.col("fragment") + 1)))
    members = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    classes = classes.join(members, "class", "left_semi")
    pieces = classes.select("class", "n", "tokens", F.explode(F.sequence(F.lit(1), F.lit(len(cuts) - 1))).alias("fragment"))
    pieces = pieces.select("class", "n", "fragment", segment.alias("segment"))
    spread = pairs.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(len(cuts) - 1))).alias("fragment"))
    left = pieces.select(F.col("class").alias("a"), "fragment", F.col("n").alias("na"), F.col("segment").alias("sa"))
    right = pieces.select(F.col("class").alias("b"), "fragment", F.col("n").alias("nb"), F.col("segment").alias("sb"))
    # A pair comes once for each fragment, which Spark's estimates don't know, so these joins must not broadcast.
    partial = spread.join(left.hint("merge"), ["a", "fragment"]).join(right.hint("merge"), ["b", "fragment"])
    overlaps = partial.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("sa", "sb"))).alias("overlap"))
    return overlaps.where(100 * F.col("overlap") >= numerator * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, numerator: int = 75, shards: int | None = None, fragments: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id (the smallest doc_id reachable by links) and class_id (of equal sets).

    Two texts link when their sets of ``width``-word shingles have 100 * intersection >= numerator * union; the module says how. Shingles are
    64-bit hashes of lower-cased (A-Z) words. The input must give the same rows in the same order when read again, as Parquet files do.

    Defined cases: a text with fewer words has its whole sequence as its one shingle; a null or empty text, or one without words, has none,
    and links with nothing. A null doc_id takes part in links and gets its group's smallest doc_id. Rows that repeat a doc_id are
    one identifier, whatever their texts. Whole texts are read, however long. An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text")
    if not shards:
        shards = min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_size(rows) // SHARD_BYTES)), (1 << _SHARD_BITS) - 1)
    texts = written(_texts(rows, _frequencies(rows, width, shards), width, numerator), "shingle-texts")
    same = ["n", "digest", "digest2"]
    # A class with a single text that has no possible partner needs nothing further.
    classes = texts.where("n > 0").groupBy(*same).agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("alone", True).alias("alone"), F.first("weight", True).alias("weight"), F.first("tokens", True).alias("tokens"), F.first("sketch", True).alias("sketch")
    )
    classes = classes.withColumn("class", F.xxhash64(*same)).where("copies > 1 OR tokens IS NOT NULL")
    classes = written(classes, "shingle-classes")
    able = classes.where("tokens IS NOT NULL")

    prefix = F.col("n") - F.ceil(numerator * F.col("n") / F.lit(100.0) - 1e-9) + 1 - F.col("alone")
    entries = able.select("class", "n", "weight", "alone", F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("i", "token"))
    entries = entries.select("token", "class", "n", "weight", (F.col("alone") + F.col("i")).alias("at"))
    hubs = entries.groupBy("token").agg(F.max(F.struct("weight", "class", "n", "at")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("token", "hub.*").alias("h")
    first = entries.alias("m").join(hubs, "token").where((F.col("m.class") != F.col("h.class")) & _reachable("m", "h", numerator))

    def pair(left: str, right: str) -> list[Column]:
        return [F.least(f"{left}.class", f"{right}.class").alias("a"), F.greatest(f"{left}.class", f"{right}.class").alias("b")]

    tested = written(first.select(*pair("m", "h")).distinct(), "shingle-pairs")
    sample = able.select(F.explode("tokens").alias("token")).agg(F.percentile_approx("token", [i / fragments for i in range(1, fragments)], F.lit(1000)).alias("cuts")).first()
    cuts = [0, *sorted(set((sample and sample["cuts"]) or [])), (1 << 63) - 1]
    cuts = sorted(set(cuts))
    links = written(_verified(tested, able, cuts, numerator), "shingle-links")

    # Shingles whose classes still lie in several components: those outside the component with most classes, against all others.
    labels = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labels = written(labels, "shingle-labels")
    marked = entries.join(labels, entries["class"] == labels["node"], "left").select("token", "class", "n", "at", F.coalesce("label", "class").alias("label"))
    marked = written(marked, "shingle-entries")
    per_label = marked.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members"))
    split = per_label.groupBy("token").agg(F.max(F.struct("members", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("main"))
    sketches = able.select("class", "alone", "sketch")
    active = marked.join(split, "token").withColumn("band", _band("n", numerator)).join(sketches, "class")
    minor = active.where("label != main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("m")
    other = active.alias("o")
    # Two classes outside the largest component meet twice; the smaller number goes first.
    once = (F.col("o.label") == F.col("o.main")) | (F.col("m.class") < F.col("o.class"))
    same_key = (F.col("m.token") == F.col("o.token")) & (F.col("m.band") == F.col("o.band"))
    second = minor.join(other, same_key & (F.col("m.label") != F.col("o.label")) & once & _reachable("m", "o", numerator) & ~_apart("m", "o", numerator))
    fresh = second.select(*pair("m", "o")).distinct().join(tested, ["a", "b"], "left_anti")
    fresh = written(fresh, "shingle-pairs")
    links = links.unionByName(written(_verified(fresh, able, cuts, numerator), "shingle-links"))

    ids = classes.select("class", "class_id")
    named = links.join(ids.select(F.col("class").alias("a"), F.col("class_id").alias("src")), "a").join(ids.select(F.col("class").alias("b"), F.col("class_id").alias("dst")), "b")
    # Rows that repeat a doc_id are one identifier: it links the classes that they are in.
    twice = texts.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = texts.join(twice, "doc_id", "left_semi").join(classes.select(*same, "class_id"), same).select(F.col("doc_id").alias("src"), F.col("class_id").alias("dst"))
    found = written(components(named.select("src", "dst").unionAll(repeated)), "shingle-components")
    by_class = classes.select(*same, "class_id", "copies")
    wide = texts.select("doc_id", *same).join(by_class, same, "left").withColumn("node", F.coalesce("class_id", "doc_id"))
    return wide.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"), F.col("node").alias("class_id"))
