"""Scoring texts with a Katz backoff model that is trained on the corpus itself.

Texts are read in blocks. A block sends each distinct n-gram once, with its count, to a shard by range of the n-gram's hash; the shard sums the
counts and answers each block in the order in which it asked. So counts cover all texts, a frequent word costs one
entry for each block, and nothing that grows with the corpus reaches the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import new_path, small_batches, text_size, tidy_shuffles, written
from sparkweave.llm.textblocks import chunks, mix, pack, pack_sorted, trim_memory, unpack, unpack_sorted, words_of

#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20

#: Bytes of text for each shard of an order.
SHARD_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_START, _END = np.uint64(0x51A27), np.uint64(0xE4D)
_ANSWER = "block long, shard int, payload binary, stats array<bigint>"
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, known_score double, orders array<int>, contexts array<bigint>, times array<int>, masses array<double>, lowers array<double>"


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


class _Grams:
    """All n-grams of a block's tokens. Order k's hash at a token is that of the token and the k - 1 before it; a text begins with _START."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, order: int):
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(tokens)) - self.first[:-1][self.text]
        self.begins = place == 0
        self.hashes, self.histories = [tokens], [np.zeros(0, np.uint64)]
        rolled = tokens
        for k in range(2, order + 1):
            before = np.full(len(tokens), _START, np.uint64)
            before[k - 1 :] = np.where(place[k - 1 :] >= k - 1, tokens[: len(tokens) - k + 1], _START)
            rolled = rolled * _BASE + mix(before + np.uint64(k))
            history = np.empty(len(tokens), np.uint64)
            history[1:] = self.hashes[-1][:-1]
            history[self.begins] = mix(np.array([_START + np.uint64(k)], np.uint64))[0]
            self.histories.append(history)
            self.hashes.append(mix(rolled))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(name, tokens, lengths, trains, ids) of each block. The name comes from what the block holds; blocks that hold the same share it."""
    tokens, lengths, trains, ids, size = [], [], [], [], 0

    def block() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        t, n, learn, id_ = np.concatenate(tokens), np.concatenate(lengths), np.concatenate(trains), pa.concat_arrays(ids)
        key = id_.fill_null(0).to_numpy().view(np.uint64) * np.uint64(4) + id_.is_valid().to_numpy(zero_copy_only=False) * np.uint64(2) + learn
        held = np.concatenate((mix(t), mix(key + _BASE), mix(n.astype(np.uint64))))
        place = np.arange(len(held), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return int(np.sum(mix(held * place), keepdims=True).view(np.int64)[0]), t, n, learn, id_

    for batch in batches:
        for part in chunks(batch):
            words = words_of(part.column("text"), lower=True)
            stop = words.first[1:] + np.arange(part.num_rows)
            out = np.empty(len(words.hashes) + part.num_rows, np.uint64)
            out[stop] = _END
            out[np.arange(len(words.hashes)) + words.text] = words.hashes
            tokens.append(out)
            lengths.append(words.counts + 1)
            trains.append(part.column("trains").to_numpy(zero_copy_only=False).astype(bool))
            ids.append(part.column("doc_id").cast(pa.int64()))
            size += len(words.data)
            if size >= BLOCK_BYTES:
                yield block()
                tokens, lengths, trains, ids, size = [], [], [], [], 0
    if tokens:
        yield block()


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, and the exceptions."""
    large = np.flatnonzero(counts >= 255)
    return pack(np.minimum(counts, 255)) + pack(large) + pack(counts[large])


def _unpack_counts(data: bytes, at: int) -> tuple[np.ndarray, int]:
    counts, at = unpack(data, at)
    large, at = unpack(data, at)
    values, at = unpack(data, at)
    counts = counts.astype(np.int64)
    counts[large.astype(np.int64)] = values
    return counts, at


def _counts(rows: DataFrame, order: int, shards: int, thin: int) -> DataFrame:
    """(block, shard, payload): counts over all training texts of the n-grams that a block asked for, which of them the block stands for, and which of them any text
    outside the training has; and rows without a block, with (order, tokens, distinct n-grams, distinct n-grams seen 1 .. ``thin`` + 1 times)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
        for name, tokens, lengths, trains, _ in _blocks(batches):
            grams = _Grams(tokens, lengths, order)
            learn = trains[grams.text]
            shard, payload = [], []
            for k in range(order):
                distinct, which = np.unique(grams.hashes[k], return_inverse=True)
                counts = np.bincount(which, learn, len(distinct)).astype(np.int64)
                outside = np.bincount(which, ~learn, len(distinct)) > 0
                cuts = np.concatenate(([0], np.searchsorted(distinct, limits), [len(distinct)]))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    shard.append(k * shards + s)
                    own = slice(cuts[s], cuts[s + 1])
                    payload.append(pack_sorted(distinct[own]) + _pack_counts(counts[own]) + np.packbits(outside[own]).tobytes())
            count = len(shard)
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([name] * count, pa.int64()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary()), "stats": pa.nulls(count, pa.list_(pa.int64()))}
            )
            del grams, payload
            trim_memory()

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        times: dict[int, int] = {}
        asked: dict[int, bytes] = {}
        for name, payload in zip(table.column("block").to_pylist(), table.column("payload"), strict=True):
            times[name] = times.get(name, 0) + 1
            asked[name] = payload.as_py()
        names = sorted(asked)
        hashes, counts, outside = [], [], []
        for name in names:
            h, at = unpack_sorted(asked[name])
            c, at = _unpack_counts(asked[name], at)
            hashes.append(h)
            counts.append(c * times[name])
            outside.append(np.unpackbits(np.frombuffer(asked[name], np.uint8, offset=at), count=len(h)))
        every = np.concatenate(hashes)
        _, first, group = np.unique(every, return_index=True, return_inverse=True)
        total = np.bincount(group, np.concatenate(counts)).astype(np.int64)
        wanted = np.bincount(group, np.concatenate(outside)) > 0
        owned = np.zeros(len(every), bool)
        owned[first] = True
        out, at = [], 0
        for h in hashes:
            own = slice(at, at + len(h))
            at += len(h)
            out.append(np.packbits(owned[own]).tobytes() + np.packbits(wanted[group[own]]).tobytes() + _pack_counts(total[group[own]]))
        seen = total[total > 0]
        stats = [key[0].as_py() // shards + 1, int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, thin + 2), minlength=thin + 3)[1 : thin + 2].tolist()]
        shard = pa.array([key[0].as_py()] * (len(names) + 1), pa.int32())
        lists = pa.array([None] * len(names) + [stats], pa.list_(pa.int64()))
        del hashes, counts, outside, every, first, group, owned, wanted, asked
        trim_memory()
        return pa.table({"block": pa.array([*names, None], pa.int64()), "shard": shard, "payload": pa.array([*out, None], pa.binary()), "stats": lists})

    return rows.mapInArrow(send, _ANSWER).groupBy("shard").applyInArrow(answer, _ANSWER)


def discounts(seen: list[int], thin: int) -> np.ndarray:
    """Katz's factors d[r] for counts r up to ``thin``, by Good-Turing; d[thin + 1] is that of any larger count, which is left whole.

    seen[r - 1]: distinct n-grams with count r, for r up to thin + 1. Where counts of counts are too few or too uneven for a factor between 0.05 and 0.95, the nearer bound
    holds.
    """
    n = np.array([0, *seen], float)
    d = np.ones(thin + 2)
    cut = (thin + 1) * n[thin + 1] / n[1] if n[1] else 0.0
    for r in range(1, thin + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.5
        factor = (turing - cut) / (1 - cut) if abs(1 - cut) > 1e-9 else turing
        d[r] = min(max(factor, 0.05), 0.95)
    return d


def katz_scores(docs: DataFrame, trains: Column, order: int = 3, added: float = 0.1, thin: int = 5, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, in log10.

    Method. N-grams up to ``order`` are counted over the rows for which ``trains`` holds. A token's probability after its history is
    d * c(history, token) / c(history), with Katz's Good-Turing factor d for counts up to ``thin`` and none above, if the n-gram has been seen; else alpha(history)
    times the probability after the history without its first word, and so on down to single tokens, where it is (c + added) /
    (N + added * (V + 1)), the last share being that of all unknown words. As counts above ``thin`` stay whole, a history seen more often than that might be left without
    mass for tokens that are new after it; so its c(history) is taken to be one more. alpha(history) is exactly what the seen tokens leave, divided by what the shorter history
    gives to tokens not seen after this one, so each history's probabilities add up to 1. The sums over a history's distinct tokens come
    from the blocks: each n-gram is counted by the one block that a shard names. Only texts outside the training can back off, so sums go on only for histories that
    such a text has. Alphas lie in a table partitioned by order, and join the texts that back off, once for each text and history.

    Tokens are lower-cased (A-Z) words and one end for each text, as 64-bit hashes. The input must give the same rows in the same order when
    read again, as Parquet files do. Defined cases: a null or empty text is its end alone; ``trains`` null counts as false; a null doc_id and
    repeated rows are scored, and learned from, as rows of their own. With no training text every score is that of unknown words. Whole texts are read, however long.
    An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs.withColumn("trains", F.coalesce(trains, F.lit(False))), "doc_id", "text", "trains")
    shards = shards or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_size(rows) // SHARD_BYTES))
    answers = written(_counts(rows, order, shards, thin), "gram-counts")
    by_order = answers.where("block IS NULL").select(F.col("stats")[0].alias("order"), *[F.col("stats")[i + 1].alias(f"s{i}") for i in range(thin + 3)])
    stats = {r["order"]: [int(r[f"s{i}"]) for i in range(thin + 3)] for r in by_order.groupBy("order").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(thin + 3)]).collect()}
    total, kinds = stats.get(1, [0, 0])[:2]
    taken = {k: discounts(v[2:], thin) for k, v in stats.items()}
    texts_learned = rows.where("trains").count()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, tokens, lengths, learn, ids in _blocks(batches):
            distinct, which, count = np.unique(tokens, return_inverse=True, return_counts=True)
            by_count = np.argsort(-count, kind="stable")  # small numbers for frequent words
            number = np.empty(len(by_count), np.int64)
            number[by_count] = np.arange(len(by_count))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            id_ = ids.fill_null(0).to_numpy().view(np.uint64)
            payload = pack_sorted(distinct) + b"".join(map(pack, (number, number[which], lengths, learn, known, id_)))
            yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "shard": pa.array([-1], pa.int32()), "payload": pa.array([payload], pa.binary()), "stats": pa.nulls(1, pa.list_(pa.int64()))})
            trim_memory()

    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by_shard: dict[int, bytes] = {}
        alike = 0
        for shard, payload in zip(table.column("shard").to_pylist(), table.column("payload"), strict=True):
            alike += shard == -1
            by_shard.setdefault(shard, payload.as_py())
        data = by_shard.pop(-1, None)
        if data is None or not by_shard:
            raise RuntimeError("the two readings of the input differ; write it to a table first")
        distinct, at = unpack_sorted(data)
        fields = []
        for _ in range(6):
            value, at = unpack(data, at)
            fields.append(value)
        number, stream, lengths, learn, known = (f.astype(np.int64) for f in fields[:5])
        ids = fields[5].view(np.int64)
        word = np.empty(len(number), np.uint64)
        word[number] = distinct
        texts = len(lengths)
        grams = _Grams(word[stream], lengths, order)
        del stream, word, distinct, number

        probability = np.zeros(0)
        below, below_wanted = np.zeros(0, np.int64), np.zeros(0, bool)
        known_score = np.zeros(len(grams.text))
        open_ = np.ones(len(grams.text), bool)
        levels, parts = [], []
        for k in range(1, order + 1):
            unique, first, which = np.unique(grams.hashes[k - 1], return_index=True, return_inverse=True)
            owned, wanted, counts = np.zeros(len(unique), bool), np.zeros(len(unique), bool), np.zeros(len(unique), np.int64)
            done = 0
            limits = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
            cuts = np.concatenate(([0], np.searchsorted(unique, limits), [len(unique)]))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                raw = by_shard[(k - 1) * shards + s]
                size = int(cuts[s + 1] - cuts[s])
                flags = (size + 7) // 8
                owned[done : done + size] = np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=size)
                wanted[done : done + size] = np.unpackbits(np.frombuffer(raw, np.uint8, flags, flags), count=size)
                counts[done : done + size], _ = _unpack_counts(raw, 2 * flags)
                done += size
            c = counts[which]
            if k == 1:
                probability = (c + added) / (total + added * (kinds + 1)) if total or added else np.zeros(len(c))
                base, n_known = np.log10(probability), c > 0
                levels.append((probability, None, None))
            else:
                history = np.empty(len(c), np.int64)
                history[1:] = below[:-1]
                history[grams.begins] = texts_learned
                d = taken.get(k, np.ones(thin + 2))
                left = c * d[np.minimum(c, thin + 1)]
                own = np.divide(left, history + (history > thin), out=np.zeros(len(c)), where=(c > 0) & (history > 0))
                asked_for = np.ones(len(c), bool)
                asked_for[1:] = below_wanted[:-1]
                asked_for[grams.begins] = True
                at = first[owned & (counts > 0)]
                at = at[asked_for[at]]
                context, index = np.unique(grams.histories[k - 1][at], return_inverse=True)
                parts.append((k, context, np.bincount(index, own[at], len(context)), np.bincount(index, probability[at], len(context))))
                levels.append((own, c > 0, history > 0))
                probability = own
            below, below_wanted = c, wanted[which]
        text = grams.text
        orders, contexts, owners = [], [], []
        for k in range(order, 1, -1):
            own, seen, has = levels[k - 1]
            now = open_ & seen
            known_score[now] = np.log10(own[now])
            open_ &= ~seen
            back = open_ & has
            orders.append(np.full(int(back.sum()), k))
            contexts.append(grams.histories[k - 1][back])
            owners.append(text[back])
        known_score[open_] = base[open_]
        sums = lambda x: np.bincount(text, x, texts)
        owner, context, k = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (owners, contexts, orders))
        sort = np.lexsort((context, k, owner))
        owner, context, k = owner[sort].astype(np.int64), context[sort].astype(np.uint64), k[sort]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (context[1:] != context[:-1]) | (k[1:] != k[:-1])
        starts = np.flatnonzero(new)
        each = np.diff(np.append(starts, len(owner)))
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[starts], minlength=texts)))).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
        no_lists = pa.nulls(texts, pa.list_(pa.float64()))
        docs_out = pa.table(
            {
                "row": pa.nulls(texts, pa.int64()),
                "doc_id": pa.array(ids, mask=known == 0),
                "held_out": learn == 0,
                "n_tokens": lengths,
                "n_known": sums(n_known).astype(np.int64),
                "base_score": sums(base),
                "known_score": sums(known_score),
                "orders": lists(k[starts].astype(np.int32), pa.int32()),
                "contexts": lists(context[starts].view(np.int64), pa.int64()),
                "times": lists(each.astype(np.int32), pa.int32()),
                "masses": no_lists,
                "lowers": no_lists,
            }
        )
        # A block's sums over contexts travel as a few rows of lists.
        packs = []
        for k, context, mass, lower in parts:
            for i in range(0, len(context), 4096):
                packs.append((k, context[i : i + 4096].view(np.int64), mass[i : i + 4096], lower[i : i + 4096]))
        n = len(packs)
        sums_out = pa.table({f.name: pa.nulls(n, f.type) for f in docs_out.schema})
        for name, values, kind in (
            ("orders", [[p[0]] for p in packs], pa.int32()),
            ("contexts", [p[1] for p in packs], pa.int64()),
            ("masses", [p[2] for p in packs], pa.float64()),
            ("lowers", [p[3] for p in packs], pa.float64()),
        ):
            at = sums_out.schema.get_field_index(name)
            sums_out = sums_out.set_column(at, docs_out.schema.field(name), pa.array(values, pa.list_(kind)))
        del grams, levels, parts, probability, below, known_score, open_, text, orders, contexts, owners, packs
        trim_memory()
        return pa.concat_tables([docs_out] * alike + [sums_out])

    asked = answers.where("block IS NOT NULL").unionAll(rows.mapInArrow(send, _ANSWER))
    scored = written(asked.groupBy("block").applyInArrow(score, _SCORED), "gram-scores")
    texts = scored.where("n_tokens IS NOT NULL").withColumn("row", F.monotonically_increasing_id())

    zipped = scored.where("n_tokens IS NULL").select(F.col("orders")[0].alias("order"), F.explode(F.arrays_zip("contexts", "masses", "lowers")).alias("z"))
    alpha = zipped.groupBy("order", F.col("z.contexts").alias("context")).agg(((1 - F.sum("z.masses")) / (1 - F.sum("z.lowers"))).alias("alpha"))
    path = new_path(spark, "katz-alpha")
    with tidy_shuffles(spark):
        alpha.write.partitionBy("order").parquet(path)
    alpha = spark.read.schema("context long, alpha double, order int").parquet(path)
    backed = texts.where(F.size("orders") > 0).select("row", F.explode(F.arrays_zip("orders", "contexts", "times")).alias("z")).select("row", F.col("z.orders").alias("order"), F.col("z.contexts").alias("context"), F.col("z.times").alias("times"))
    extra = backed.join(alpha, ["order", "context"]).groupBy("row").agg(F.sum(F.log10("alpha") * F.col("times")).alias("extra"))
    return texts.join(extra, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("known_score") + F.coalesce("extra", F.lit(0.0))).alias("score"),
    )
