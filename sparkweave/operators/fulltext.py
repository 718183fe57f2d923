"""Full-text search: postings, BM25, and the queries over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.predicates import glob_to_regex

# English stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)

#: Ideographs, kana and hangul are tokens of one character each.
_SINGLE = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"
TOKEN = r"[\p{L}\p{N}_]+"

ANALYZERS = ("standard", "whitespace", "words")

K1, B = 1.2, 0.75
LONGEST_BYTES = 256


def tokens(text: Column, analyzer: str = "standard") -> Column:
    """Lower-cased runs of letters, digits and underscores, or of anything but white space, without stop words and over-long ones."""
    low = F.lower(text)
    if analyzer == "whitespace":
        words = F.regexp_extract_all(low, F.lit(r"(?U)\S+"), F.lit(0))
    elif analyzer == "words":  # ideographs stay together, for texts that functions.segment has put spaces into
        words = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    elif analyzer == "standard":
        spaced = F.when(F.rlike(low, F.lit(_SINGLE)), F.regexp_replace(low, f"({_SINGLE})", " $1 ")).otherwise(low)
        words = F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(0))
    else:
        raise ValueError(f"analyzer must be one of {ANALYZERS}")
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.octet_length(w) <= LONGEST_BYTES))


#: Most terms or documents that a query hands to the scan as literals.
MOST_LITERALS = 1000

#: Tokens that are sorted together into a run of postings, and more by at most one batch of Spark's.
RUN_TOKENS = 1 << 21


def _run(batches: Sequence[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (term, doc_id, tf, positions, dl) of documents (doc_id, dl, tokens), by term and then as the documents come; before them a row without a term for each document."""
    keys, dl, lists = (pa.chunked_array([b.column(name) for b in batches]).combine_chunks() for name in ("doc_id", "dl", "tokens"))
    names = ["term", "doc_id", "tf", "positions", "dl"]
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    no_places = pa.ListArray.from_arrays(pa.array(np.zeros(len(keys) + 1, np.int32)), pa.array([], pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), coded.type.value_type), keys, pa.array(np.zeros(len(keys), np.int64)), no_places, dl], names=names)
    if not len(coded):
        return
    # Terms are numbered in their order, so sorting goes by numbers; it is stable, so a term's documents and a document's positions stay in order.
    by_name = pc.sort_indices(coded.dictionary)
    number = np.empty(len(by_name), np.int32)
    number[by_name.to_numpy()] = np.arange(len(by_name), dtype=np.int32)
    terms, term = coded.dictionary.take(by_name), number[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    position = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.argsort(term, kind="stable")
    term, doc, position = term[order], doc[order], position[order]
    starts = np.concatenate(([0], np.flatnonzero((term[1:] != term[:-1]) | (doc[1:] != doc[:-1])) + 1, [len(term)]))
    for i in range(0, len(starts) - 1, 1 << 16):
        edges = starts[i : i + (1 << 16) + 1]
        of = pa.array(doc[edges[:-1]])
        places = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(position[edges[0] : edges[-1]]))
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[edges[:-1]])), keys.take(of), pa.array(np.diff(edges)), places, dl.take(of)], names=names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of about RUN_TOKENS, each let go of before the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b.column("tokens").flatten()) for b in held) >= RUN_TOKENS:
            yield from _run(held)
            held = []
    if held:
        yield from _run(held)


@dataclass(frozen=True)
class TextIndex:
    """``postings``: term, doc_id, tf, positions, dl (the document's length); ``lengths``: doc_id, dl; ``terms_of``: term, df; ``totals``: one row with n_docs and avgdl.

    All are tables that a caller may write. A search then reads the postings and frequencies of its terms and one row of totals, and nothing that grows with the documents.
    """

    postings: DataFrame
    lengths: DataFrame
    fields: DataFrame
    terms_of: DataFrame
    totals: DataFrame
    source: Sequence[str] = ("text",)
    key: str = "doc_id"
    analyze: Callable[[Column], Column] = tokens
    #: doc_id, dl, tokens of the texts that an index was built from, for writing it; None where it was made from other indexes.
    split: DataFrame | None = None

    @staticmethod
    def _of(postings: DataFrame, lengths: DataFrame, fields: DataFrame, source: Sequence[str], key: str, analyze: Callable[[Column], Column]) -> TextIndex:
        terms_of = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return TextIndex(postings, lengths, fields, terms_of, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")), tuple(source), key, analyze)

    @staticmethod
    def build(docs: DataFrame, fields: Sequence[str] = ("text",), key: str = "doc_id", analyze: Callable[[Column], Column] = tokens) -> TextIndex:
        """Indexes the fields, joined by spaces in the order of their names. Of rows with the same key the index expects one. ``analyze`` gives the tokens of a text; queries
        of the index go through it too."""
        text = F.concat_ws(" ", *[F.col(f) for f in sorted(fields)])
        split = docs.select(F.col(key).alias("doc_id"), analyze(text).alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), "tokens")
        lengths = split.select("doc_id", "dl")
        each = split.select("doc_id", "dl", F.posexplode("tokens").alias("position", "term"))
        postings = each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))
        return replace(TextIndex._of(postings, lengths, docs.withColumnRenamed(key, "doc_id"), fields, key, analyze), split=split)

    def statistics(self) -> DataFrame:
        """One row: the number of documents and their mean length."""
        return self.totals

    def written(self, folder: str) -> TextIndex:
        """The index as tables below a folder, for many searches. Each task writes the postings of its documents in runs sorted by term, so that nothing is shuffled but counts by
        term, a search reads the pages of its terms in each run, and a frequent term is spread over all files. A document's tokens must be in one row."""
        spark = self.postings.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        read = spark.read.parquet
        if self.split is None:
            self.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
            self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
            postings = read(f"{folder}/postings")
        else:
            key = T.StructField("doc_id", self.split.schema["doc_id"].dataType)
            kinds = T.StructType([T.StructField("term", T.StringType()), key, T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("dl", T.IntegerType())])
            self.split.mapInArrow(_runs, kinds).write.mode("overwrite").parquet(f"{folder}/postings")
            # A row without a term stands for each document, so the texts are gone through once.
            whole = read(f"{folder}/postings")
            whole.where("term IS NULL").select("doc_id", "dl").write.mode("overwrite").parquet(f"{folder}/lengths")
            postings = whole.where("term IS NOT NULL")
        whole = TextIndex._of(postings, read(f"{folder}/lengths"), self.fields, self.source, self.key, self.analyze)
        whole.terms_of.repartitionByRange(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        whole.totals.write.mode("overwrite").parquet(f"{folder}/totals")
        return replace(whole, terms_of=read(f"{folder}/terms"), totals=read(f"{folder}/totals"))

    def without(self, keys: DataFrame) -> TextIndex:
        """The index without documents (doc_id); the postings of the others are taken over, their texts are not read again."""
        gone = keys.select("doc_id").distinct()
        keep = lambda df: df.join(gone, "doc_id", "left_anti")
        return TextIndex._of(keep(self.postings), keep(self.lengths), keep(self.fields), self.source, self.key, self.analyze)

    def with_documents(self, docs: DataFrame) -> TextIndex:
        """The index with documents added, or put in the place of those with their keys; only their texts are read."""
        new = TextIndex.build(docs, self.source, self.key, self.analyze)
        rest = self.without(new.lengths)
        names = [c for c in rest.fields.columns if c in new.fields.columns]
        return TextIndex._of(
            rest.postings.unionByName(new.postings), rest.lengths.unionByName(new.lengths), rest.fields.select(*names).unionByName(new.fields.select(*names)), self.source, self.key, self.analyze
        )

    def _hits(self, times: Mapping[str, int]) -> DataFrame:
        """Postings of the terms of a query, with the number of times each counts. The terms are literals, so the filter goes before the grouping of postings."""
        terms = sorted(times)
        if not terms:
            return self.postings.where(F.lit(False)).withColumns({"times": F.lit(1), "df": F.lit(0).cast("long")})
        weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, times[t])]), F.col("term"))
        # As many rows as the query has terms.
        frequency = F.broadcast(self.terms_of.where(F.col("term").isin(terms)))
        return self.postings.where(F.col("term").isin(terms)).withColumn("times", weight).join(frequency, "term")

    def _weighted(self, hits: DataFrame) -> DataFrame:
        """BM25 of each (doc_id, term) among hits (postings and times, with df where it is known)."""
        if "df" not in hits.columns:
            hits = hits.join(self.terms_of, "term")
        wide = hits.crossJoin(F.broadcast(self.statistics()))
        idf = F.greatest(F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return wide.select("doc_id", "term", "positions", (F.col("times") * idf * tf).alias("score"))

    def _tokens(self, *texts: str) -> list[str]:
        """Tokens of texts of a query, by the same expression as those of documents."""
        spark = self.postings.sparkSession
        return list(spark.sql("SELECT 1").select(F.flatten(F.array(*[self.analyze(F.lit(t)) for t in texts])).alias("t")).first()[0]) if texts else []

    def _ranked(self, scored: DataFrame, limit: int | None) -> DataFrame:
        total = scored.groupBy("doc_id").agg(F.sum("score").alias("score"))
        ordered = total.orderBy(F.col("score").desc(), "doc_id")
        return total if limit is None else ordered.limit(limit)

    def search(self, text: str, limit: int | None = 10) -> DataFrame:
        """Any of the tokens; a token twice in the query counts twice."""
        return self._ranked(self._weighted(self._hits(Counter(self._tokens(text)))), limit)

    def _expanded(self, test: Column, limit: int | None) -> DataFrame:
        """Terms that pass a test, which runs once for each term and not for each posting. Where they are few they go to the scan as literals; else they are joined."""
        chosen = self.terms_of.where(test)
        few = chosen.select("term").limit(MOST_LITERALS + 1).collect()
        if len(few) > MOST_LITERALS:
            return self._ranked(self._weighted(self.postings.join(chosen, "term").withColumn("times", F.lit(1))), limit)
        names = sorted(r.term for r in few)
        hits = self.postings.where(F.col("term").isin(names)).withColumn("times", F.lit(1))
        return self._ranked(self._weighted(hits.join(F.broadcast(self.terms_of.where(F.col("term").isin(names))), "term")), limit)

    def dictionary(self) -> DataFrame:
        return self.terms_of.select("term")

    def fuzzy(self, text: str, max_distance: int = 1, limit: int | None = 10) -> DataFrame:
        """Terms within an edit distance of any token; each counts once."""
        test = F.lit(False)
        for t in sorted(set(self._tokens(text))):
            close = F.abs(F.char_length("term") - len(t)) <= max_distance
            test = test | (close & (F.levenshtein("term", F.lit(t), max_distance) >= 0))
        return self._expanded(test, limit)

    def regexp(self, pattern: str, limit: int | None = 10) -> DataFrame:
        return self._expanded(F.rlike("term", F.lit(f"^(?:{pattern})$")), limit)

    def wildcard(self, pattern: str, limit: int | None = 10) -> DataFrame:
        return self._expanded(F.rlike("term", F.lit(glob_to_regex(pattern.lower()))), limit)

    def terms(self, values: Sequence[str], field: str | None = None, limit: int | None = 10) -> DataFrame:
        """Any of the values as they are, lower-cased, of documents whose field contains one of them."""
        values = sorted({v.lower() for v in values})
        scored = self._weighted(self._hits(dict.fromkeys(values, 1)))
        if field:
            held = F.lit(False)
            for v in values:
                held = held | F.contains(F.lower(F.col(field)), F.lit(v))
            scored = scored.join(self.fields.where(held).select("doc_id"), "doc_id", "left_semi")
        return self._ranked(scored, limit)

    def term(self, value: str, field: str | None = None, limit: int | None = 10) -> DataFrame:
        return self.terms([value], field, limit)

    def boolean(self, must: Sequence[str] = (), should: Sequence[str] = (), must_not: Sequence[str] = (), limit: int | None = 10) -> DataFrame:
        """All of ``must``, any of ``should`` if there is no ``must``, none of ``must_not``; a term in both lists scores twice."""
        m, s, x = (sorted(set(self._tokens(*texts))) for texts in (must, should, must_not))
        times = Counter([*m, *s]) | Counter(dict.fromkeys(x, 0))
        for t in set(x) - {*m, *s}:
            times[t] = 0
        scored = self._weighted(self._hits(times))
        having = lambda listed: F.count_if(F.col("term").isin(listed)) if listed else F.lit(0)
        per_doc = scored.groupBy("doc_id").agg(F.sum("score").alias("score"), having(m).alias("m"), having(s).alias("s"), having(x).alias("x"))
        enough = F.col("m") == len(m) if m else F.col("s") > 0
        kept = per_doc.where(enough & (F.col("x") == 0)).select("doc_id", "score")
        return kept.orderBy(F.col("score").desc(), "doc_id").limit(limit) if limit is not None else kept

    def phrase(self, text: str, limit: int | None = 10) -> DataFrame:
        """Consecutive positions, stop words not counted."""
        order = self._tokens(text)
        hits = self._hits(Counter(order))
        if not order:
            return self._ranked(self._weighted(hits), limit)
        places = F.element_at(F.create_map(*[x for t in sorted(set(order)) for x in (F.lit(t), F.array(*[F.lit(i) for i, o in enumerate(order) if o == t]))]), F.col("term"))
        starts = hits.select("doc_id", "positions", F.explode(places).alias("i")).select("doc_id", "i", F.explode(F.transform("positions", lambda p: p - F.col("i"))).alias("start"))
        found = starts.groupBy("doc_id", "start").agg(F.count_distinct("i").alias("have")).where(F.col("have") == len(order)).select("doc_id").distinct()
        return self._ranked(self._weighted(hits).join(found, "doc_id", "left_semi"), limit)

    def multi_field(self, text: str, weights: Mapping[str, float], limit: int = 10) -> DataFrame:
        """The best max(3 * limit, 30) by the whole text, scored again by their best field times its weight."""
        if not weights:
            return self.search(text, limit)
        most = max(3 * limit, 30)
        candidates = self.search(text, most).select("doc_id")
        times = Counter(self._tokens(text))
        weight = F.element_at(F.create_map(*[F.lit(x) for t in sorted(times) for x in (t, times[t])]), F.col("term")) if times else F.lit(1)
        frequency = self.terms_of.where(F.col("term").isin(sorted(times))).withColumn("times", weight)
        # As literals the candidates come before the fields are made, at the scan, and are searched for once.
        chosen = self.fields.join(candidates, "doc_id", "left_semi") if most > MOST_LITERALS else self.fields.where(F.col("doc_id").isin([r.doc_id for r in candidates.collect()]))
        sides = []
        for name, weight in weights.items():
            split = chosen.select("doc_id", self.analyze(F.coalesce(F.col(name), F.lit(""))).alias("t"))
            each = split.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
            sides.append(each.select("*", F.lit(name).alias("field"), F.lit(float(weight)).alias("weight")))
        every = sides[0]
        for side in sides[1:]:
            every = every.unionByName(side)
        wide = every.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(self.statistics()))
        idf = F.greatest(F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        by_field = wide.groupBy("doc_id", "field").agg(F.sum(F.col("weight") * F.col("times") * idf * tf).alias("score"))
        best = by_field.groupBy("doc_id").agg(F.max("score").alias("score"))
        return best.orderBy(F.col("score").desc(), "doc_id").limit(limit)

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        """Terms with a prefix by the number of documents that have them."""
        near = self.terms_of.where(F.startswith("term", F.lit(prefix.lower())))
        return near.select("term", F.col("df").alias("doc_freq")).orderBy(F.col("doc_freq").desc(), "term").limit(limit)

    def sorted_by(self, text: str, field: str, descending: bool = False, limit: int = 10) -> DataFrame:
        """Matches in the order of a field: numbers before texts."""
        hits = self.search(text, None).join(self.fields.select("doc_id", F.col(field).alias("__f")), "doc_id")
        number = F.col("__f").try_cast("double")
        keys = [number.isNull().cast("int"), number.desc() if descending else number.asc(), F.col("__f").desc() if descending else F.col("__f").asc(), F.col("doc_id").asc()]
        return hits.orderBy(*keys).select("doc_id", "score", F.col("__f").alias(field)).limit(limit)


def highlight(text: Column, words: Sequence[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Whole words of a query marked, without regard to case."""
    if not words:
        return text
    options = "|".join(sorted({w for w in words}, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({options})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


def range_query(df: DataFrame, field: str, gte: str | None = None, gt: str | None = None, lte: str | None = None, lt: str | None = None) -> DataFrame:
    """Numbers are compared as such where both sides are numbers, all else as text. Every match scores 1."""
    test = F.lit(True)
    for bound, compare in ((gte, lambda a, b: a >= b), (gt, lambda a, b: a > b), (lte, lambda a, b: a <= b), (lt, lambda a, b: a < b)):
        if bound is not None:
            left, right = F.col(field).cast("string"), F.lit(str(bound))
            number, limit = left.try_cast("double"), right.try_cast("double")
            test = test & F.when(number.isNotNull() & limit.isNotNull(), compare(number, limit)).otherwise(compare(left, right))
    return df.where(F.coalesce(test, F.lit(False))).withColumn("score", F.lit(1.0))


def term_counts(df: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """Values of a field by how often they occur."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.col("doc_count").desc(), "key").limit(limit)


def update_by_query(df: DataFrame, hits: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """The table with columns changed in the rows that a query found."""
    marked = df.join(hits.select(F.col(key)).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*df.columns)


def delete_by_query(df: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return df.join(hits.select(key), key, "left_anti")


def rank(scored: DataFrame, key: str, by: Sequence[Column]) -> DataFrame:
    """Adds a rank from 1 over few rows, such as those of a limited search."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*by, key)))
