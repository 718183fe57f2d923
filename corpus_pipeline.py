"""A training corpus from raw documents: five stages, each written and read again before the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.columns import pick
from sparkweave.llm.curriculum import mix_sources
from sparkweave.llm.exact_dedup import exact_dedup
from sparkweave.llm.language_id import fit_filters, identify_languages
from sparkweave.llm.ngram_join import ngram_jaccard_join
from sparkweave.llm.packing import pack_documents
from sparkweave.llm.storage import clear, collect_garbage, mark, new_path, tidy_shuffles, written, written_since

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document is in none of the learned languages only if the predicted one contains less than this share of its n-grams ...
LEAST_SCORE = 0.5
#: ... and all together contain less than this one, by more than chance explains: two standard errors, where one n-gram in twelve counts,
#: as every letter is in twelve. On 2,500 sampled texts of up to 4,000 characters of the table 0.1, with exact sets of n-grams, own languages explain 0.62 or more, and the others,
#: where a text's language is left out, 0.34 to 0.51 at the median.
LEAST_EXPLAINED, SLACK = 0.65, 3.3


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The tables that the stage before worked with.
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    """As a stage begins, the result of the one before it has been written, so the tables that one worked with are deleted: no more than one stage's tables take up room.
    Executors collect their garbage then, so that no stage starts on top of the memory that others have grown."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, _left)
        collect_garbage(spark)
        begun = mark()
        found = function(spark, docs, sf_dir)
        _left[:] = written_since(begun)
        return found

    return run_stage


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in learned languages and labels them with the one that explains most; rejects those without letters and those that no learned languages explain.

    Documents in several learned languages stay, and so do those that are too short to judge. Where no n-gram is known, a kept document keeps the label that it came with.
    """
    docs = pick(docs, *COLUMNS)
    found = identify_languages(docs, fit_filters(docs), carry=COLUMNS, explained=True)
    bound = LEAST_EXPLAINED - SLACK / F.sqrt(F.greatest("n_grams", F.lit(1)))
    stays = (F.col("score") >= LEAST_SCORE) | (F.col("explained") >= bound)
    lang = F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(F.col("lang"))
    return found.where((F.col("lang_pred") != "und") & stays).select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents, each with a number of its own, by which decisions find the very row that they were made for; written, so that it never changes."""
    return written(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents with equal texts, the one with the smallest doc_id; a null doc_id only where there is no other, and one row of those that share a doc_id."""
    rows = _numbered(docs)
    kept = exact_dedup(rows, carry=["row"]).where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents that links join, the one with the smallest doc_id; a null doc_id only where there is no other.

    Rows that share a doc_id are documents of their own, which only their texts link; of linked ones, one row stays.
    """
    rows = _numbered(docs)
    linked = ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = linked.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(best.alias("best")).select("best.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that the words of the sources stand in the target weights, and sorts them by training position; a document comes once for
    each pass that takes it, at the position of that pass.

    Rows that share a doc_id, or have none, are read and repeated one by one.
    """
    rows = _numbered(docs)
    reads = mix_sources(rows, carry=["row"]).where("copies > 0").select("row", "positions")
    passes = rows.join(reads, "row").select(*COLUMNS, "row", F.explode("positions").alias("position"))
    return passes.orderBy("position", "row").select(*COLUMNS)


def _in_blocks(docs: DataFrame, rows_per_block: int = 10_000) -> DataFrame:
    """The documents with a column "block" that numbers stretches of the table's files in order: the files of a sorted table hold its rows in order."""
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:  # not a table of files
        docs = written(docs, "pipeline-ordered")
    part = F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).try_cast("long")
    block = F.shiftleft(F.coalesce(part, F.lit(0)), 18) + F.floor(F.col("_metadata.row_index") / rows_per_block)
    return docs.select("doc_id", "text", block.alias("block"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences. Documents that are near each other in training are packed together: ``block`` numbers stretches of
    the training order, so the sequences are to be read in the order of ``block``."""
    import public_tokenizers

    packed = pack_documents(_in_blocks(docs), public_tokenizers.path("word_bpe_49k.json"), block="block")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "block")


STAGES = [
    ("identify languages", identify),
    ("drop exact copies", drop_copies),
    ("drop near copies", drop_near_copies),
    ("mix sources", mix),
    ("pack sequences", pack),
]

#: Language scores, shingle links and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each to what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            before, path = path, new_path(spark, f"pipeline-{number}")
            with tidy_shuffles(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
            clear(spark, [before] if before else [])
    return docs
