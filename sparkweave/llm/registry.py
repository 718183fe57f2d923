"""Queries that apply each operator of this subpackage to its whole table, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import pii, secret_scan
from sparkweave.llm.curriculum import mix_sources
from sparkweave.llm.exact_dedup import exact_dedup
from sparkweave.llm.katz import crc32_of_id, katz_scores
from sparkweave.llm.language_id import fit_filters, identify_languages
from sparkweave.llm.ngram_join import ngram_jaccard_join
from sparkweave.llm.packing import pack_documents
from sparkweave.llm.quality import compression_quality
from sparkweave.llm.token_counts import section_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)
), sides AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS id, doc_id AS r FROM sets UNION SELECT sides.y, r FROM reached JOIN sides ON sides.x = reached.id
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT id, min(r) AS component_id FROM reached GROUP BY id) ON id = doc_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


OP2_SQL = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM texts
WINDOW same AS (PARTITION BY t)
"""


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), trains=crc32_of_id(F.col("doc_id")) % 10 != 0, order=3)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secret_scan.RULES if r.base]
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


def _op4_sql() -> str:
    kinds = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {order} AS rank, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps, "
            f"regexp_extract_all(t, '{pattern}') AS matches, regexp_extract_all(t, '{pattern}', {rule.group}) AS tested, {rule.least} AS least FROM texts"
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS ({" UNION ALL ".join(kinds)}),
each AS (SELECT doc_id, rank, kind, gaps, matches, tested, least, unnest(range(1, len(matches) + 1)) AS i FROM kinds),
spans AS (
  SELECT doc_id, rank, kind, length(matches[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS start
  FROM each WHERE length(tested[i]) >= least
),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id
"""


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS key
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), capped AS (
  SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap,
         [0.6, 0.0, -0.6][rank % 3 + 1]::DOUBLE AS slope, sum(source_size) OVER ()::DOUBLE AS total
  FROM ranked
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targets AS (
  SELECT source, source_size, slope, least(cap, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, slope, target, round(target)::BIGINT AS demand,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, demand - start)) AS t0,
         greatest(0, least(size, demand - source_size - start)) AS t1,
         greatest(0, least(size, demand - 2 * source_size - start)) AS t2,
         start / target AS share
  FROM placed
)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
       ((t0 > 0)::INT + (t1 > 0)::INT + (t2 > 0)::INT)::INT AS copies,
       CASE WHEN t0 > 0 THEN round(CASE WHEN abs(slope) < 1e-9 THEN share
            ELSE 2 * share / (1 + slope + sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * share, 0))) END, 6) END AS position
FROM taken
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    remainder = crc32_of_id(F.col("doc_id")) % 4
    filters = fit_filters(docs, trains=remainder != 2)
    return identify_languages(docs, filters).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE_KINDS]],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_katz_scores": op3_katz_scores,
        "op4_secret_scan": op4_secret_scan,
        "op5_pack_documents": op5_pack_documents,
        "op6_section_tokens": op6_section_tokens,
        "op7_mix_sources": op7_mix_sources,
        "op8_language_id": op8_language_id,
        "op9_compression_quality": op9_compression_quality,
        "op10_personal_data": op10_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_secret_scan": _op4_sql(), "op7_mix_sources": OP7_SQL}
