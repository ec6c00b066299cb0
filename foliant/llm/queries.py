"""The queries opN_<name> and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, language_id, line_dedup, near_dup, secrets, token_files, warc
from .common import table
from .exact_dedup import exact_dedup
from .mixing import op9_query


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1_query(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_query(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op3_query(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4_query(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op6_query(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_query(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_warc": op2_warc,
        "op3_language_id": op3_language_id,
        "op4_token_files": op4_token_files,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_line_dedup": op6_line_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_mix_to_weights": op9_mix_to_weights,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op6_line_dedup": line_dedup.SQL, "op10_exact_dedup": OP10_SQL}
