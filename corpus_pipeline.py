"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents; other columns of docs,
whatever their names, are left out. An empty table goes through as an empty one. Rows that repeat are treated alike; ties go to the smaller
id; what each stage does with null ids and null and empty texts is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, language_id, line_dedup, mixing, near_dup
from foliant.llm.common import clear, marked, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages of the labelled rows go, and those without a letter (null and empty texts too)."""
    models = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identified(docs, models).where("NOT lang_rejected").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two lines or more that an earlier document has are taken out of the text; every document stays, also one that becomes empty. A null text stays null."""
    return _as_documents(line_dedup.line_dedup(docs, whole=True))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; null and empty texts are one group. Rows without an id all stay."""
    return near_dup.one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time; the last of a source's quota may be cut. Null sources are one source; documents without words are not taken."""
    return _as_documents(mixing.mixed_documents(docs, COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the language models nor the draws of the mix; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written besides its result goes when the result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        own = marked()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, own, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
