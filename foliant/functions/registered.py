"""Scalars and a table function under names of their own in Spark's SQL. They are SQL functions, so a query that calls them is one plan that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import FINALS, FOLDED, LATIN, WORD


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for this session, in place of those of the same name; gives their names."""
    table = ", ".join(f"'{c}', {i + 1}L" for i, c in enumerate(LATIN))
    made = {
        "foliant_mirrored": f"(w STRING) RETURNS STRING RETURN translate(w, '{LATIN}', '{LATIN[::-1]}')",
        "foliant_folded": f"(w STRING) RETURNS STRING RETURN translate(regexp_replace(w, r'[֑-ֽֿׁ-ׂׄ-ׇׅ]', ''), '{FINALS}', '{FOLDED}')",
        "foliant_letter_value": f"(w STRING) RETURNS BIGINT RETURN IF(length(w) > 0, aggregate(regexp_extract_all(w, r'(?s)(.)', 1), 0L, (a, c) -> a + try_element_at(map({table}), c)), NULL)",
        "foliant_words": f"(t STRING) RETURNS TABLE(no INT, word STRING) RETURN SELECT pos, col FROM posexplode(regexp_extract_all(lower(t), r'({WORD})', 1))",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)
