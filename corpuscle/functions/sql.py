"""The functions for users of SQL: temporary functions of a session; those that give tables are in `tables`. Those that are plain expressions stay expressions, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .stem import _stemmed
from .tables import register_tables

PLAIN = {
    "corpus_tokens(text STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(text), '[a-z0-9]+', 0)",
    "corpus_words(text STRING) RETURNS ARRAY<STRING>": r"filter(split(text, '\\s+'), w -> w <> '')",
    "corpus_norm(text STRING) RETURNS STRING": r"trim(regexp_replace(lower(text), '[^a-z0-9]+', ' '))",
    "corpus_title_key(text STRING) RETURNS STRING": r"regexp_replace(lower(text), '[^a-z0-9]+', '')",
    "corpus_collapsed(text STRING) RETURNS STRING": r"lower(trim(regexp_replace(text, '\\s+', ' ')))",
    "corpus_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)",
    "corpus_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and gives their names."""
    for head, body in PLAIN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("stemmed", F.pandas_udf(_stemmed, "array<string>"))
    return [h.split("(")[0] for h in PLAIN] + ["stemmed", *register_tables(spark)]
