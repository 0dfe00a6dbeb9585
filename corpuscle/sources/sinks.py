"""Sinks: upserts by key into partitioned tables, reports and quiz exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import choice_letter, gift_escaped
from ..operators.manifest import upserted


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that the rows fall into are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], version: int) -> str:
    """A new version of a keyed table beside the old one; returns its path. Readers of the old version aren't disturbed."""
    new = f"{path}/version={version}"
    old = f"{path}/version={version - 1}"
    merged = upserted(spark.read.parquet(old), rows, keys) if version > 0 else rows
    merged.write.mode("overwrite").parquet(new)
    return new


def gift(questions: DataFrame) -> DataFrame:
    """One GIFT line for each question. questions: qid, question struct (q, type, choices, answer)."""
    right = choice_letter(F.col("question.answer"))
    options = F.array_join(F.transform("question.choices", lambda c: F.concat(F.when(choice_letter(c) == right, "=").otherwise("~"), gift_escaped(c))), " ")
    body = F.when(F.col("question.type") == "mcq", options).when(F.col("question.type") == "true_false", F.upper("question.answer")).otherwise(F.concat(F.lit("="), gift_escaped(F.col("question.answer"))))
    return questions.select(F.concat(F.lit("::"), F.col("qid").cast("string"), F.lit(":: "), gift_escaped(F.col("question.q")), F.lit(" {"), body, F.lit("}")).alias("value"))


def markdown(questions: DataFrame) -> DataFrame:
    choices = F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("question.choices", lambda c: F.concat(F.lit("- "), c)), "\n")), F.lit(""))
    return questions.select(F.concat(F.lit("### "), F.col("question.q"), choices, F.lit("\n\n**Answer:** "), F.col("question.answer"), F.lit("\n")).alias("value"))


def write_export(questions: DataFrame, path: str, form: str) -> None:
    """gift, markdown, csv or json."""
    if form == "gift":
        gift(questions).write.mode("overwrite").text(path)
    elif form == "markdown":
        markdown(questions).write.mode("overwrite").text(path)
    elif form == "csv":
        flat = questions.select("qid", "question.q", "question.type", F.array_join("question.choices", " | ").alias("choices"), "question.answer")
        flat.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        questions.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no export form {form}")
