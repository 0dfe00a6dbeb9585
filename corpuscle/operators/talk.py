"""Conversations: summaries, titles, last answers, and the history that fits a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST, CHARS, OVERHEAD, TITLE = 12, 2500, 40, 42


def summaries(turns: DataFrame) -> DataFrame:
    """Messages, last turn, a title from the first user message, and the last assistant message of each conversation."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    said = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    first = F.trim(F.regexp_replace(F.min(user)["text"], r"\s+", " "))
    title = F.when(F.length(first) > TITLE, F.concat(F.substring(first, 1, TITLE), F.lit("…"))).otherwise(first)
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), title.alias("title"), F.max(said)["text"].alias("last_answer"))


def history(turns: DataFrame, budget: int, newest_first: bool = False) -> DataFrame:
    """Of the last LAST messages, each cut to CHARS, those that fit the budget. They are counted from the oldest, so that over budget the newest are
    lost; newest_first counts from the newest."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ahead = Window.partitionBy("conv_id").orderBy(F.desc("turn") if newest_first else "turn").rowsBetween(Window.unboundedPreceding, 0)
    x = turns.withColumn("i", F.row_number().over(back)).where(F.col("i") <= LAST).drop("i").withColumn("text", F.substring("text", 1, CHARS))
    return x.withColumn("used", F.sum(F.length("text") + OVERHEAD).over(ahead)).where(F.col("used") <= budget)
