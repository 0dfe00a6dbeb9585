"""Retrieval metrics and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_spaced

TOLERANCE = 0.05


def titles_match(a: Column, b: Column) -> Column:
    """One normalised title within the other."""
    x, y = norm_spaced(a), norm_spaced(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def query_metrics(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """hit, reciprocal rank, recall and precision at k for each query. hits: (query_id, item, rank); wanted: (query_id, item).
    A query without hits scores 0."""
    top = hits.where(F.col("rank") <= k)
    found = top.join(wanted.distinct(), ["query_id", "item"])
    best = found.groupBy("query_id").agg(F.min("rank").alias("best"), F.countDistinct("item").alias("found"))
    n = wanted.groupBy("query_id").agg(F.countDistinct("item").alias("wanted"))
    shown = top.groupBy("query_id").agg(F.count("*").alias("shown"))
    x = n.join(best, "query_id", "left").join(shown, "query_id", "left")
    zero = F.lit(0.0)
    return x.select(
        "query_id",
        F.col("best").isNotNull().cast("int").alias("hit"),
        F.coalesce(1 / F.col("best"), zero).alias("rr"),
        F.coalesce(F.col("found") / F.col("wanted"), zero).alias("recall"),
        F.coalesce(F.col("found") / F.col("shown"), zero).alias("precision"),
    )


def summary(metrics: DataFrame, per: list[str] | None = None) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id" and c not in (per or [])]
    return metrics.groupBy(*(per or [])).agg(*[F.round(F.avg(c), 4).alias(c) for c in names])


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, current, baseline, regressed): regressed if it fell below the baseline by more than the tolerance. Both: (metric, value)."""
    x = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    return x.withColumn("regressed", F.col("current") < F.col("baseline") * (1 - tolerance))
