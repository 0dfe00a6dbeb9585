"""Incremental ingestion of text files: what has arrived since the last run is chunked and replaces earlier chunks of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import flat_chunks


def arriving_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (rel_path, text), one row for each file."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("rel_path"), F.col("value").alias("text"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Run once over what is new. Every batch has its own folder, which a repeated batch overwrites, so nothing is counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        flat_chunks(batch, key="rel_path").write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = arriving_texts(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_chunks(spark: SparkSession, target: str, folder: str | None = None) -> DataFrame:
    """The chunks of each file's latest batch; with the `folder`, only of files that are still there, since a stream of arrivals doesn't tell of removals."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("rel_path").agg(F.max("batch").alias("batch"))
    now = rows.join(latest, ["rel_path", "batch"])
    if folder is None:
        return now
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    # paths with and without the slashes of an empty host
    bare = lambda c: F.regexp_replace(c, "^([a-z]+:)/+", "$1/")
    return now.join(there.select(bare(F.col("path")).alias("p")).distinct(), bare(F.col("rel_path")) == F.col("p"), "left_semi")
