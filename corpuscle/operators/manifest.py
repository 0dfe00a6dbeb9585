"""Incremental ingestion: what is new, changed or stale; upserts and deletes; the metadata joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_state(scan: DataFrame, manifest: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, state): current, touched (same size and content), changed or new. Content hashes are compared only where size agrees and time
    doesn't; the scan's `content` may be an expression that is only read then."""
    m = manifest.select(F.col(key).alias("k"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("content_hash").alias("old_hash"))
    x = scan.join(m, F.col(key) == F.col("k"), "left")
    state = (
        F.when(F.col("k").isNull(), "new")
        .when((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), "current")
        .when((F.col("size") == F.col("old_size")) & (F.sha2(F.col("content").cast("binary"), 256) == F.col("old_hash")), "touched")
        .otherwise("changed")
    )
    return x.select(key, state.alias("state"))


def stale(manifest: DataFrame, seen: DataFrame, key: str = "rel_path") -> DataFrame:
    return manifest.join(seen.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and of old those whose keys new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def deleted_where(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def renamed_set(rows: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    """Rows of set `old` become rows of `new`, where they replace rows with equal keys."""
    moved = rows.where(F.col("set_name") == old).withColumn("set_name", F.lit(new))
    kept = rows.where(F.col("set_name") == new).join(moved.select(*keys), keys, "left_anti")
    return rows.where(~F.col("set_name").isin(old, new)).unionByName(kept).unionByName(moved)


def with_tags(books: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """books (book, title), links (book, tag), tags (tag, name): each book with its tag names in order; books without tags stay."""
    named = links.join(tags, "tag", "left").groupBy("book").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return books.join(named, "book", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def merged_first(hits: DataFrame, key: str = "chunk_id", order: tuple = ("hop", "rank")) -> DataFrame:
    """The first of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")
