"""Sections from bookmarks and spine items, and the section that holds a place: sorted unions with carried state instead of joins over ranges.

A document's pages are put together with two line breaks between them, so a page begins where those before it end. A mark stands at the beginning of its page; its place comes from
that page's own row. Places that look for their section are laid between the sections' beginnings in one order for each document, and each takes the last section that began at or before it.
Work and memory follow the rows of a document; nothing is compared with every range.

Defined cases: marks of pages that aren't there, without title or without page are left out; of marks at one place the first one counts; documents with fewer than `least` marks
have no sections; places before the first section, and rows of documents without sections, have a null section; null texts count as empty pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between pages, and of the longest title.
BREAK, TITLE = 2, 120
#: Levels of marks; deeper ones count as the deepest.
MOST_LEVELS = 8


def page_offsets(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, start_char, end_char) of pages (key, page, text), in order of page."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + BREAK).over(before), F.lit(0))
    return pages.select(key, "page", size.alias("size"), start.alias("start_char")).select(key, "page", "start_char", (F.col("start_char") + F.col("size")).alias("end_char"))


def collapsed_title(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " ")), 1, TITLE)


def marked_sections(marks: DataFrame, pages: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """(key, ordinal, title, level, parent, start_char, end_char): sections from marks (key, seq, level, title, page) over pages from `page_offsets`. A section ends where the next one begins, or with
    the text; its parent is the ordinal of the last section before it that has a lower level."""
    places = pages.select(key, "page", "start_char")
    m = marks.select(key, "seq", F.greatest(F.lit(1), F.least(F.coalesce("level", F.lit(1)), F.lit(MOST_LEVELS))).alias("level"), collapsed_title(F.col("title")).alias("title"), "page").where("title <> ''").join(places, [key, "page"])
    whole = Window.partitionBy(key)
    m = m.withColumn("marks", F.count("*").over(whole)).where(F.col("marks") >= least)
    m = m.withColumn("i", F.row_number().over(Window.partitionBy(key, "start_char").orderBy("seq"))).where("i = 1")
    order = Window.partitionBy(key).orderBy("start_char")
    ends = pages.groupBy(key).agg(F.max("end_char").alias("total"))
    m = m.join(ends, key).withColumn("ordinal", F.row_number().over(order) - 1)
    # the last section of each level so far is carried along, levels being 1 to MOST_LEVELS
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("ordinal"))).over(before) for n in range(1, MOST_LEVELS)]
    parent = F.array_max(F.array(*[F.when(F.col("level") > n, x) for n, x in enumerate(last, 1)]))
    return m.select(key, "ordinal", "title", "level", parent.alias("parent"), "start_char", F.coalesce(F.lead("start_char").over(order), "total").alias("end_char"))


def sections_at(places: DataFrame, sections: DataFrame, key: str = "doc_id", at: str = "start_char") -> DataFrame:
    """places with the ordinal of the section (key, ordinal, start_char) that holds them, as section."""
    own = F.struct(*[F.col(f"`{c}`") for c in places.columns])
    row = places.select(F.col(key).alias("k"), F.col(at).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("section"), own.alias("row"))
    none = F.lit(None).cast(row.schema["row"].dataType)
    begin = sections.select(F.col(key).alias("k"), F.col("start_char").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("ordinal").cast("int").alias("section"), none.alias("row"))
    w = Window.partitionBy("k").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = begin.unionByName(row).withColumn("section", F.last("section", ignorenulls=True).over(w)).where("kind = 1")
    return held.select(*[F.col("row")[c].alias(c) for c in places.columns if c != "section"], "section")
