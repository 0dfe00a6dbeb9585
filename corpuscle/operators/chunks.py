"""Chunking: flat windows, sections, greedy packing of pieces, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, html_headings, is_heading, parent_id, sentences, word_count, words

CHUNK_WORDS, OVERLAP, PARENT_WORDS = 330, 60, 1200


def flat_chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of `size` words that advance by size - overlap. The last one may lie wholly inside the one before."""
    if size <= overlap:
        raise ValueError("the window must be longer than its overlap")
    step = size - overlap
    ws = docs.select(key, words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.size("ws") - 1, F.lit(step))
    cut = ws.select(key, F.size(starts).alias("total_chunks"), F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("ws", s + 1, size), " "))).alias("chunk_index", "document"))
    return cut.select(key, "chunk_index", "total_chunks", "document", chunk_id(F.col(key), F.col("chunk_index")).alias("chunk_id"))


def lines_with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line with the offset of its first character."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start_char", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def detect_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, running: int = 4) -> DataFrame:
    """Heading lines as sections (title, ordinal, start, end). A title that recurs `running` times is a running header; texts with fewer
    than `least` sections have none."""
    marks = lines_with_offsets(docs, key, text).where(is_heading(F.col("line"))).withColumn("title", F.trim("line"))
    marks = marks.withColumn("times", F.count("*").over(Window.partitionBy(key, "title"))).where(F.col("times") < running)
    marks = marks.withColumn("marks", F.count("*").over(Window.partitionBy(key))).where(F.col("marks") >= least)
    w = Window.partitionBy(key).orderBy("start_char")
    ends = docs.select(key, F.length(text).cast("long").alias("total"))
    return marks.join(ends, key).select(key, "title", (F.row_number().over(w) - 1).alias("ordinal"), "start_char", F.coalesce(F.lead("start_char").over(w), "total").alias("end_char"))


def normal_sections(sections: DataFrame, totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections clamped to the text and in order; text before the first is a section without title; each ends where the next begins at the
    latest, and the last one with the text; a text without sections is one. totals: (key, total)."""
    zero = F.lit(0).cast("long")
    x = sections.join(totals, key).withColumn("a", F.greatest(zero, F.least("start_char", "total")))
    x = x.withColumn("z", F.greatest("a", F.least("end_char", "total"))).where("z > a").select(key, F.trim("title").alias("title"), "ordinal", "a", "z", "total")
    first = x.groupBy(key, "total").agg(F.min("a").alias("z")).where("z > 0")
    front = first.select(key, F.lit("").alias("title"), F.lit(-1).alias("ordinal"), zero.alias("a"), "z", "total")
    whole = totals.where("total > 0").join(x, key, "left_anti").select(key, F.lit("").alias("title"), F.lit(0).alias("ordinal"), zero.alias("a"), F.col("total").alias("z"), "total")
    w = Window.partitionBy(key).orderBy("a", "ordinal")
    cut = x.unionByName(front).unionByName(whole).withColumn("next", F.coalesce(F.lead("a").over(w), "total")).where("next > a")
    last = F.lead("a").over(w).isNull()
    return cut.select(key, "title", (F.row_number().over(w) - 1).alias("ordinal"), F.col("a").alias("start_char"), F.when(last, F.col("total")).otherwise(F.least("z", "next")).alias("end_char"))


def packed(pieces: Column, size: int, overlap: int) -> Column:
    """Greedy packing of pieces (text, cut) into chunks of at most `size` new words; each begins with the last `overlap` words of the
    new content before it. A piece longer than that becomes the chunks in its `cut`, and nothing is carried over it. A fold, since each step needs
    the one before."""
    text = F.array().cast("array<string>")
    start = F.struct(text.alias("chunks"), text.alias("cur"), F.lit(0).alias("new"), text.alias("carry"))

    def closed(a: Column) -> Column:
        carried = F.when(F.size(a["carry"]) > 0, F.concat(F.array_join(a["carry"], " "), F.lit(" "))).otherwise(F.lit(""))
        return F.when(F.size(a["cur"]) > 0, F.concat(a["chunks"], F.array(F.concat(carried, F.array_join(a["cur"], " "))))).otherwise(a["chunks"])

    def tail(a: Column) -> Column:
        ws = words(F.array_join(a["cur"], " "))
        kept = F.slice(ws, F.greatest(F.size(ws) - overlap, F.lit(0)) + 1, F.lit(max(overlap, 1))) if overlap > 0 else text
        return F.when(F.size(a["cur"]) > 0, kept).otherwise(a["carry"])

    def step(a: Column, piece: Column) -> Column:
        n = F.size(words(piece["text"]))
        one = F.array(piece["text"])
        big = F.struct(F.concat(closed(a), piece["cut"]).alias("chunks"), text.alias("cur"), F.lit(0).alias("new"), text.alias("carry"))
        fits = F.struct(a["chunks"].alias("chunks"), F.concat(a["cur"], one).alias("cur"), (a["new"] + n).alias("new"), a["carry"].alias("carry"))
        fresh = F.struct(closed(a).alias("chunks"), one.alias("cur"), n.alias("new"), tail(a).alias("carry"))
        return F.when(n > size, big).when((F.size(a["cur"]) == 0) | (a["new"] + n <= size), fits).otherwise(fresh)

    return F.aggregate(pieces, start, step, closed)


def windows(text: Column, size: int, overlap: int) -> Column:
    ws = words(text)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.array_join(F.slice(ws, s + 1, size), " "))


def _pieces(texts: Column, size: int, cut) -> Column:
    """Pieces with the chunks that a too long one becomes."""
    empty = F.array().cast("array<string>")
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.when(word_count(t) > size, cut(t)).otherwise(empty).alias("cut")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def recursive_chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs packed into chunks; too long ones by their sentences, and a too long sentence by windows of words."""
    def by_sentence(p):
        return packed(_pieces(sentences(p), size, lambda s: windows(s, size, max(0, min(overlap, size - 1)))), size, overlap)

    chunks = packed(_pieces(paragraphs(F.col(text)), size, by_sentence), size, overlap)
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "document"))


def section_chunks(docs: DataFrame, sections: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of each section with its parent's id. sections: (key, title, ordinal, start_char, end_char)."""
    x = sections.join(docs.select(key, text), key).withColumn("body", F.expr(f"substring({text}, start_char + 1, end_char - start_char)"))
    out = recursive_chunks(x.withColumn("part", F.struct(key, "title", "ordinal")).select("part", F.col("body").alias(text)), size, overlap, "part", text)
    return out.select("part.*", "chunk_index", "document", parent_id(F.col(f"part.{key}"), F.col("part.ordinal")).alias("parent_id"))


def parents(docs: DataFrame, sections: DataFrame, most_words: int = PARENT_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The text of each section: its paragraphs, at most so many words."""
    x = sections.join(docs.select(key, text), key).withColumn("body", F.expr(f"substring({text}, start_char + 1, end_char - start_char)"))
    joined = F.array_join(paragraphs(F.col("body")), "\n\n")
    cut = F.when(word_count(joined) > most_words, F.array_join(F.slice(words(joined), 1, most_words), " ")).otherwise(joined)
    return x.select(key, F.col("title").alias("section_title"), "ordinal", parent_id(F.col(key), F.col("ordinal")).alias("parent_id"), cut.alias("text"))


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 2) -> DataFrame:
    """Headings of pages that have enough of them."""
    return pages.select(key, html_headings(F.col(html)).alias("h")).where(F.size("h") >= least).select(key, F.posexplode("h").alias("ordinal", "title"))
