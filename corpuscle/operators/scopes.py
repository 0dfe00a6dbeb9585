"""What a quiz covers: units from sections or an outline, choices of units, depth, and progress over a work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key

#: Share of the requested number of questions that a depth keeps as units.
DEPTHS = {"surface": 1.0, "balanced": 0.6, "deep": 0.4}
OUTLINE = r"(?im)^\s*UNIT\s+([\d.]+)\s*[:.\-]\s*(.*?)\s*\|\s*SUBTOPICS\s*[:.]\s*(.*?)\s*$"


def units_of(sections: DataFrame) -> DataFrame:
    """One unit for each section. sections: work, ordinal, title, parent_id, words. Units are keyed by work and parent, since numbers
    recur between works."""
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Section "), F.col("ordinal").cast("string")))
    return sections.select("work", F.concat(F.lit("u"), F.col("ordinal").cast("string")).alias("unit_id"), "ordinal", named.alias("title"), "parent_id", "words", F.array().cast("array<string>").alias("subtopics"))


def outlined(outlines: DataFrame, sections: DataFrame) -> DataFrame:
    """Units named by an outline (work, text) with at most five subtopics; a work whose outline names none has a unit for each section."""
    lines = outlines.select("work", F.posexplode(F.regexp_extract_all("text", F.lit(OUTLINE), F.lit(0))).alias("i", "line"))
    got = lines.select("work", "i", *[F.regexp_extract("line", OUTLINE, k).alias(n) for k, n in ((1, "number"), (2, "named"), (3, "topics"))])
    got = got.withColumn("ordinal", F.floor(F.col("number").try_cast("double")).cast("int")).where("ordinal IS NOT NULL")
    first = Window.partitionBy("work", "ordinal").orderBy("i")
    got = got.withColumn("again", F.row_number().over(first)).where("again = 1")
    topics = F.slice(F.filter(F.transform(F.split("topics", ","), lambda t: F.trim(t)), lambda t: t != ""), 1, 5)
    told = units_of(sections).drop("subtopics").join(got.select("work", "ordinal", "named", topics.alias("subtopics")), ["work", "ordinal"])
    told = told.withColumn("title", F.coalesce(F.nullif("named", F.lit("")), "title")).drop("named")
    rest = units_of(sections).join(told.select("work").distinct(), "work", "left_anti")
    return told.select(*rest.columns).unionByName(rest)


def chosen(units: DataFrame, wanted: list[str]) -> DataFrame:
    """Units by id, by number, or by a range of numbers such as 3-8; each once."""
    hit = F.lit(False)
    for w in (x.strip() for x in wanted):
        a, dash, b = w.partition("-")
        if dash and a.isdigit() and b.isdigit():
            hit = hit | F.col("ordinal").between(min(int(a), int(b)), max(int(a), int(b)))
        else:
            hit = hit | (F.col("unit_id") == w) | (F.col("ordinal").cast("string") == w)
    return units.where(hit)


def top_units(ranked: DataFrame, depth: str, count: int, per: str = "query_id") -> DataFrame:
    """The best units that a depth keeps; one at least. ranked: rank from 1."""
    keep = max(1, -int(-count * DEPTHS.get(depth, DEPTHS["balanced"]) // 1))
    return ranked.where(F.col("rank") <= keep)


def within(a: Column, b: Column) -> Column:
    """One title key holds the other."""
    x, y = title_key(a), title_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def quizzed(questions: DataFrame, work: str) -> DataFrame:
    """(unit_key, questions) that cite a work. questions: title, section_title."""
    mine = questions.where(within(F.col("title"), F.lit(work)) & (F.coalesce("section_title", F.lit("")) != ""))
    return mine.groupBy(title_key(F.col("section_title")).alias("unit_key")).agg(F.count("*").alias("questions"))


def coverage(accepted: DataFrame, units: DataFrame) -> DataFrame:
    """Accepted questions of every unit, none included. accepted: unit; units: unit."""
    n = accepted.groupBy("unit").agg(F.count("*").alias("n"))
    return units.select("unit").join(n, "unit", "left").select("unit", F.coalesce("n", F.lit(0).cast("long")).alias("accepted"))


def is_covered(indexed: DataFrame, chunks: DataFrame, least: float = 0.9) -> bool:
    """Whether an index holds enough of a collection to be used as it is."""
    n = chunks.count()
    return n == 0 or indexed.count() / n >= least


def page_confidence(tokens: DataFrame) -> DataFrame:
    """Mean confidence of each page's words, from 0 to 1; words that weren't recognised count 0. tokens: page, text, conf (0 to 100 or -1)."""
    return tokens.where("trim(text) <> ''").groupBy("page").agg((F.avg(F.greatest(F.coalesce("conf", F.lit(0.0)), F.lit(0.0))) / 100).alias("confidence"))


def decisions(files: DataFrame) -> DataFrame:
    """Files and pages by decision. files: decision, pages."""
    return files.groupBy("decision").agg(F.count("*").alias("files"), F.sum(F.greatest("pages", F.lit(0))).alias("pages"))


def by_file_name(files: DataFrame, books: DataFrame, loose: bool = False) -> DataFrame:
    """Books of files: by exact name, stem or, if loose, by a stem that the name holds (the first in order). files: rel_path; books: stem, title."""
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)
    f = files.select("rel_path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("base"))
    exact = f.join(books, f["base"] == books["stem"]).select("rel_path", "title")
    if not loose:
        return exact
    # a stem that the name holds shares its first word with it
    word = [F.element_at(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), 1) for c in ("stem",)][0]
    parts = f.join(exact, "rel_path", "left_anti").withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("base"), F.lit("[a-z0-9]+"), F.lit(0)))))
    near = parts.join(books.withColumn("word", word), "word").where(F.contains("name", "stem"))
    first = near.groupBy("rel_path").agg(F.min_by("title", "stem").alias("title"))
    return exact.unionByName(first)


def sampled_chunks(chunks: DataFrame, most: int = 50, order: str = "place", key_chars: int = 200) -> DataFrame:
    """(work, chunk_id, document, pos): chunks for a work without sections, evenly spread: of those that aren't junk every stride-th, the stride being the n-th part of `most`, each beginning of
    `key_chars` characters once, at most `most`. chunks: work, chunk_id, document, and a column of order. Null documents are junk."""
    from ..functions.text import is_junk

    good = chunks.where(~is_junk(F.coalesce("document", F.lit("")))).select("work", "chunk_id", order, F.trim("document").alias("document"))
    x = good.withColumn("pos", F.row_number().over(Window.partitionBy("work").orderBy(order, "chunk_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("work")))
    x = x.where(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("work", F.substring("document", 1, key_chars)).orderBy("pos"))).where("i = 1")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("work").orderBy("pos"))).where(F.col("i") <= most)
    return x.select("work", "chunk_id", "document", "pos")
