"""Whole answers for batches of queries: routing by title, ranked legs, fusion, reranking, parents, guard, diversity, budget; rounds of
sub-queries; sections of whole works; catalogue requests; evaluation runs. Scorers and generators are arguments, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.stem import stem_map, stems
from ..functions.text import tokens
from ..session import stored
from . import best, evaluation, index, library, rank
from .places import placed

POOL, TOP, BUDGET = 40, 8, 3000
#: Passages of each work that a query names.
NAMED_CAP = 8
#: Sections that one call of a summariser gets.
BATCH = 6


def routed(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, title) of the works that queries name; a query that names none isn't in it."""
    return rank.matched_titles(queries, chunks.select("title").distinct()).select("query_id", "title")


def within_titles(hits: DataFrame, routes: DataFrame) -> DataFrame:
    """The hits of queries that name works, in these works alone. hits: query_id, title."""
    return hits.join(routes.select("query_id", "title"), ["query_id", "title"], "left_semi")


def pool(queries: DataFrame, chunks: DataFrame, statistics: index.Statistics | None = None, dense: DataFrame | None = None, size: int = POOL) -> DataFrame:
    """(query_id, doc_id, title, document, rank, distance, named). A query that names works gets the best of these works alone, by the vector index where there is one and without fusion (named);
    if they have no hit, or it names none, it gets the best of the fused legs. chunks: doc_id, title, text. dense: (query_id, doc_id, score, rank) of a vector index; without it
    distances are null."""
    titles = chunks.select("doc_id", "title")
    if dense is not None:  # hits of others would meet the texts for nothing
        dense = dense.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    routes = stored(routed(queries, chunks), "routes")
    statistics = statistics or index.Statistics(chunks)
    if dense is None:
        inside = best.bm25_top(chunks, queries.join(routes.select("query_id").distinct(), "query_id", "left_semi"), size, statistics=statistics, only=routes)
    else:
        leg = dense.select("query_id", "doc_id", "score").join(routes.select("query_id").distinct(), "query_id", "left_semi").join(titles, "doc_id")
        inside = index.top_k(within_titles(leg, routes).select("query_id", "doc_id", "score"), size)
    inside = stored(inside.select("query_id", "doc_id", "rank"), "named")
    named = inside.select("query_id").distinct()
    legs = best.bm25_top(chunks, queries.join(named, "query_id", "left_anti"), size, statistics=statistics)
    if dense is not None:
        legs = rank.hybrid(dense.select("query_id", "doc_id", "rank").join(named, "query_id", "left_anti"), legs, "doc_id")
    both = legs.where(F.col("rank") <= size).select("query_id", "doc_id", "rank", F.lit(False).alias("named")).unionByName(inside.withColumn("named", F.lit(True)))
    if dense is not None:
        both = both.join(dense.select("query_id", "doc_id", (1 - F.col("score")).alias("distance")), ["query_id", "doc_id"], "left")
    else:
        both = both.withColumn("distance", F.lit(None).cast("double"))
    found = both.join(chunks.select("doc_id", "title", F.col("text").alias("document")), "doc_id")
    return found.select("query_id", "doc_id", "title", "document", "rank", "distance", "named")


def guarded(queries: DataFrame, hits: DataFrame, common: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """(query_id, warning): why the pool of a query looks off target, or null. A pool without distances is judged by its words alone. Hits may have source, tags and author beside title
    and document. common: (token) of the corpus's common terms, see index.common_terms; names that are among them may be missing."""
    about = ["document", "title", *(c for c in ("source", "tags", "author") if c in hits.columns)]
    words = hits.select("query_id", F.explode(F.array_distinct(stems(F.concat_ws(" ", *about)))).alias("stem"), "distance", "rank")
    pools = words.groupBy("query_id").agg(F.collect_set("stem").alias("pool"), F.min_by("distance", "rank").alias("top"))
    x = queries.select("query_id", "text", stem_map(F.col("text")).alias("stem_of")).join(pools, "query_id", "left")
    own = lambda t: F.transform(tokens(t), lambda w: F.coalesce(F.try_element_at("stem_of", w), w))
    nothing = F.array().cast("array<string>")
    if common is None:
        x = x.withColumn("common", nothing)
    else:  # those of the common terms that a message has as names
        names = queries.select("query_id", F.explode(F.array_distinct(rank.proper_phrases(F.col("text")))).alias("token")).join(common.select("token"), "token", "left_semi")
        x = x.join(names.groupBy("query_id").agg(F.collect_set("token").alias("common")), "query_id", "left").withColumn("common", F.coalesce("common", nothing))
    reason = rank.low_relevance(F.col("text"), F.col("pool"), F.coalesce("top", F.lit(0.0)), own, F.col("common"), threshold)
    return x.select("query_id", reason.alias("warning"))


def grounded(queries: DataFrame, chunks: DataFrame, parents: DataFrame | None = None, dense: DataFrame | None = None, statistics: index.Statistics | None = None, reranker: Callable[[Column, Column], Column] = rank.lexical_overlap, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(query_id, doc_id, title, document, place, used): what an answer is built on. The pool is reranked, children give way to their parents
    (parents: parent_id, text; chunks then have parent_id), equal texts and crowded titles thin out, and the words stay within the budget; with parents the first hit stays in any case. Hits of
    named works aren't reranked, and up to eight of each work stay, however many works there are."""
    hits = pool(queries, chunks, statistics, dense).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    own = hits.where("named").withColumn("rerank_score", F.lit(None).cast("double"))
    hits = rank.reranked(hits.where("NOT named"), reranker(F.col("query"), F.col("document"))).unionByName(own)
    if parents is not None:
        hits = hits.join(chunks.select("doc_id", "parent_id"), "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))
        hits = rank.with_parents(hits, parents)
    chosen = rank.diversified(hits.where("NOT named"), limit=top).unionByName(rank.diversified(hits.where("named"), cap=NAMED_CAP, limit=POOL)).drop("rank").withColumnRenamed("place", "rank")
    return rank.within_budget(chosen, budget, 0 if parents is None else 1).select("query_id", "doc_id", "title", "document", F.col("rank").alias("place"), "used")


def sources(answers: DataFrame) -> DataFrame:
    """(query_id, title, place): each cited work once, at its first place."""
    return answers.groupBy("query_id", "title").agg(F.min("place").alias("place"))


def several_hops(queries: DataFrame, search: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame, DataFrame], DataFrame], hops: int = 2, top: int = POOL) -> DataFrame:
    """Hits of queries and of the sub-queries that `ask` (queries, hits so far) makes of them, (query_id, text), each document once for each query: in the
    first round that finds it, and the whole in order of score. search: (query_id, text) to (query_id, doc_id, score)."""
    found = search(queries).withColumn("hop", F.lit(0))
    for k in range(1, hops):
        more = search(ask(queries, found)).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).withColumn("hop", F.lit(k))
        found = found.unionByName(more.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hop", "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def deep_sections(hits: DataFrame, parents: DataFrame, n: int) -> DataFrame:
    """Sections for a long answer: the distinct parents of a query's hits in order of place, then title, n of them spread evenly.
    hits: query_id, parent_id; parents: parent_id, title, ordinal, text."""
    own = hits.select("query_id", "parent_id").distinct().join(parents, "parent_id")
    own = own.withColumn("place_in_works", F.struct("ordinal", "title", "parent_id"))
    return rank.even_spread(own, n, "place_in_works", "query_id").drop("place_in_works")


def summary_batches(sections: DataFrame, per: str = "query_id", order: str = "pos", size: int = BATCH) -> DataFrame:
    """(per, batch, material): what one call of a summariser gets; its answers, in order of batch, are one more call's material."""
    w = Window.partitionBy(per).orderBy(order)
    x = sections.withColumn("i", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("i") / size))
    part = F.struct("i", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("text")).alias("text"))
    return x.groupBy(per, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("material"))


def summarised(sections: DataFrame, summarise: Callable[[Column], Column], per: str = "query_id", order: str = "pos") -> DataFrame:
    """(per, summary): batches are summarised, then the summaries of a query, in order."""
    parts = summary_batches(sections, per, order).withColumn("said", summarise(F.col("material")))
    whole = parts.groupBy(per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "said"))), lambda p: p["said"]), "\n\n").alias("material"))
    return whole.select(per, summarise(F.col("material")).alias("summary"))


def catalogue_asks(messages: DataFrame) -> DataFrame:
    """(query_id, topic, of) of the messages that ask for the catalogue; an empty topic stands for all works, an empty `of` for every kind. messages: query_id, text."""
    q = F.col("text")
    return messages.where(intent.is_listing(q)).select("query_id", intent.topic(q).alias("topic"), F.coalesce(intent.kind(q), F.lit("")).alias("of"))


def catalogue_lists(asks: DataFrame, books: DataFrame) -> DataFrame:
    """(topic, of, title, rank): all works of each list that is asked for, once, however many messages ask for it: by title without a topic, else those that fit it.
    asks: topic, of; books: title, source, kind, tags."""
    lists = stored(asks.select("topic", "of").distinct(), "listings")
    shelves = stored(books.select("title", F.explode(F.array(F.col("kind"), F.lit(""))).alias("of")).distinct(), "shelves")
    own = shelves.join(lists.where("topic = ''"), "of")
    at, _ = placed(own, "of", F.lower("title"), "title")
    before = F.broadcast(at.groupBy("of").agg(F.min("place").alias("least")))  # a row for each kind
    whole = at.join(before, "of").select("topic", "of", "title", (F.col("place") - F.col("least") + 1).cast("int").alias("rank"))
    on = lists.where("topic <> ''")
    near = library.lexical_leg(on.select(F.col("topic").alias("query_id"), F.col("topic").alias("text")).distinct(), books)
    near = near.select(F.col("query_id").alias("topic"), "title", "rank").join(on, "topic").join(shelves, ["title", "of"])
    fit = near.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "of").orderBy("rank")))
    return whole.unionByName(fit.select("topic", "of", "title", "rank"))


def catalogue_answers(messages: DataFrame, books: DataFrame) -> DataFrame:
    """(query_id, title, rank) for messages that ask for the catalogue: all works by title where the message has no topic, else all those that fit it; of
    the kind it names. messages: query_id, text; books: title, source, kind, tags."""
    asks = stored(catalogue_asks(messages), "catalogue-asks")
    return asks.join(catalogue_lists(asks, books), ["topic", "of"]).select("query_id", "title", "rank")


def ranked_units(topics: DataFrame, sections: DataFrame, statistics: index.Statistics | None = None, most: int = 120) -> DataFrame:
    """(query_id, unit, score, rank): the sections that fit a topic best. topics: query_id, text; sections: unit, text."""
    return best.bm25_top(sections, topics, most, key="unit", statistics=statistics)


def evaluated(golden: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Metrics of each golden row. Rows of mode `retrieval` expect a title among the hits' (one within the other); rows of mode `topic` expect works.
    golden: query_id, mode, expected_title, expected_works; hits: query_id, title, rank (one row for each hit, or for each work found)."""
    wanted = golden.where("mode = 'topic'").select("query_id", F.explode("expected_works").alias("expected")).unionByName(golden.where("mode <> 'topic' AND expected_title IS NOT NULL").select("query_id", F.col("expected_title").alias("expected")))
    shown = hits.where(F.col("rank") <= k)
    met = shown.join(wanted, "query_id").where(evaluation.titles_match(F.col("title"), F.col("expected")))
    by = met.groupBy("query_id").agg(F.min("rank").alias("best"), F.countDistinct("expected").alias("found"), F.countDistinct("rank").alias("good"))
    n = wanted.groupBy("query_id").agg(F.countDistinct("expected").alias("wanted"))
    total = shown.groupBy("query_id").agg(F.count("*").alias("shown"))
    x = golden.select("query_id", "mode").join(n, "query_id").join(by, "query_id", "left").join(total, "query_id", "left")
    zero = F.lit(0.0)
    return x.select("query_id", "mode", F.col("best").isNotNull().cast("int").alias("hit"), F.coalesce(1 / F.col("best"), zero).alias("rr"), F.coalesce(F.col("found") / F.col("wanted"), zero).alias("recall"), F.coalesce(F.col("good") / F.col("shown"), zero).alias("precision"))
