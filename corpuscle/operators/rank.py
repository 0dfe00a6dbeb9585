"""Ranking: exact neighbours, fusion, reranking, diversification, budgets, parents, titles, and the relevance guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.text import TERM_STOP, norm_title, tokens, word_count, words
from ..session import stored
from .contain import containing
from .nearest import neighbours
from .places import placed

RRF_K, TITLE_CAP = 60, 3


def cosine_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", centres: int = 0) -> DataFrame:
    """(query_id, key, score, rank): exact cosine neighbours, in blocks of vectors and queries; with `centres`, only in parts that may hold one. See nearest.neighbours."""
    return neighbours(vectors, queries, k, key, vector, centres)


def fused(*legs: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of legs (query_id, key, rank from 1). Ties go to the earlier leg, then the better rank, then the key."""
    ranked = None
    for i, leg in enumerate(legs):
        x = leg.select("query_id", key, (1.0 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("leg"), F.col("rank").alias("rank")).alias("seen"))
        ranked = x if ranked is None else ranked.unionByName(x)
    out = ranked.groupBy("query_id", key).agg(F.sum("part").alias("fused"), F.min("seen").alias("seen"), F.count("*").alias("legs"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "seen", key)
    return out.withColumn("rank", F.row_number().over(w)).drop("seen")


def hybrid(dense: DataFrame, lexical: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Fusion where the lexical leg leaves out what the dense leg has, so that the legs interleave."""
    rest = lexical.join(dense.select("query_id", key), ["query_id", key], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return fused(dense, rest.withColumn("rank", F.row_number().over(w)), key=key, k=k)


def reranked(hits: DataFrame, score: Column, top: int = 24) -> DataFrame:
    """At most 2 * top hits of each query are scored; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    scored = hits.where(F.col("rank") <= 2 * top).withColumn("rerank_score", score)
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top).drop("rank").withColumnRenamed("new_rank", "rank")


def lexical_overlap(query: Column, document: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's tokens in the document."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(document))) / F.size(q))


def diversified(hits: DataFrame, cap: int = TITLE_CAP, limit: int = 8, per: str = "query_id") -> DataFrame:
    """Best first: equal texts of a title go, then each title has at most `cap` hits, then `limit` stay."""
    same = Window.partitionBy(per, "title", "document").orderBy("rank")
    title = Window.partitionBy(per, "title").orderBy("rank")
    order = Window.partitionBy(per).orderBy("rank")
    x = hits.withColumn("i", F.row_number().over(same)).where("i = 1").withColumn("i", F.row_number().over(title)).where(F.col("i") <= cap)
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("i")


def within_budget(hits: DataFrame, budget: int, least: int = 1, per: str = "query_id", text: str = "document") -> DataFrame:
    """The longest prefix whose words stay within the budget; the first `least` stay in any case."""
    w = Window.partitionBy(per).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = hits.withColumn("n_words", word_count(F.col(text))).withColumn("used", F.sum("n_words").over(w)).withColumn("kept", F.count("*").over(w))
    return x.where((F.col("used") <= budget) | (F.col("kept") <= least)).drop("kept")


def with_parents(hits: DataFrame, parents: DataFrame, per: str = "query_id") -> DataFrame:
    """Each parent once, at its best child's place; a hit without parent stands for itself."""
    x = hits.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    group = F.coalesce(F.when(F.col("parent_text").isNotNull(), F.col("parent_id")), F.concat(F.lit("self:"), F.col("chunk_id")))
    w = Window.partitionBy(per, "group").orderBy("rank")
    first = x.withColumn("group", group).withColumn("i", F.row_number().over(w)).where("i = 1").drop("i", "group")
    return first.withColumn("child_document", F.col("document")).withColumn("document", F.coalesce("parent_text", "document")).drop("parent_text")


def even_spread(rows: DataFrame, n: int, order: str, per: str | None = None) -> DataFrame:
    """n rows spread evenly: of m rows in order, those at floor(i * m / n)."""
    if per:
        x = rows.withColumn("pos", F.row_number().over(Window.partitionBy(per).orderBy(order)) - 1).withColumn("m", F.count("*").over(Window.partitionBy(per)))
    else:
        x, m = placed(rows, order, name="pos")
        x = x.withColumn("pos", F.col("pos") - 1).withColumn("m", F.lit(m))
    # pos is floor(i * m / n) for some i < n
    i = F.ceil(F.col("pos") * F.lit(n) / F.col("m"))
    hit = (F.floor(i * F.col("m") / F.lit(n)) == F.col("pos")) & (i < n)
    return x.where((F.col("m") <= n) | hit).drop("m")


def distinctive(titles: DataFrame, share: float = 0.03) -> DataFrame:
    """(word, titles, rare): how many titles hold a word, and whether these are few enough to name a work."""
    t = titles.select(norm_title(F.col("title")).alias("t")).where("length(t) >= 3")
    n = t.count()
    return t.select(F.explode(F.array_distinct(F.filter(F.split("t", " "), lambda w: w != ""))).alias("word")).groupBy("word").agg(F.count("*").alias("titles")).withColumn("rare", F.col("titles") / F.lit(max(n, 1)) < share)


# Words of messages and titles that don't tell works apart.
TITLE_STOP = "the a an and or of to in on for with by from at as is are be was were it its his her their they them what which whose when where how why this that these those book books summarize summary synopsis overview about tell explain give best all any some my your me please can you does do would should".split()
#: Letters of a word that names a work by itself.
ONE_WORD = 5


def _own_words(t: Column) -> Column:
    return F.array_distinct(F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(*TITLE_STOP)))


def _word_pairs(ws: Column) -> Column:
    return F.flatten(F.transform(ws, lambda a: F.transform(F.filter(ws, lambda b: a < b), lambda b: F.concat_ws(" ", a, b))))


def matched_titles(queries: DataFrame, titles: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, title, score, rank): the works that messages name, best first. For each title the first of these counts:

    1. one of title and message holds the other: 100 and the title's length;
    2. the title has every word of a name of several capitalised words: 60, its length and 10 for each word of the first such name;
    3. it has capitalised words that stand alone and that less than 3 % of all titles have: 40, its length and 5 for each;
    4. the message is about a work, and the title shares two words with it (60 and its length), or one of at least five letters (40 and its length).

    Titles of fewer than three characters name nothing, nor do empty messages. Containment comes from an automaton, the others from joins on words. In class 4 common words matter: where a
    message has no rare name, a title that isn't among the `limit` longest ones with its word, or with its two words, can't be among the first, as those share the same and score as
    much or more; so only these are met."""
    t = titles.select("title").distinct().select("title", norm_title(F.col("title")).alias("t")).where("length(t) >= 3")
    t = stored(t.select("title", "t", F.length("t").alias("size"), _own_words(F.col("t")).alias("own")), "titles")
    q = queries.where("text IS NOT NULL").select("query_id", norm_title(F.col("text")).alias("q"), proper_phrases(F.col("text")).alias("names"), intent.is_about_a_work(F.col("text")).alias("about"))
    several = lambda n: F.contains(n, F.lit(" "))
    q = stored(q.where("q <> ''").select("query_id", "q", F.filter("names", several).alias("long"), F.filter("names", lambda n: ~several(n)).alias("lone"), F.when(F.col("about"), _own_words(F.col("q"))).alias("asked")), "messages")

    held = containing(q.select("query_id", "q"), t.select("title", "t")).union(containing(t.select("title", "t"), q.select("query_id", "q")).select("query_id", "title")).distinct()
    one = held.join(t.select("title", "size"), "title").select("query_id", "title", F.lit(1).alias("class"), (100 + F.col("size")).alias("score"))

    word = t.select("title", "size", "own", F.explode("own").alias("word"))
    name = q.select("query_id", F.posexplode("long").alias("i", "name")).select("query_id", "i", F.split("name", " ").alias("ws"))
    name = name.withColumn("word", F.element_at(F.array_sort("ws", lambda a, b: F.length(b) - F.length(a)), 1))  # the longest is seldom common
    whole = name.join(word, "word").where(F.size(F.array_except("ws", "own")) == 0)
    two = whole.groupBy("query_id", "title").agg(F.min_by(F.col("size") + 60 + 10 * F.size("ws"), "i").alias("score")).select("query_id", "title", F.lit(2).alias("class"), "score")

    rare = distinctive(t.select("title")).where("rare").select("word")
    lone = q.select("query_id", F.explode(F.array_distinct("lone")).alias("word")).join(rare, "word", "left_semi")
    three = lone.join(word, "word").groupBy("query_id", "title").agg((F.max("size") + 40 + 5 * F.count("*")).alias("score")).select("query_id", "title", F.lit(3).alias("class"), "score")

    # a message's words of which no title has one make no pairs
    own = q.select("query_id", F.explode("asked").alias("word")).join(word.select("word").distinct(), "word", "left_semi").groupBy("query_id").agg(F.collect_set("word").alias("asked"))
    own = own.join(lone.select("query_id", F.lit(True).alias("named")).distinct(), "query_id", "left")
    longest = Window.partitionBy("key").orderBy(F.desc("size"), "title")
    keys = F.concat(F.filter("own", lambda w: F.length(w) >= ONE_WORD), _word_pairs(F.col("own")))
    by_key = t.select("title", "size", "own", F.explode(keys).alias("key")).withColumn("i", F.row_number().over(longest))
    some = own.select("query_id", "named", "asked", F.explode(F.concat("asked", _word_pairs(F.col("asked")))).alias("key"))
    met = some.join(by_key, "key").where(F.col("named").isNotNull() | (F.col("i") <= limit)).withColumn("shared", F.array_intersect("own", "asked"))
    score = F.when(F.size("shared") >= 2, 60 + F.col("size")).when(F.length(F.element_at("shared", 1)) >= ONE_WORD, 40 + F.col("size"))
    four = met.select("query_id", "title", F.lit(4).alias("class"), score.alias("score")).where("score IS NOT NULL")

    first = one.unionByName(two).unionByName(three).unionByName(four).groupBy("query_id", "title").agg(F.min_by("score", "class").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "title")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "title", F.col("score").cast("int").alias("score"), "rank")


# Capitalised words that start questions and name nothing.
NOT_PROPER = TERM_STOP + "describe explain summarize summary synopsis recap overview compare review whom whose do does did may might have has had tell give list name find show write question book books novel novels series".split()


def proper_phrases(query: Column) -> Column:
    """Runs of capitalised words that may be names, in lower case and without a possessive ending."""
    raw = F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z\-']*"), F.lit(0))
    empty = F.array().cast("array<string>")

    def step(a, t):
        base = F.regexp_replace(F.lower(t), "'s$", "")
        name = t.rlike("^[A-Z]") & ~base.isin(*NOT_PROPER) & (F.length(base) >= 2)
        closed = F.when(F.size(a["cur"]) > 0, F.concat(a["phrases"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["phrases"])
        return F.when(name, F.struct(a["phrases"].alias("phrases"), F.concat(a["cur"], F.array(base)).alias("cur"))).otherwise(F.struct(closed.alias("phrases"), empty.alias("cur")))

    start = F.struct(empty.alias("phrases"), empty.alias("cur"))
    return F.aggregate(raw, start, step, lambda a: F.array_distinct(F.when(F.size(a["cur"]) > 0, F.concat(a["phrases"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["phrases"])))


# Words that tell nothing of a library's contents.
GENERIC = "book books author authors about explain describe summarize summary meaning means difference compared comparison example examples character characters novel novels story stories main philosophy training method methods technique techniques write wrote ways way things thing best good great features feature".split()


def soft_words(query: Column) -> Column:
    """The other words of a message that may tell its subject, in order: at least three letters, no stop word, not generic, not a name."""
    base = F.transform(F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z\-']*"), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), "'s$", ""))
    names = proper_phrases(query)
    return F.array_distinct(F.filter(base, lambda w: (F.length(w) >= 3) & ~w.isin(*TERM_STOP, *GENERIC) & ~F.array_contains(names, w)))


def low_relevance(query: Column, pool_stems: Column, top_distance: Column, stems, common: Column, threshold: float = 0.8) -> Column:
    """Why a pool of hits looks off target, or null. In this order: no hits; a phrase of names that the pool lacks; a first hit below
    the threshold; a single rare name that the pool lacks. `stems` maps a text column to its stems."""
    phrases = F.filter(proper_phrases(query), lambda p: F.contains(p, F.lit(" ")))
    missing = F.filter(phrases, lambda p: F.size(F.array_except(stems(p), pool_stems)) > 0)
    single = F.filter(proper_phrases(query), lambda p: ~F.contains(p, F.lit(" ")) & (F.length(p) >= 3) & ~p.isin(*GENERIC) & (F.size(F.array_intersect(stems(p), pool_stems)) == 0) & ~F.array_contains(common, p))
    return (
        F.when(pool_stems.isNull(), "no matching documents retrieved")
        .when(F.size(missing) > 0, F.concat(F.lit("proper terms not found in retrieved sources: "), F.element_at(missing, 1)))
        .when(1 - top_distance < threshold, F.format_string(f"top hit score %.3f below threshold {threshold}", 1 - top_distance))
        .when(F.size(single) > 0, F.concat(F.lit("proper terms not found in retrieved sources: "), F.array_join(F.slice(single, 1, 3), ", ")))
    )


def context(hits: DataFrame, most_words: int = 330, per: str = "query_id") -> DataFrame:
    """One numbered context string for each query."""
    ws = words(F.col("document"))
    body = F.when(F.size(ws) > most_words, F.concat(F.array_join(F.slice(ws, 1, most_words), " "), F.lit(" …[truncated]"))).otherwise(F.array_join(ws, " "))
    part = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), body).alias("text"))
    return hits.groupBy(per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("context"))
