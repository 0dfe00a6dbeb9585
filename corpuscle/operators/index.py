"""Posting lists, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, tf). The counts are combined before the shuffle."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """One posting for each document and token, so a plain count is the number of documents."""
    return postings.groupBy("token").agg(F.count("*").alias("doc_freq"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts without a shuffle; documents without tokens are left out, as they are no part of the corpus for scoring."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("len")).where("len > 0")


class Statistics:
    """What scoring needs to know of a corpus, counted in one pass over the texts and kept as a small table: documents (those with tokens), their mean
    length, and for each token its documents. Any number of batches of queries can use one."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        ts = tokens(F.col(text))
        # the empty token stands for the document itself and brings its length along
        each = docs.select(ts.alias("ts")).where(F.size("ts") > 0).select(F.size("ts").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("ts"))).alias("token"))
        counted = each.groupBy("token").agg(F.count("*").alias("doc_freq"), F.sum(F.when(F.col("token") == "", F.col("len"))).alias("len"))
        self._take(stored(counted, "token-statistics"))

    @classmethod
    def of_counts(cls, counted: DataFrame) -> Statistics:
        """From counts (token, doc_freq, len) that are there already; the row of the empty token counts documents and their length."""
        out = cls.__new__(cls)
        out._take(counted)
        return out

    def _take(self, counted: DataFrame) -> None:
        self.counted = counted
        n, size = self.counted.where("token = ''").agg(F.sum("doc_freq"), F.sum("len")).first()
        self.docs, self.average = n or 0, (size or 0) / n if n else 0.0

    @property
    def frequencies(self) -> DataFrame:
        return self.counted.where("token <> ''").select("token", "doc_freq")

    def idf(self) -> DataFrame:
        """Inverse document frequencies; negative ones become a share of the mean over all terms."""
        raw = self.frequencies.withColumn("raw", F.log(F.lit(float(self.docs)) - F.col("doc_freq") + 0.5) - F.log(F.col("doc_freq") + 0.5))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        return raw.select("token", "doc_freq", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(key, token, times): a token that a query repeats counts as often."""
    return queries.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("times"))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", statistics: Statistics | None = None) -> DataFrame:
    """(query_id, key, score) for every document that shares a token with a query.

    Only tokens of queries are kept right after tokenising (the semi-join is a broadcast when the queries are small), so postings of
    other tokens never reach a shuffle; a document's tokens are counted in place."""
    statistics = statistics or Statistics(docs, text)
    asked = weighted_terms(queries, statistics)
    needed = asked.select("token").distinct()
    ts = docs.select(key, tokens(F.col(text)).alias("ts")).select(key, F.size("ts").cast("long").alias("len"), F.explode("ts").alias("token"))
    some = ts.join(needed, "token", "left_semi").groupBy(key, "len", "token").agg(F.count("*").alias("tf"))
    return scored_postings(some, asked, statistics.average, key)


def weighted_terms(queries: DataFrame, statistics: Statistics) -> DataFrame:
    """(query_id, token, weight) of the queries' tokens that the corpus has, as a small table."""
    asked = query_terms(queries).join(statistics.idf(), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
    return stored(asked, "asked-tokens")


def scored_postings(postings: DataFrame, asked: DataFrame, average: float, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score) from postings (token, key, tf, len) and weighted terms."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(max(average, 1e-9)))
    scored = postings.select(key, "token", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))
    return scored.join(asked, "token").groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "doc_id", per: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1; equal scores go by key. Spark limits each group before the shuffle."""
    w = Window.partitionBy(per).orderBy(F.desc(F.round("score", 6)), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def zero_filled(scores: DataFrame, docs: DataFrame, queries: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n best of all documents, those of score 0 included, in order of key. A query with fewer than n scored documents finds the
    rest among the first 2n documents, so no pair of a query and every document is made."""
    best = stored(top_k(scores, n, key).select("query_id", key, "score"), "scored")
    first = [r[0] for r in docs.select(key).orderBy(key).limit(2 * n).collect()]
    few = queries.select("query_id").join(best.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < n).select("query_id")
    zeros = few.select("query_id", F.explode(F.lit(first)).alias(key)).join(best.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(zeros), n, key)


def common_terms(frequencies: DataFrame, n_docs: int, share: float = 0.01) -> DataFrame:
    return frequencies.where(F.col("doc_freq") / n_docs >= share)
