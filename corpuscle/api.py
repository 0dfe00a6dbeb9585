"""One object with what a user asks of a library: search, sections, the catalogue, quizzes, reviews. Every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intent, sql
from .functions import text as X
from .operators import answering, best, chunks, evaluation, index, library, rank, review, scopes, study, talk


class Engine:
    """docs: doc_id, text, title, source, kind, tags. vectors (optional): vec_id (a doc_id), embedding."""

    def __init__(self, spark: SparkSession, docs: DataFrame, vectors: DataFrame | None = None):
        self.spark, self.docs, self.vectors = spark, docs, vectors
        self._statistics: index.Statistics | None = None

    @property
    def statistics(self) -> index.Statistics:
        """Counted once, at the first question that needs them."""
        if self._statistics is None:
            self._statistics = index.Statistics(self.docs)
        return self._statistics

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")

    def search(self, queries: DataFrame, vectors: DataFrame | None = None, top: int = 8, kind: str | None = None, titles: list[str] | None = None, budget: int = 3000) -> DataFrame:
        """Grounded hits for a batch of queries: lexical and, with query vectors, dense legs, fused, diversified, within a word budget."""
        docs = self.docs
        if kind:
            docs = docs.where(F.col("kind") == kind)
        if titles:
            docs = docs.where(F.col("title").isin(*titles))
        leg = best.bm25_top(docs, queries, 3 * top, statistics=None if kind or titles else self.statistics)
        if vectors is not None and self.vectors is not None:
            own = self.vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
            dense = rank.cosine_knn(own, vectors, 3 * top).withColumnRenamed("vec_id", "doc_id")
            leg = rank.hybrid(dense, leg, "doc_id")
        hits = leg.join(docs.select("doc_id", "title", F.col("text").alias("document")), "doc_id")
        return rank.within_budget(rank.diversified(hits, limit=top), budget)

    def answer(self, queries: DataFrame, vectors: DataFrame | None = None, parents: DataFrame | None = None, top: int = 8, budget: int = 3000) -> DataFrame:
        """What answers are built on: works that queries name, fused legs, reranking, parents, thinning out, budget."""
        dense = None
        if vectors is not None and self.vectors is not None:
            dense = rank.cosine_knn(self.vectors, vectors, answering.POOL).withColumnRenamed("vec_id", "doc_id")
        return answering.grounded(queries, self.docs, parents, dense, self.statistics, top=top, budget=budget)

    def warnings(self, queries: DataFrame) -> DataFrame:
        """Why a query's pool looks off target, or null. Names that 1 % of the documents have may be missing from a pool."""
        common = index.common_terms(self.statistics.frequencies, max(self.statistics.docs, 1))
        about = [F.concat_ws(" ", c).alias(c) for c in ("source", "tags", "author") if c in self.docs.columns]
        hits = answering.pool(queries, self.docs, self.statistics).join(self.docs.select("doc_id", *about), "doc_id")
        return answering.guarded(queries, hits, common)

    def intents(self, messages: DataFrame) -> DataFrame:
        """What messages ask for: the catalogue, a quiz, a summary, one work; topic, kind, number of questions; a reply to a pending plan."""
        q = F.col("text")
        return messages.withColumns({"listing": intent.is_listing(q), "quiz": intent.is_quiz(q), "summary": intent.wants_summary(q), "work": intent.is_about_a_work(q), "topic": intent.topic(q), "kind": intent.kind(q), "count": intent.count(q, 10), "reply": intent.reply(q)})

    def catalogue(self, messages: DataFrame) -> DataFrame:
        return answering.catalogue_answers(messages, self.works())

    def summaries(self, hits: DataFrame, parents: DataFrame, summarise, n: int = 12) -> DataFrame:
        """Summaries over whole works by a summariser: sections spread evenly, in batches, then the batches' summaries."""
        return answering.summarised(answering.deep_sections(hits, parents, n), summarise)

    def units(self, topics: DataFrame, depth: str = "balanced", count: int = 10) -> DataFrame:
        """The sections that fit topics best, as many as a depth keeps."""
        sections = self.section_texts().select(F.col("parent_id").alias("unit"), "text")
        return scopes.top_units(answering.ranked_units(topics, sections), depth, count)

    def evaluate_golden(self, golden: DataFrame, k: int = 5) -> DataFrame:
        """Metrics of golden rows (query_id, query, mode, expected_title, expected_works) over this library."""
        asks = golden.select("query_id", F.col("query").alias("text"))
        hits = self.answer(asks, top=k).select("query_id", "title", F.col("place").alias("rank"))
        works = self.find_works(asks).select("query_id", "title", "rank")
        topic = golden.where("mode = 'topic'").select("query_id")
        return answering.evaluated(golden, hits.join(topic, "query_id", "left_anti").unionByName(works.join(topic, "query_id")), k)

    def register_sql(self) -> list[str]:
        """The scalar functions, for users of SQL."""
        return sql.register_functions(self.spark)

    def context(self, hits: DataFrame) -> DataFrame:
        return rank.context(hits)

    def matched_titles(self, queries: DataFrame) -> DataFrame:
        return rank.matched_titles(queries, self.docs.select("title").distinct())

    def works(self) -> DataFrame:
        return library.works(self.docs)

    def find_works(self, topics: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
        books = self.works() if kind is None else self.works().where(F.col("kind") == kind)
        scores = best.bm25_sums(self.docs, topics, statistics=self.statistics)
        return library.find_works([library.lexical_leg(topics, books), library.bm25_leg(scores)], books, limit)

    def sections(self) -> DataFrame:
        totals = self.docs.select("doc_id", F.length("text").cast("long").alias("total"))
        return chunks.normal_sections(chunks.detect_sections(self.docs), totals)

    def section_texts(self) -> DataFrame:
        return chunks.parents(self.docs, self.sections())

    def summary_parts(self, n: int = 12) -> DataFrame:
        """Sections spread evenly over each work, in batches of six, for a summariser outside."""
        spread = rank.even_spread(self.section_texts(), n, "ordinal", "doc_id")
        return spread.withColumn("batch", F.floor(F.col("pos") / 6))

    def plan(self, count: int, floor: int = 1) -> DataFrame:
        """Questions for each section of each work, by its words."""
        units = self.section_texts().select("doc_id", F.col("ordinal").alias("unit_no"), "section_title", X.word_count(F.col("text")).alias("words"), F.lit(1.0).alias("weight"))
        return study.allocation(units, count, floor, ["doc_id"])

    grade = staticmethod(study.graded)
    analytics = staticmethod(study.analytics)
    due = staticmethod(review.due_queue)
    review_stats = staticmethod(review.review_stats)
    schedule = staticmethod(review.scheduled)
    enrol = staticmethod(review.enrolled)
    withdraw = staticmethod(review.withdrawn)
    last_attempts = staticmethod(study.latest_attempts)
    newest = staticmethod(study.newest_first)
    revise = staticmethod(study.revised)
    history = staticmethod(talk.history)
    conversations = staticmethod(talk.summaries)
    evaluate = staticmethod(evaluation.query_metrics)
