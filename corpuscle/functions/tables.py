"""Table functions for users of SQL, so that chunking, packing and ranking are calls in a query.

    SELECT doc_id, c.* FROM documents, LATERAL corpus_chunks(text, 500, 100) c
    SELECT * FROM corpus_top(TABLE(scores) PARTITION BY (query_id) ORDER BY (score DESC, doc_id), 10)
    SELECT * FROM corpus_budget(TABLE(hits) PARTITION BY (query_id) ORDER BY (rank), 'n_words', 1500, 1)

Those over tables add columns to whatever columns their table has, so their schema comes from the call. They stream: a partition's rows come in order, and what is held of them is a number or two. A hot
partition is one task's work but not its memory. Null texts have no chunks; a null size counts as 0.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _extended(table: AnalyzeArgument, name: str) -> AnalyzeResult:
    if not isinstance(table.dataType, T.StructType) or not table.isTable:
        raise ValueError("the first argument is a TABLE with PARTITION BY and ORDER BY")
    if name in table.dataType.names:
        raise ValueError(f"the table has a column {name}, which this function adds")
    return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField(name, T.LongType())]))


def _number(argument: AnalyzeArgument, name: str, least: int) -> None:
    if argument.isTable or argument.value is None or argument.value < least:
        raise ValueError(f"{name} is a constant of at least {least}")


class Chunks:
    """Windows of `size` words that overlap by `overlap`: (chunk_index, total_chunks, n_words, document)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _number(size, "size", 1)
        _number(overlap, "overlap", 0)
        long, string = T.LongType(), T.StringType()
        return AnalyzeResult(T.StructType([T.StructField("chunk_index", long), T.StructField("total_chunks", long), T.StructField("n_words", long), T.StructField("document", string)]))

    def eval(self, text: str, size: int, overlap: int):
        words = _WORD.findall(text or "")
        starts = range(0, len(words), max(1, size - overlap))
        for k, s in enumerate(starts):
            part = words[s : s + size]
            yield k, len(starts), len(part), " ".join(part)


class Top:
    """The first k rows of each partition, with their rank."""

    def __init__(self):
        self.rank = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        _number(k, "k", 0)
        return _extended(table, "rank")

    def eval(self, row: T.Row, k: int):
        self.rank += 1
        if self.rank <= k:
            yield *row, self.rank


class Budget:
    """The longest run of first rows whose sizes stay within a budget, and the first `least` in any case, with what is used so far."""

    def __init__(self):
        self.used = self.rows = 0
        self.over = False

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, budget: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        _number(budget, "budget", 0)
        _number(least, "least", 0)
        if size.value not in getattr(table.dataType, "names", ()):
            raise ValueError("size names a column of the table")
        return _extended(table, "used")

    def eval(self, row: T.Row, size: str, budget: int, least: int):
        self.used += row[size] or 0
        self.rows += 1
        self.over = self.over or self.used > budget
        if not self.over or self.rows <= least:
            yield *row, self.used


FUNCTIONS = {"corpus_chunks": Chunks, "corpus_top": Top, "corpus_budget": Budget}


def register_tables(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session's SQL and gives their names."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
    return list(FUNCTIONS)
