"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. For patterns of m words a shift table over blocks of two words says how far the
window may move; where the shift is 0, the block's bucket selects the patterns that end their first m words in it, and a
direct comparison of the bytes confirms. Each document run is cut into lanes that advance together, so the scan is a few
array operations for each step. Nothing is shuffled.

The benchmark is read in blocks of at most BLOCK_BYTES of text; each block is one pass over the documents in the same
stage, so a larger benchmark means more passes and not a larger broadcast.

Defined cases: null or wordless documents have no words and are not contaminated; null or wordless items give no window;
an item of fewer words than a window is one window; repeated item_ids count once; a null item_id reads "null"; repeated
documents are judged alike; empty tables are allowed; further columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, class_table, covered, frugal, mix, pieces, prefix_hash, read, runs, span_hash, utf8, without

WINDOW, BLOCK_BYTES = 10, 16 << 20
#: Words a lane advances over.
LANE = 256
IS_WORD = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start and end of each word."""
    low = LOWER[buf]
    start, end = runs(IS_WORD[low], off)
    return low, start, end


class Group:
    """Wu-Manber tables for patterns that all have m words."""

    def __init__(self, m: int, patterns: dict[bytes, tuple[int, ...]]):
        self.m, self.block = m, min(2, m)
        self.texts = list(patterns)
        self.items = [patterns[t] for t in self.texts]
        joined = np.frombuffer(b"".join(self.texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        start, end = runs(joined != 0x20, off)
        h = span_hash(prefix_hash(joined), start, end).reshape(-1, m)
        blocks = self._of(h[:, :-1], h[:, 1:]) if self.block == 2 else h
        self.bits = np.uint64(64 - max(12, int(blocks.size * 8).bit_length()))
        self.most = m - self.block + 1
        self.shift = np.full(1 << int(np.uint64(64) - self.bits), self.most, np.int16)
        for j in range(blocks.shape[1]):  # later blocks allow smaller shifts
            np.minimum.at(self.shift, (blocks[:, j] >> self.bits).astype(np.int64), m - self.block - j)
        # buckets: patterns sorted by their last block, then by all their words
        last, whole = blocks[:, -1], self._whole(h)
        order = np.lexsort((whole, last))
        self.last, self.whole, self.number = last[order], whole[order], order

    @staticmethod
    def _of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _PAIR + b)

    @staticmethod
    def _whole(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for j in range(h.shape[1]):
            out = mix(out * _PAIR + h[:, j])
        return out

    def search(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of each occurrence."""
        n, m = len(h), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            block = self._of(h[at - 1], h[at]) if self.block == 2 else h[at]
            step = self.shift[(block >> self.bits).astype(np.int64)]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        at = at[row[at] == row[at - m + 1]]
        block = self._of(h[at - 1], h[at]) if self.block == 2 else h[at]
        lo, hi = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        keep = hi > lo
        at, lo, hi = at[keep], lo[keep], hi[keep]
        # within the bucket patterns are sorted by the hash of all words
        words = self._whole(h[at[:, None] - np.arange(m - 1, -1, -1)]) if len(at) else np.zeros(0, np.uint64)
        first, numbers = [], []
        for p, a, b, w in zip(at.tolist(), lo.tolist(), hi.tolist(), words):
            k = a + int(np.searchsorted(self.whole[a:b], w))
            while k < b and self.whole[k] == w:
                i = p - m + 1
                text = b" ".join(low[start[j] : end[j]].tobytes() for j in range(i, p + 1))
                if text == self.texts[self.number[k]]:
                    first.append(i)
                    numbers.append(int(self.number[k]))
                k += 1
        return np.array(first, np.int64), np.array(numbers, np.int64)


def compiled(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[str], list[Group]]:
    """Item names and the groups of patterns by length."""
    names, by_length = [], {}
    for name, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        low, start, end = word_spans(raw, np.array([0, len(raw)], np.int64))
        words = [low[a:b].tobytes() for a, b in zip(start, end)]
        if not words:
            continue
        names.append(name)
        m = min(window, len(words))
        for i in range(len(words) - m + 1):
            by_length.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), set()).add(len(names) - 1)
    return names, [Group(m, {t: tuple(s) for t, s in ps.items()}) for m, ps in sorted(by_length.items())]


def scan(names: list[str], groups: list[Group], col: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """For each row: number of words, spans of hit words (first, end), and the items found."""
    buf, off = utf8(col)
    n = len(off) - 1
    counts, spans, items = np.zeros(n, np.int64), [np.zeros((0, 2), np.int64)] * n, [set() for _ in range(n)]
    for i, j in pieces(off):
        low, start, end = word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        first_word = np.searchsorted(start, off[i : j + 1] - off[i])
        counts[i:j] = np.diff(first_word)
        row = np.repeat(np.arange(i, j), np.diff(first_word))
        h = span_hash(prefix_hash(low), start, end)
        for g in groups:
            at, number = g.search(low, start, end, row, h)
            for r in np.unique(row[at]).tolist():
                here = row[at] == r
                begin = at[here] - first_word[r - i]
                spans[r] = np.concatenate([spans[r], np.stack([begin, begin + g.m], 1)])
                items[r].update(names[k] for p in set(number[here].tolist()) for k in g.items[p])
    return counts, spans, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with con_words, con_spans array<struct<first, end>> (words), con_items (sorted item_ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ["con_words", "con_spans", "con_items"]
    docs = without(docs, *added)
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("name"), benchmark["text"].alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("con_words", T.LongType()), T.StructField("con_spans", span), T.StructField("con_items", T.ArrayType(T.StringType()))])
    span_kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    out, own = docs, list(docs.columns)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        # bounded: a block has about block_bytes of text
        tables = spark.sparkContext.broadcast(compiled([(r.name, r.text) for r in mine.collect()], window))

        def run(batches, tables=tables, again=k > 0):
            names, groups = tables.value
            for b in batches:
                counts, spans, found = scan(names, groups, b.column("text"))
                if again:
                    spans = [np.concatenate([s, np.array([(x["first"], x["end"]) for x in old], np.int64).reshape(-1, 2)]) for s, old in zip(spans, b.column("con_spans").to_pylist())]
                    found = [f | set(old) for f, old in zip(found, b.column("con_items").to_pylist())]
                cols = [pa.array(counts), pa.array([[{"first": x, "end": y} for x, y in s.tolist()] for s in spans], span_kind), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *cols], names=[*own, *added])

        out = out.mapInArrow(frugal(run), schema)
    return out


def hit_words(spans) -> int:
    """Words inside any span."""
    if not spans:
        return 0
    a = np.array([(s["first"], s["end"]) for s in spans], np.int64)
    return int(covered(a[:, 0], a[:, 1], int(a[:, 1].max())).sum())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    words = F.flatten(F.transform("con_spans", lambda s: F.sequence(s["first"], s["end"] - 1)))
    return out.select(
        "doc_id",
        F.col("con_words").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_hit"),
        F.size("con_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("con_items", ","), 256).alias("items_sha256"),
        (F.size("con_spans") > 0).alias("contaminated"),
    )


def contamination_sql(docs: str = "documents", window: int = WINDOW) -> str:
    """CTEs up to `judged`: doc_id, n_words, n_hit, n_items, item_names."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    take = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
item_words AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {take.format(low.format('text'))} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, least({window}, len(w)) AS m, array_to_string(list_slice(w, i, i + least({window}, len(w)) - 1), ' ') AS s
  FROM item_words, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS t(i) WHERE len(w) > 0),
doc_words AS (SELECT row_number() OVER () AS k, doc_id, coalesce({take.format(low.format('text'))}, []) AS w FROM {docs}),
doc_windows AS (SELECT k, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM doc_words, (SELECT DISTINCT m FROM item_windows), unnest(range(1, len(w) - m + 2)) AS t(i)),
occurs AS (SELECT d.k, d.i, d.m, b.item_id FROM doc_windows d JOIN item_windows b ON d.m = b.m AND d.s = b.s),
hit_counts AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM occurs) GROUP BY k),
item_lists AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS item_names FROM occurs GROUP BY k),
judged AS (SELECT d.k, d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_names, '') AS item_names
  FROM doc_words d LEFT JOIN hit_counts USING (k) LEFT JOIN item_lists USING (k))"""


SQL = {"op10_decontaminate": f"WITH {contamination_sql()} SELECT doc_id, n_words, n_hit, n_items, sha256(item_names) AS items_sha256, n_hit > 0 AS contaminated FROM judged"}
QUERIES = {"op10_decontaminate": op10_decontaminate}
