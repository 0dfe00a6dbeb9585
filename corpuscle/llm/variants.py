"""Spelling variants: words one edit apart, by a rare-first filter over positional bigrams.

Words are counted by a plain aggregate. Each word's bigrams with their places are ordered by how many words hold the bigram, then by bigram, then by place; its first three
are its signature. One inserted, deleted or replaced code point destroys at most two of a word's bigrams, and what is left stands in both words in the same
order, moved by one place at most. So the first bigram that survives is among the first three of both, and words one edit apart meet at one bigram,
place and length. What meets is compared by the parity of its letters and then exactly.

A list of words at one bigram, place and length that is long is split: one edit leaves the first half of the shorter word or the rest of it as it is, so the words of such a list meet
only where they share that half as well. No list is cut, and pairs don't grow with the square of common bigrams' lists.

A word's form is its most frequent near word, if that occurs at least twice as often; forms are followed by doubling, at most six rounds, since counts double at each step.

Defined cases: null texts have no words; null ids count as the text "null" in noise; rows with one id are separate occurrences; without words the result is empty; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, frugal, read, stored

#: Runs of letters, and the ones whose case is folded.
LETTERS, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the shortest word; four hold the three bigrams of which one survives an edit.
SHORTEST, LEAST = 5, 3
#: Bigrams that each word joins on.
RAREST = 3
#: Pairs at one bigram, place and length beyond which its list is split by halves.
LONG_LIST = 1 << 12
#: A form occurs at least so many times as often.
FACTOR = 2
#: Distinct bigrams up to which their counts are broadcast (12 bytes each); the given letters make fewer than 90 squared.
MOST_BIGRAMS = 1 << 18


def words_of(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """(word): each occurrence of a run of letters, A-Z in lower case. With `noise`, runs whose crc32 with the doc_id is divisible by it lose one code point."""
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    low = F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    run = run.select("doc_id", low.alias("word"))
    if noise is None:
        return run.select("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("word")))
    run = run.select("word", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("word").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return run.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))


def counted_words(docs: DataFrame, noise: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times."""
    return words_of(docs, noise).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bigram_counts(words: DataFrame) -> DataFrame:
    """(bigram, words): the bigrams of distinct words, each once for a word. A task sends each of its bigrams once for as many as it holds."""

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            for w in b.column("word").to_pylist():
                found.update({w[i : i + 2] for i in range(len(w) - 1)})
            if len(found) > MOST_BIGRAMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["bigram", "words"])
                found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["bigram", "words"])

    return words.select("word").mapInArrow(run, "bigram string, words long").groupBy("bigram").agg(F.sum("words").alias("words"))


def signatures(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, parity, grams): the RAREST bigrams of each word with their places, and which letters it holds an odd number of times."""
    few = counts.limit(MOST_BIGRAMS + 1).count() <= MOST_BIGRAMS
    if not few:
        return _joined_signatures(words, counts)
    shared = words.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in counts.collect()})  # at most MOST_BIGRAMS

    def run(batches):
        often = shared.value
        for b in batches:
            ws = b.column("word").to_pylist()
            grams = [[{"bigram": g, "place": i} for _, g, i in heapq.nsmallest(RAREST, ((often[w[i : i + 2]], w[i : i + 2], i) for i in range(len(w) - 1)))] for w in ws]
            kind = pa.list_(pa.struct([("bigram", pa.string()), ("place", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ws), b.column("n"), pa.array([_parity(w) for w in ws], pa.int64()), pa.array(grams, kind)], names=["word", "n", "parity", "grams"])

    return words.mapInArrow(frugal(run), "word string, n long, parity long, grams array<struct<bigram: string, place: int>>")


def _parity(w: str) -> int:
    out = 0
    for c in w:
        out ^= 1 << (ord(c) % 63)
    return out


def _joined_signatures(words: DataFrame, counts: DataFrame) -> DataFrame:
    """The same for any number of bigrams: counts come by a join, and a word's best are kept by partial aggregates."""
    places = F.sequence(F.lit(0), F.length("word") - 2)
    each = words.select("word", F.explode(F.transform(places, lambda i: F.struct(F.substring(F.col("word"), i + 1, F.lit(2)).alias("bigram"), i.alias("place")))).alias("g")).select("word", "g.*")
    from pyspark.sql import Window

    w = Window.partitionBy("word").orderBy("words", "bigram", "place")
    best = each.join(counts, "bigram").withColumn("i", F.row_number().over(w)).where(F.col("i") <= RAREST).groupBy("word").agg(F.collect_list(F.struct("bigram", "place")).alias("grams"))
    bit = F.expr("aggregate(split(word, ''), 0L, (a, c) -> IF(c = '', a, a ^ shiftleft(1L, ascii(c) % 63)))")  # ascii() is the code point
    return words.join(best, "word").select("word", "n", bit.alias("parity"), "grams")


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once. words: distinct (word, n) of at least four code points."""
    counts = stored(bigram_counts(words), "bigrams")
    own = signatures(words, counts).select("word", "n", "parity", F.length("word").alias("size"), F.explode("grams").alias("g")).select("word", "n", "parity", "size", "g.bigram", "g.place")
    # a pair meets at the place and length that the shorter word has; an insertion before the bigram moves it in the longer one
    roles = F.array(*[F.struct(F.lit(longer).alias("longer"), (F.col("place") - back).alias("at"), (F.col("size") - longer).alias("len")) for longer, back in ((0, 0), (1, 0), (1, 1))])
    met = own.select("word", "n", "parity", "bigram", F.explode(roles).alias("r")).select("word", "n", "parity", "bigram", "r.*").where(F.col("len") >= 4)
    met = stored(met, "met-words")
    spot = ["bigram", "at", "len"]
    lists = met.groupBy(*spot).agg(F.count(F.when(F.col("longer") == 0, 1)).alias("own"), F.count("*").alias("all"))
    long = lists.where(F.col("own") * F.col("all") > LONG_LIST).select(*spot, F.lit(True).alias("long"))
    half = F.floor(F.col("len") / 2).cast("int")
    first, rest = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), -(F.col("len") - half), F.col("len"))
    parts = F.when(F.col("long"), F.array(F.concat(F.lit("<"), first), F.concat(F.lit(">"), rest))).otherwise(F.array(F.lit("")))
    rows = met.join(long, spot, "left").select("word", "n", "parity", "longer", F.explode(parts).alias("part"), *spot)
    rows = rows.select("word", "n", "parity", "longer", F.xxhash64(*spot, "part").alias("k"))
    a = rows.where("longer = 0").select("k", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p"))
    b = rows.select("k", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("q"), "longer")
    pair = a.join(b, (a["k"] == b["k"]) & ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 2) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1))
    out = stored(pair.select("a", "n_a", "b", "n_b").distinct(), "near-words")
    discard(counts, met)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where following the forms ends. Each round doubles the steps, so a chain of m steps takes log2(m) rounds."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = new.select("word", "root")
        at._work_path = new._work_path
        if not new.where("moved").head(1):
            return at


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n)."""
    words = stored(words.select("word", "n"), "words")
    pairs = near_words(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_other")))
    each = pairs.select(F.explode(sides).alias("x")).select("x.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "near")).alias("best"))
    big = -F.col("best")["less"] >= factor * F.col("n")
    near = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, F.col("best")["near"]).alias("form"), F.when(big, -F.col("best")["less"]).alias("form_n")), "forms")
    ends = roots(near.where("form IS NOT NULL"))
    out = near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    discard(words, pairs)
    out._work_path = [near._work_path, ends._work_path]
    return out


def variants(docs: DataFrame, noise: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """The words of docs (doc_id, text) with their forms and roots."""
    if shortest < 4:
        raise ValueError("words need four code points, so that one of three bigrams survives an edit")
    bounded_batches(docs.sparkSession)
    return spelling_forms(counted_words(docs, noise, shortest, least))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"), noise=97).select("word", "form", "root", "n", "n_near", "form_n")


SQL: dict[str, str] = {}
QUERIES = {"op12_variants": op12_variants}
