"""The corpus pipeline: stages that each call one operator and hand documents on.

Each stage reads all that its predecessor kept and returns the columns of documents; the last one returns the mixed corpus, where a
document occurs as often as it is taken. Columns that an operator doesn't need travel in a struct, so none of their names clashes with one that it
adds. Empty tables give empty tables in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, language, mixing, ngram_join, suffix_dedup
from corpuscle.llm.common import discard, packed, read, stored, unpacked

#: Near duplicates: words to a shingle, and least similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Up to so many ids (8 bytes each) are broadcast, so that texts stay where they are; beyond that, the join shuffles.
MOST_BROADCAST = 1_000_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go. The models learn from the documents' own text and lang. Texts that are null, empty or
    without letters are of no language and go; without a single row of known lang all go. Rows with one text are judged alike, wherever they stand."""
    found = language.identify(packed(docs, "text"), language.train(docs))
    return unpacked(found.where("NOT lid_rejected"), docs.columns, {"text": F.col("text")})


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one of the smallest doc_id stays. Null, empty and wordless texts and rows without doc_id have
    no links and stay. Of rows with one doc_id, which are versions of one document, the one whose columns come first as JSON stays."""
    groups = ngram_join.linked(docs, SHINGLE, SIMILAR)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= MOST_BROADCAST
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    twice = groups.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("twice"))
    if twice.head(1):
        own = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
        marked = kept.select(own.alias("row")).join(twice, F.col("row.doc_id") == F.col("twice"), "left")
        first = marked.where("twice IS NOT NULL").groupBy("twice").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
        kept = marked.where("twice IS NULL").select("row").unionByName(first).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    kept._work_path = groups._work_path
    return kept


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text where something was cut. Null texts stay null, rows without
    doc_id count as last, and rows with one doc_id don't count as earlier than one another."""
    out = suffix_dedup.remove_repeats(packed(docs, "doc_id", "text"))
    chars = F.length("rep_text").cast(docs.schema["n_chars"].dataType)
    kept = unpacked(out, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("rep_text"), "n_chars": F.when(F.size("rep_spans") > 0, chars).otherwise(F.col("other_columns")["n_chars"])})
    kept._work_path = getattr(out, "_work_path", None)
    return kept


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none. Without any item all stay."""
    found = decontaminate.find_contamination(packed(docs, "text"), read(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("con_spans") == 0), docs.columns, {"text": F.col("text")})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is emitted as often as its source's target asks; a null source is a source, and rows with one doc_id are taken alike."""
    return mixing.mix(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", remove_repeated_passages),
    ("benchmarks", keep_clean_of_benchmarks),
    ("mix", mix_sources),
]

#: Language models and components over similarities are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        before, docs = docs, stored(made, name)
        discard(made, before)  # what the stage left, and the table that it read
    return docs
