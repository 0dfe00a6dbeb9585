"""Columns named like those that an operator adds are replaced, in any case of letters; all others pass through."""

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, html_text, language, licences, mixing, suffix_dedup, tokens
from corpuscle.llm.common import packed, unpacked

ROWS = [(1, "one two three four", "en", "a", "kept"), (2, None, "en", None, None), (2, "one two three four", "en", "a", "kept")]


def _docs(spark, *names):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, other string")
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


@pytest.mark.parametrize(
    "name,run",
    [
        ("lic_FOUND", lambda spark, df: licences.scan(df, licences.Model([]))),
        ("REP_spans", lambda spark, df: suffix_dedup.remove_repeats(df)),
        ("Lid_lang", lambda spark, df: language.identify(df, language.train(df))),
        ("con_ITEMS", lambda spark, df: decontaminate.find_contamination(df, spark.createDataFrame([("i", "two three")], "item_id string, text string"))),
        ("tok_Count", lambda spark, df: tokens.count_tokens(df)),
        ("Main_text", lambda spark, df: html_text.extract_text(df.withColumnRenamed("text", "html"))),
    ],
)
def test_added_columns_replace(spark, name, run):
    out = run(spark, _docs(spark, name))
    same = [c for c in out.columns if c.lower() == name.lower()]
    assert same == [name.lower()]
    rows = out.collect()
    assert len(rows) == 3 and all(r[name.lower()] != "mine" for r in rows)
    assert sorted(str(r.other) for r in rows) == ["None", "kept", "kept"]


def test_mixing_keeps_all_columns(spark):
    df = _docs(spark, "copies", "rate", "target", "draw", "c", "doc", "of_source")
    out = mixing.mix(df)
    assert out.columns == df.columns and all(r.copies == "mine" for r in out.collect())


def test_packing_is_undone(spark):
    df = _docs(spark, "other_columns", "none")
    out = unpacked(packed(df, "doc_id", "text"), df.columns, {"doc_id": F.col("doc_id"), "text": F.col("text")})
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    one = df.select("doc_id")
    assert unpacked(packed(one, "doc_id"), ["doc_id"], {"doc_id": F.col("doc_id")}).count() == 3
