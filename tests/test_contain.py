"""Containment by an automaton, and routing by titles."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import rank
from corpuscle.operators.contain import containing


@pytest.mark.parametrize("part_bytes", [40, 1 << 20])
def test_automaton_equals_substring_tests(spark, part_bytes):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abé ") for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (3, "again ab")]
    patterns = [(f"p{i}", "".join(r.choice("abé ") for _ in range(r.randint(1, 4)))) for i in range(40)] + [("none", None), ("empty", ""), ("same", "ab"), ("too", "ab"), ("wide", "日本")]
    got = sorted(map(tuple, containing(spark.createDataFrame(texts, "doc_id int, t string").repartition(3), spark.createDataFrame(patterns, "name string, p string"), part_bytes).collect()))
    assert got == sorted({(i, n) for i, t in texts for n, p in patterns if t and p and p in t}) and len(got) > 300
    none = spark.createDataFrame([], "name string, p string")
    assert containing(spark.createDataFrame(texts, "doc_id int, t string"), none).count() == 0


TITLES = ["The Black Swan", "Black Beauty", "Gulliver", "Gulliver Returns", "Of", "Law", "Red Ring of Power"] + [f"Common Volume {k} Black" for k in range(60)]


def test_classes_of_titles(spark):
    asks = {
        1: ("I read black beauty", [("Black Beauty", 112)]),
        2: ("Which nations does Gulliver visit?", [("Gulliver", 108)]),
        3: ("Where does Ring Power lead?", [("Red Ring of Power", 60 + 17 + 20)]),
        4: ("does Black sell", []),  # too many titles have the word
        5: ("ring power lawless", [("Law", 103)]),
        6: ("a summary with ring and power", [("Red Ring of Power", 77)]),
        7: ("with ring and power", []),
        8: ("we saw Returns there", [("Gulliver Returns", 40 + 16 + 5)]),
        9: ("gulliver ret", [("Gulliver Returns", 116), ("Gulliver", 108)]),
        10: ("", []),
        11: (None, []),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in asks.items()], "query_id long, text string")
    got = {}
    for r in rank.matched_titles(df, spark.createDataFrame([(t,) for t in TITLES], "title string")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.title, r.score))
    assert got == {i: want for i, (_, want) in asks.items() if want}


def test_soft_words(spark):
    row = spark.createDataFrame([("Does Bilbo Baggins find Anderson's golden ring, or the best story of rings?",)], "q string").select(rank.soft_words(F.col("q"))).first()
    assert row[0] == ["does", "bilbo", "baggins", "find", "golden", "ring", "rings"]
