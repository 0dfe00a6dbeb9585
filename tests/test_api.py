import pytest
from pyspark.sql import functions as F

from corpuscle.api import Engine
from corpuscle.functions.stem import stem, stems

STEMS = {"consign": "consign", "consigned": "consign", "consigning": "consign", "consistency": "consist", "knightly": "knight", "knots": "knot", "generate": "generat", "generically": "generic", "skies": "sky", "dying": "die", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "national": "nation", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "agreed": "agre", "controlled": "control", "happy": "happi", "by": "by", "say": "say", "news": "news", "training": "train", "sensibility": "sensibl", "communication": "communic"}


@pytest.mark.parametrize("word,want", STEMS.items())
def test_stems(word, want):
    assert stem(word) == want


def test_stem_column(spark):
    got = spark.createDataFrame([("Hoping, hopes!",), (None,), ("",)], "t string").select(stems(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [["hope", "hope"], None, []]


def test_engine(spark):
    rows = [(k, f"Chapter {c} Part\nalpha beta {w} gamma\n", f"Book {k % 2}", f"b{k % 2}.txt", "fiction" if k % 2 else "nonfiction", ["x"]) for k, (c, w) in enumerate([(1, "whale"), (2, "ring"), (3, "whale ship"), (4, "storm")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string, kind string, tags array<string>")
    vectors = spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "vec_id long, embedding array<float>")
    e = Engine(spark, docs, vectors)
    q = e.queries("whale", "storm ring")
    hits = e.search(q, top=3).collect()
    assert {(h.query_id, h.doc_id) for h in hits} == {(0, 0), (0, 2), (1, 1), (1, 3)}
    asks = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    fused = e.search(e.queries("whale"), asks, top=4).orderBy("place").collect()
    assert fused[0].doc_id == 1 and len(fused) == 4
    assert {h.doc_id for h in e.search(q, kind="fiction").collect()} == {1, 3}
    assert e.find_works(e.queries("b1 txt")).where("rank = 1").first().title == "Book 1"
    assert e.works().count() == 2 and e.section_texts().count() == 4
    assert e.plan(3).select("allocation").distinct().first()[0] == 3
    assert e.context(e.search(q)).count() == 2
    assert e.matched_titles(e.queries("read book 0 now")).first().title == "Book 0"


def test_whole_plans(spark):
    docs = spark.createDataFrame([(k, f"{t} and the sea, {w} and {w} again. Part {k}", t, f"{t}.txt", "fiction", [w]) for k, (t, w) in enumerate([("Moby Dick", "whales"), ("Moby Dick", "ships"), ("Red Ring", "rings"), ("Law", "courts")])], "doc_id long, text string, title string, source string, kind string, tags array<string>")
    e = Engine(spark, docs)
    got = e.answer(e.queries("whales in moby dick", "courts")).collect()
    assert {(r.query_id, r.title) for r in got} == {(0, "Moby Dick"), (1, "Law")}
    assert {r.query_id: r.warning for r in e.warnings(e.queries("courts", "Captain Zorro of the courts")).collect()} == {0: None, 1: "proper terms not found in retrieved sources: captain zorro"}
    told = e.intents(e.queries("list books about whales", "quiz me with 5 on law")).orderBy("query_id").collect()
    assert (told[0].listing, told[0].topic, told[1].quiz, told[1]["count"]) == (True, "whales", True, 5)
    assert [r.title for r in e.catalogue(e.queries("list books about whales")).collect()] == ["Moby Dick"]
    golden = spark.createDataFrame([(0, "whales", "retrieval", "The Moby Dick", None), (1, "rings", "topic", None, ["Red Ring"]), (2, "courts", "retrieval", "Red Ring", None)], "query_id long, query string, mode string, expected_title string, expected_works array<string>")
    assert {r.query_id: r.hit for r in e.evaluate_golden(golden).collect()} == {0: 1, 1: 1, 2: 0}
    assert "stemmed" in e.register_sql()
