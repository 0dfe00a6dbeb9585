from pyspark.sql import functions as F

from corpuscle.functions import intent as I
from corpuscle.operators import scopes


def test_intents(spark):
    asks = ["list books about training horses in my library", "What is the main argument of the book?", "show my novels", "quiz me with 15 on whales", "quiz me on 18th-century seafaring", "make 20 questions about non-fiction", "ok", "make it 7 questions and harder", "Is the quiz ready?", ""]
    df = spark.createDataFrame(list(enumerate(asks)), "i int, q string")
    q = F.col("q")
    got = df.select("i", I.is_listing(q).alias("l"), I.is_quiz(q).alias("z"), I.topic(q).alias("t"), I.kind(q).alias("k"), I.count(q, 10).alias("n"), I.reply(q).alias("r")).orderBy("i").collect()
    assert [g.l for g in got[:4]] == [True, False, True, False]
    assert [g.z for g in got[3:6]] == [True, True, False]
    assert got[0].t == "training horses" and got[2].t == ""
    assert [got[i].n for i in (3, 4, 5)] == [15, 10, 20] and got[5].k == "nonfiction"
    assert got[6].r.confirm and got[7].r["count"] == 7 and got[7].r.difficulty == "hard" and got[8].r is None and got[9].r is None
    lines = spark.createDataFrame([("1. first query\n- none\n\n* second one\nab\n3) third here\nfourth",)], "t string")
    assert lines.select(I.sub_queries(F.col("t"))).first()[0] == ["first query", "second one", "third here"]
    m = spark.createDataFrame([("--- Source 1: Moby Dick (x.txt) [FICTION], p.3 ---\ntext\n--- Source 2: Unknown ---\n--- Source 3: Moby Dick ---",)], "t string")
    assert m.select(I.source_titles(F.col("t"))).first()[0] == ["Moby Dick"]
    w = spark.createDataFrame([("give me a summary",), ("who is in the green book",), ("what is love",)], "q string")
    assert [r[0] for r in w.select(I.is_about_a_work(F.col("q"))).collect()] == [True, True, False]


def test_more_messages(spark):
    q = F.col("q")

    def of(expression, *messages):
        return [r[0] for r in spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "i int, q string").orderBy("i").select(expression).collect()]

    assert of(I.is_listing(q), "how many books are there", "tell me about whales", "find all 5 novels on ships", "find my keys", "which titles cover law?") == [True, True, True, False, True]
    assert of(I.is_quiz(q), "the latest contest", "a study guide on law", "make flashcards") == [False, True, True]
    assert of(I.topic(q), "List works concerning The Law, in the end.", "books about everything in my collection", "browse") == ["Law, in the end", "everything", ""]
    assert of(I.count(q, 7), "a quiz of 12", "build me up to 30", "chapter 4", "5 of 200 cards", "make 0 questions", "quiz with 18-century facts") == [12, 30, 7, 7, 7, 7]
    assert of(I.kind(q), "non fiction", "Fiction", "nonfictional") == ["nonfiction", "fiction", None]
    assert of(I.reply(q)["confirm"], "yes please", "go ahead", "yes but why?", "please") == [True, True, None, None]
    assert of(I.reply(q)["count"], "9 questions", "unit 3 questions", "8 q, deep") == [9, None, 8]
    assert of(I.reply(q)["depth"], "9 questions", "make it deep") == [None, "deep"]
    assert of(I.host_allowed(q), "http://[::1]:80/x", "localhost", "http://localhost.evil.example") == [True, True, False]


def test_scopes(spark):
    sections = spark.createDataFrame([("w", k, "" if k == 2 else f"Part {k}", f"p{k}", 10 * k) for k in range(1, 6)] + [("v", 1, "Only", "q1", 5)], "work string, ordinal int, title string, parent_id string, words long")
    outline = spark.createDataFrame([("w", "UNIT 1: Start | SUBTOPICS: a, b,, c\nnoise\nunit 3 - Middle | subtopics: d\nUNIT 9: none | SUBTOPICS: x"), ("v", "nothing")], "work string, text string")
    got = {(r.work, r.unit_id): r for r in scopes.outlined(outline, sections).collect()}
    assert set(got) == {("w", "u1"), ("w", "u3"), ("v", "u1")} and got["w", "u1"].subtopics == ["a", "b", "c"] and got["w", "u3"].title == "Middle"
    units = scopes.units_of(sections.where("work = 'w'"))
    assert {r.title for r in units.where("ordinal = 2").collect()} == {"Section 2"}
    assert sorted(r.ordinal for r in scopes.chosen(units, ["u1", "4-3", "9"]).collect()) == [1, 3, 4]
    ranked = spark.createDataFrame([(1, k) for k in range(1, 12)], "query_id int, rank int")
    assert [scopes.top_units(ranked, d, 10).count() for d in ("surface", "balanced", "deep")] == [10, 6, 4]
    cited = spark.createDataFrame([("Moby Dick; or", "One"), ("moby dick", "One"), ("Other", "One"), ("Moby Dick", "")], "title string, section_title string")
    assert [tuple(r) for r in scopes.quizzed(cited, "Moby Dick").collect()] == [("one", 2)]
    have, all_units = spark.createDataFrame([("a",), ("a",)], "unit string"), spark.createDataFrame([("a",), ("b",)], "unit string")
    assert sorted(map(tuple, scopes.coverage(have, all_units).collect())) == [("a", 2), ("b", 0)]
    assert scopes.is_covered(have, all_units) and not scopes.is_covered(have.limit(1), all_units)
    tokens = spark.createDataFrame([(1, "a", 90.0), (1, "b", -1.0), (1, " ", 80.0), (2, "c", None)], "page int, text string, conf double")
    assert {r.page: r.confidence for r in scopes.page_confidence(tokens).collect()} == {1: 0.45, 2: 0.0}
    files = spark.createDataFrame([("x/moby dick vol 1.pdf",), ("ring.txt",), ("none.txt",)], "rel_path string")
    books = spark.createDataFrame([("moby dick", "Moby Dick"), ("ring", "Ring")], "stem string, title string")
    assert {r.rel_path: r.title for r in scopes.by_file_name(files, books).collect()} == {"ring.txt": "Ring"}
    assert len(scopes.by_file_name(files, books, True).collect()) == 2
    d = spark.createDataFrame([("a", 3), ("a", -1), ("b", 2)], "decision string, pages int")
    assert {r.decision: (r.files, r.pages) for r in scopes.decisions(d).collect()} == {"a": (2, 3), "b": (1, 2)}
