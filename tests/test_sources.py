"""File sources, sinks and streams on small folders."""

import json
import zipfile

from pyspark.sql import functions as F

from corpuscle.sources import files, sinks
from corpuscle.operators import review as cards
from corpuscle.streaming import ingest, review, windows


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "d.epub", "w") as z:
        z.writestr("x.opf", '<item id="1" href="two.xhtml"/><item id="2" href="one.xhtml"/><spine><itemref idref="2"/><itemref idref="1"/></spine>')
        z.writestr("one.xhtml", "<p>First</p><script>x</script>")
        z.writestr("two.xhtml", "<h1>Second</h1><p>more &amp; more</p>")
    scan = files.scan(spark, str(tmp_path))
    assert sorted(r.ext for r in scan.select("ext").collect()) == ["epub", "pdf", "txt"]
    got = {r.rel_path.rsplit("/", 1)[1]: r for r in files.extract(scan).collect()}
    assert got["a.txt"].text == "plain text" and got["d.epub"].text == "First\n\nSecond\n\nmore & more"
    assert got["b.pdf"].text is None and got["b.pdf"].error == "no extractor for pdf"
    assert {r.ext: r.files for r in files.scan_report(scan).collect()}["txt"] == 1


def test_parsers(spark, tmp_path):
    pages = spark.createDataFrame([("r", "front\n--- Page 1 ---\nalpha\nbeta\n--- Page 3 ---\ngamma")], "rel_path string, text string")
    assert [(r.page, r.text) for r in files.recognised_pages(pages).orderBy("page").collect()] == [(1, "alpha\nbeta"), (3, "gamma")]
    lines = spark.createDataFrame([("[3/9] x done=2 skip=1 err=0",), ("noise",)], "value string")
    assert [tuple(r) for r in files.progress(lines).collect()] == [(3, 9, 2, 1, 0)]
    opf = spark.createDataFrame([("o", '<package xmlns="u"><metadata xmlns:dc="v"><dc:title>T</dc:title><dc:subject>A</dc:subject><dc:subject>B</dc:subject></metadata></package>')], "rel_path string, text string")
    assert tuple(files.package_metadata(opf).first()) == ("o", "T", ["A", "B"])
    block = spark.createDataFrame([("d", "Q: What?\nA) one\nB) two\nANSWER: B\n---\nQ: Why?\nTYPE: short_answer\nANSWER: x")], "doc string, text string")
    got = files.question_blocks(block).orderBy("i").collect()
    assert got[0].choices == ["A) one", "B) two"] and got[1].type == "short_answer"
    call = spark.createDataFrame([('call: find({"q": 1})',), ("no",)], "t string").select(files.tool_call(F.col("t")).alias("c")).collect()
    assert tuple(call[0].c) == ("find", '{"q": 1}') and call[1].c is None
    j = spark.createDataFrame([('Sure:\n```json\n{"score": 0.5}\n```',)], "t string").select(files.json_object(F.col("t"), "score double").alias("j")).first()
    assert j.j.score == 0.5
    (tmp_path / "g.jsonl").write_text(json.dumps({"query": "q", "expected_title": "t", "set": "s", "expected_titles": ["a"]}) + "\n" + json.dumps({"query": "r", "expected_title": "t", "set": "s"}))
    assert sorted(r.mode for r in files.golden(spark, str(tmp_path / "g.jsonl")).collect()) == ["retrieval", "topic"]


def test_exports(spark, tmp_path):
    q = spark.createDataFrame([(1, ("What {x}?", "mcq", ["A) a", "B) b"], "B"))], "qid long, question struct<q:string,type:string,choices:array<string>,answer:string>")
    assert sinks.gift(q).first()[0] == "::1:: What \\{x\\}? {~A) a =B) b}"
    for form in ("gift", "markdown", "csv", "json"):
        sinks.write_export(q, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().answer == "B"
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    p0 = sinks.upsert(spark, rows, str(tmp_path / "t"), ["k"], 0)
    p1 = sinks.upsert(spark, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), str(tmp_path / "t"), ["k"], 1)
    assert spark.read.parquet(p0).count() == 1 and spark.read.parquet(p1).count() == 2


def test_incremental_ingest(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.txt").write_text(" ".join(map(str, range(400))))
    ingest.ingest(spark, str(folder), target, checkpoint)
    (folder / "b.txt").write_text("only a few words")
    ingest.ingest(spark, str(folder), target, checkpoint)
    got = ingest.current_chunks(spark, target)
    assert got.count() == 3 and got.select("rel_path").distinct().count() == 2
    (folder / "a.txt").unlink()
    assert [r.document for r in ingest.current_chunks(spark, target, str(folder)).collect()] == ["only a few words"]


def test_hidden_folders_above_do_not_matter(spark, tmp_path):
    for path in (".above/lib/a.txt", ".above/lib/.git/b.txt", ".above/lib/sub/c.txt"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path / ".above/lib")).select("path").collect()) == ["a.txt", "c.txt"]


def test_review_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "card string, rating string, ts double"
    spark.createDataFrame([("a", "good", 0.0), ("b", "hard", 1.0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = review.scheduled_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    for _ in range(2):
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.createDataFrame([("a", "good", 4 * 86400.0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out")).where("card = 'a'").orderBy("reviews").collect()
    assert [r.reviews for r in got] == [1, 2] and got[1].stability > got[0].stability


def test_event_windows_on_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.sql("SELECT 1L event_id, TIMESTAMP '2024-01-01 10:00:00' ts, 1L user_id, 'a' event_type, 2.0D value UNION ALL SELECT 2L, TIMESTAMP '2024-01-01 12:00:00', 1L, 'a', 3.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.watermarked(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "1 day")
    q = s.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").first().events == 2


def test_cards_fall_due_on_a_stream(spark, tmp_path):
    """Timers by event time, with a restart between; what the stream tells last equals the batch."""
    schema = "card string, rating string, at timestamp"

    def feed(rows):
        spark.createDataFrame(rows, "card string, rating string, ts double").selectExpr("card", "rating", "timestamp_seconds(ts) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = review.due_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.card, r.due, r.reviews) for r in spark.read.parquet(str(tmp_path / "out")).where("told = 'due'").collect())

    first = [("a", "good", 1000.0), ("b", "easy", 1000.0), ("z", "again", 1700.0), ("c", "no such rating", 1005.0)]
    assert feed(first) == [("a", 1600.0, 1)]
    second = [("a", "good", 1800.0), ("z", "withdrawn", 1750.0), ("clock", "withdrawn", 40 * 86400.0)]
    told = feed(second)
    batch = cards.scheduled_in_steps(spark.createDataFrame([r for r in first + second if r[0] in "ab"], "card string, rating string, ts double")).collect()
    assert told == sorted([("a", 1600.0, 1), *((r.card, r.due, r.reviews) for r in batch)]) and {r.phase for r in batch} == {"review"}
