"""Queries over messages, scopes, files' metadata, the life of quizzes, and whole retrieval plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as X
from ..operators import answering, best, contain, index, library, rank, review, scopes, study
from ..session import stored, table
from ..sources import files
from . import retrieval


def _docs(spark, d):
    return table(spark, d, "documents")


def _messages(spark, d):
    """A message of each of ten forms from every part."""
    p, name, size = table(spark, d, "part"), F.col("p_name"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("List books about "), name, F.lit(" in my library?")),
        F.concat(F.lit("quiz me with "), size, F.lit(" on "), name),
        F.concat(F.lit("What is a "), name, F.lit("?")),
        F.lit("show my novels"),
        F.concat(F.lit("make it "), size, F.lit(" questions and harder")),
        F.lit("ok, please"),
        F.concat(F.lit("give me a summary of the "), name),
        F.lit("who is in the green book"),
        F.concat(F.lit("create "), size, F.lit(" questions about non-fiction on the "), name),
        F.concat(F.lit("how many fiction works on "), name),
    ]
    return p.select(F.col("p_partkey").alias("query_id"), F.element_at(F.array(*forms), (F.col("p_partkey") % 10 + 1).cast("int")).alias("text"))


def message_intents(spark, d):
    q = F.col("text")
    return _messages(spark, d).select("query_id", intent.is_listing(q).alias("listing"), intent.is_quiz(q).alias("quiz"), intent.wants_summary(q).alias("summary"), intent.is_about_a_work(q).alias("work"), intent.is_question(q).alias("question"))


def message_scopes(spark, d):
    q = F.col("text")
    return _messages(spark, d).select("query_id", intent.topic(q).alias("topic"), intent.kind(q).alias("kind"), intent.count(q, 10).cast("long").alias("n"))


def pending_replies(spark, d):
    x = _messages(spark, d).select("query_id", intent.reply(F.col("text")).alias("r")).where("r IS NOT NULL")
    return x.select("query_id", F.col("r.confirm").alias("confirm"), F.col("r.count").cast("long").alias("n"), F.col("r.difficulty").alias("difficulty"), F.col("r.depth").alias("depth"))


def revised_plans(spark, d):
    x = _messages(spark, d).select("query_id", "text", F.lit(10).alias("count"), F.lit("medium").alias("difficulty"), F.lit("balanced").alias("depth"))
    return study.revised(x, intent.reply(F.col("text"))).select("query_id", F.col("count").cast("long").alias("n"), "difficulty", "depth", "confirmed")


def sub_query_lines(spark, d):
    t = F.concat(F.lit("1. "), F.col("p_name"), F.lit("\n- none\n\n* "), F.col("p_type"), F.lit("  \nab\n2) "), F.col("p_brand"), F.lit("\nlast"))
    return table(spark, d, "part").select("p_partkey", F.array_join(intent.sub_queries(t), "|").alias("lines"))


def source_headers(spark, d):
    t = F.concat(F.lit("--- Source 1: "), F.col("p_name"), F.lit(" (a.txt) [FICTION], p.3 ---\nbody\n--- Source 2: Unknown ---\n--- Source 3: "), F.col("p_brand"), F.lit(" ---\n--- Source 4: "), F.col("p_name"), F.lit(" ---"))
    return table(spark, d, "part").select("p_partkey", F.array_join(intent.source_titles(t), "|").alias("titles"))


def allowed_hosts(spark, d):
    host = F.element_at(F.array(*map(F.lit, ("http://localhost:8080/x", "127.0.0.1:5", "[::1]:80", "https://evil.example", "localhost.evil.example", "LOCALHOST"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", intent.host_allowed(host).alias("allowed"))


def catalogue_requests(spark, d):
    asks = _messages(spark, d)
    parts = table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("source"), X.kind_of(F.array("p_type")).alias("kind"), F.array("p_type").alias("tags"))
    books = library.works(parts).select("title", "source", F.lit("nonfiction").alias("kind"), F.array().cast("array<string>").alias("tags"))
    # each list is counted once, not for every message that asks for it
    wanted = stored(answering.catalogue_asks(asks), "catalogue-asks")
    lists = answering.catalogue_lists(wanted, books).groupBy("topic", "of").agg(F.count("*").alias("works"), F.min_by("title", "rank").alias("first"))
    return wanted.join(lists, ["topic", "of"]).select("query_id", "works", "first")


def _units(spark, d):
    """Documents as sections of their source."""
    w = F.regexp_extract("source", r"\d+", 0).cast("int")
    return _docs(spark, d).select(F.col("lang").alias("work"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("title"), w.alias("no"), "doc_id", "source", X.word_count(F.col("text")).alias("words"))


def chosen_units(spark, d):
    s = _units(spark, d).select("work", F.col("doc_id").cast("int").alias("ordinal"), F.when(F.col("doc_id") % 3 > 0, F.col("title")).alias("title"), F.col("doc_id").cast("string").alias("parent_id"), "words")
    return scopes.chosen(scopes.units_of(s), ["u1", "44-40", "7", "x"]).select("work", "unit_id", "title")


def outlined_units(spark, d):
    works = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("work"), F.col("p_name"), F.col("p_type"))
    outline = works.select("work", F.when(F.col("work") % 3 > 0, F.concat(F.lit("UNIT 1: "), F.col("p_name"), F.lit(" | SUBTOPICS: a, "), F.col("p_type"), F.lit(",, c\nnoise\nunit 3 - X | subtopics: d\nUNIT 9: none | SUBTOPICS: x"))).otherwise("nothing").alias("text"))
    sections = works.select("work", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal")).select("work", "ordinal", F.concat(F.lit("Part "), F.col("ordinal").cast("string")).alias("title"), F.concat_ws(":", "work", F.col("ordinal").cast("string")).alias("parent_id"), F.lit(10).cast("long").alias("words"))
    return scopes.outlined(outline, sections).select("work", "unit_id", "title", F.array_join("subtopics", ",").alias("subtopics"))


def unit_coverage(spark, d):
    units = _docs(spark, d).select(F.col("source").alias("unit")).distinct()
    good = table(spark, d, "labels").where("quality = 1").join(_docs(spark, d), "doc_id").select(F.col("source").alias("unit"))
    return scopes.coverage(good, units)


def quizzed_units(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("The "), F.col("p_name")).alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("section_title"))
    return scopes.quizzed(p, "red widget")


def page_confidence(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("text"), F.when(F.col("event_id") % 5 == 0, -1.0).when(F.col("event_id") % 11 > 0, F.col("value")).alias("conf"))
    return scopes.page_confidence(e).select("page", F.round("confidence", 6).alias("confidence"))


def page_decisions(spark, d):
    return scopes.decisions(table(spark, d, "part").select(F.col("p_brand").alias("decision"), (F.col("p_size") - 3).alias("pages")))


def index_covers(spark, d):
    docs = _docs(spark, d)
    some, most = (scopes.is_covered(docs.where(F.col("doc_id") % 20 < k), docs) for k in (17, 18))
    return spark.range(1).select(F.lit(some).alias("some"), F.lit(most).alias("most"))


def file_titles(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.concat(F.lit("shelf/"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" vol "), F.col("p_partkey").cast("string"))), F.lit(".pdf")).alias("rel_path")).distinct()
    books = p.where("p_size < 40").select(F.col("p_name").alias("stem"), F.upper("p_name").alias("title")).distinct()
    return scopes.by_file_name(names, books, loose=True)


def recognised_pages(spark, d):
    t = F.concat(F.lit("before\n--- Page 1 ---\n"), F.col("p_name"), F.lit("\nline two\n--- Page 3 ---\n\n"), F.col("p_type"), F.lit("\n"))
    return files.recognised_pages(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rel_path"), t.alias("text"))).select("rel_path", F.col("page").cast("long").alias("page"), "text")


def preferred_texts(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("rel_path"), "text")
    seen = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("rel_path"), F.concat(F.lit("ocr "), F.col("quality").cast("string")).alias("ocr_text"))
    return files.preferring_recognised(docs, seen).select("rel_path", F.sha2("text", 256).alias("sha"))


def progress_lines(spark, d):
    line = F.when(F.col("p_partkey") % 4 == 0, "starting").otherwise(F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit("/2000] x.pdf done="), F.col("p_size").cast("string"), F.lit(" skip=1 err="), (F.col("p_partkey") % 3).cast("string")))
    return files.progress(table(spark, d, "part").select(line.alias("value")))


def package_metadata(spark, d):
    t = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title id="t">'), F.col("p_name"), F.lit("</dc:title><dc:subject>"), F.col("p_type"), F.lit("</dc:subject><dc:subject>"), F.col("p_brand"), F.lit("</dc:subject></metadata></package>"))
    x = files.package_metadata(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rel_path"), t.alias("text")))
    return x.select("rel_path", "title", F.array_join("tags", "|").alias("tags"))


def question_blocks(spark, d):
    t = F.concat(F.lit("Q: What is "), F.col("p_name"), F.lit("?\nA) x\nB) "), F.col("p_type"), F.lit("\nANSWER: B\nDIFFICULTY: easy\n-----\nnoise\n---\nq: again\nTYPE: short_answer\nANSWER: "), F.col("p_brand"))
    x = files.question_blocks(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc"), t.alias("text")))
    return x.select("doc", F.col("i").cast("long").alias("i"), "q", "answer", "difficulty", "type", F.array_join("choices", "|").alias("choices"))


def tool_calls(spark, d):
    t = F.when(F.col("p_partkey") % 3 == 0, "no call").otherwise(F.concat(F.lit('I think.\nCall: search({"q": "'), F.col("p_name"), F.lit('"})')))
    x = table(spark, d, "part").select("p_partkey", files.tool_call(t).alias("c"))
    return x.select("p_partkey", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.q").alias("q"))


def json_objects(spark, d):
    t = F.concat(F.lit('Sure:\n```json\n{"title": "'), F.col("p_name"), F.lit('", "n": '), F.col("p_size").cast("string"), F.lit("}\n```"))
    x = table(spark, d, "part").select("p_partkey", files.json_object(t, "title string, n long").alias("o"))
    return x.select("p_partkey", F.col("o.title").alias("title"), F.col("o.n").alias("n"))


def normal_questions(spark, d):
    k = F.element_at(F.array(*map(F.lit, ("Multiple-Choice", "TF", "cloze", "essay", " mcq "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    q = F.struct(F.concat(F.lit(" "), F.col("p_name")).alias("q"), k.alias("type"), F.when(F.col("p_size") > 20, "HARD").when(F.col("p_size") > 10, "silly").alias("difficulty"), F.when(F.col("p_partkey") % 5 != 3, F.array("p_type", "p_brand")).alias("choices"), F.lit(None).cast("string").alias("answer"))
    n = study.normal_question(q)
    return table(spark, d, "part").select("p_partkey", n["q"].alias("q"), n["type"].alias("type"), n["difficulty"].alias("difficulty"), F.array_join(n["choices"], "|").alias("choices"), n["answer"].alias("answer"))


def depth_scores(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(study.depth_score(F.col("p_size") * 10, F.col("p_partkey") % 7), 6).alias("score"))


def remaining_times(spark, d):
    left = X.remaining_time(F.col("p_partkey") % 50, F.lit(50).cast("long"), F.col("p_size").cast("long") * 10)
    return table(spark, d, "part").select("p_partkey", left.alias("left"))


def title_pairs(spark, d):
    n = table(spark, d, "nation").select("n_name")
    return contain.titles_within(n.select(F.concat(F.lit("The "), F.col("n_name")).alias("cited")), n.select(F.col("n_name").alias("real")))


def enrolled_cards(spark, d):
    e = table(spark, d, "events")
    have = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("card"), F.lit("q").alias("quiz_id")).agg(F.count("*").alias("reviews")).withColumn("due", F.col("reviews") * 10)
    cards = review.enrolled(have, e.select(F.col("user_id").alias("card"), F.lit("q2").alias("quiz_id")))
    cards = review.withdrawn(cards.withColumn("quiz_id", F.when(F.col("card") % 5 == 0, "gone").otherwise(F.col("quiz_id"))), spark.range(1).select(F.lit("gone").alias("quiz_id")))
    return cards.select("card", "quiz_id", "reviews", "due")


def latest_attempts(spark, d):
    o = table(spark, d, "orders")
    finished = F.when(F.col("o_orderstatus") != "O", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    x = study.latest_attempts(o.select(F.col("o_custkey").alias("quiz_id"), F.col("o_orderkey").alias("attempt_id"), finished.alias("finished"), F.col("o_totalprice").alias("score")))
    return x.select("quiz_id", "attempt_id", "finished", "score")


def newest_orders(spark, d):
    return study.newest_first(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))


def answered_points(spark, d):
    q = table(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("qid"), F.col("p_partkey").alias("position"), F.col("p_name").alias("q"))
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 50).alias("point"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("q"), (F.col("o_orderkey") % 60).cast("string"))).alias("qid"))
    return study.answered_points(points, q).select("point_id", F.col("question.qid").alias("qid"))


def _grounded(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("title"), "text", F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")).alias("parent_id"))
    parents = docs.where("doc_id % 4 = 0").select("parent_id", "text")
    return docs, parents


def grounded_answers(spark, d):
    """The whole plan for every benchmark item, with vectors as a dense leg where an item has one."""
    docs, parents = _grounded(spark, d)
    asks = retrieval._asks(spark, d)
    vectors = retrieval._vector_asks(spark, d).withColumn("query_id", (F.col("query_id") / 20).cast("long")).join(asks.select("query_id").distinct(), "query_id", "left_semi")
    dense = rank.cosine_knn(retrieval._vectors(spark, d), vectors, answering.POOL).withColumnRenamed("vec_id", "doc_id")
    out = answering.grounded(asks, docs, parents, dense, budget=1500)
    return out.select("query_id", "doc_id", "title", F.col("place").cast("long").alias("place"), F.sha2("document", 256).alias("document_sha"))


def cited_sources(spark, d):
    docs, _ = _grounded(spark, d)
    return answering.sources(answering.grounded(retrieval._asks(spark, d), docs)).select("query_id", "title", F.col("place").cast("long").alias("place"))


def pool_warnings(spark, d):
    """The guard over the pools of benchmark items, half of them with a name that no document has."""
    docs, _ = _grounded(spark, d)
    asks = retrieval._asks(spark, d).withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Zanzibar Quuxington "), F.col("text"))).otherwise(F.lower("text")))
    stats = index.Statistics(docs)
    return answering.guarded(asks, answering.pool(asks, docs, stats, size=10), index.common_terms(stats.frequencies, max(stats.docs, 1)))


def two_hops(spark, d):
    """Every benchmark item, then the whole text of the best document found as a question of its own."""
    docs = _docs(spark, d)
    stats = index.Statistics(docs)

    def search(q):
        return best.bm25_top(docs, q, 5, statistics=stats).select("query_id", "doc_id", F.round("score", 6).alias("score"))

    def ask(q, found):
        first = found.groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"))
        return first.join(docs.select("doc_id", "text"), "doc_id").select("query_id", "text")

    return answering.several_hops(retrieval._asks(spark, d), search, ask).select("query_id", "doc_id", F.col("hop").cast("long").alias("hop"), F.col("rank").cast("long").alias("rank"))


def _sections(spark, d):
    docs = _docs(spark, d)
    return docs.select(F.col("source").alias("query_id"), F.col("lang").alias("title"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("parent_id"), "text")


def deep_sections(spark, d):
    s = _sections(spark, d)
    return answering.deep_sections(s.select("query_id", "parent_id"), s.drop("query_id"), 9).select("query_id", "parent_id", F.col("pos").cast("long").alias("pos"))


def section_summaries(spark, d):
    """A stand-in summariser that keeps the length of its material."""
    s = answering.deep_sections(_sections(spark, d).select("query_id", "parent_id"), _sections(spark, d).drop("query_id"), 9)
    return answering.summarised(s, lambda m: F.concat(F.lit("n="), F.length(m).cast("string")), "query_id")


def topic_units(spark, d):
    topics = retrieval._asks(spark, d)
    units = _docs(spark, d).select(F.col("doc_id").alias("unit"), "text")
    ranked = answering.ranked_units(topics, units, most=20)
    return scopes.top_units(ranked, "deep", 10).select("query_id", "unit", F.col("rank").cast("long").alias("rank"))


def golden_metrics(spark, d):
    """Golden rows from parts: the title of one of them is expected, or the works of a brand."""
    p = table(spark, d, "part")
    golden = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 3 == 0, "topic").otherwise("retrieval").alias("mode"), F.concat(F.lit("The "), F.col("p_name")).alias("expected_title"), F.array(F.col("p_name"), F.lit("no such work")).alias("expected_works"))
    hits = p.select(F.col("p_partkey").alias("query_id"), F.explode(F.sequence(F.lit(1), (F.col("p_size") % 7).cast("int") + 1)).alias("rank"), "p_name", "p_size").withColumn("title", F.when(F.col("rank") == F.col("p_size") % 8, F.col("p_name")).otherwise(F.concat(F.lit("zzz"), F.col("rank").cast("string"))))
    m = answering.evaluated(golden, hits)
    return m.select("query_id", "mode", "hit", *[F.round(c, 6).alias(c) for c in ("rr", "recall", "precision")])


QUERIES = {f.__name__: f for f in (message_intents, message_scopes, pending_replies, revised_plans, sub_query_lines, source_headers, allowed_hosts, catalogue_requests, chosen_units, outlined_units, unit_coverage, quizzed_units, page_confidence, page_decisions, index_covers, file_titles, recognised_pages, preferred_texts, progress_lines, package_metadata, question_blocks, tool_calls, json_objects, normal_questions, depth_scores, remaining_times, title_pairs, enrolled_cards, latest_attempts, newest_orders, answered_points, grounded_answers, cited_sources, pool_warnings, two_hops, deep_sections, section_summaries, topic_units, golden_metrics)}

# what each form of message is, as it was made
_M = "WITH m AS (SELECT p_partkey AS query_id, p_partkey % 10 AS f, p_name AS name, p_size::BIGINT AS size FROM part)"
_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_SEC = "s AS (SELECT source AS query_id, lang AS title, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id, lang) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM documents), ds AS (SELECT * FROM s WHERE m <= 9 OR list_contains(list_transform(range(9), lambda i: (i * m) // 9), pos))"

SQL = {
    "message_intents": f"{_M} SELECT query_id, f IN (0, 3, 9) AS listing, f IN (1) AS quiz, f = 6 AS summary, f IN (0, 6, 7, 8) AS work, f IN (0, 2, 3, 6, 7, 9) AS question FROM m",
    "message_scopes": f"{_M} SELECT query_id, CASE f WHEN 0 THEN name WHEN 1 THEN name WHEN 8 THEN 'non-fiction on the ' || name WHEN 9 THEN name ELSE '' END AS topic, CASE f WHEN 8 THEN 'nonfiction' WHEN 9 THEN 'fiction' END AS kind, CASE WHEN f IN (1, 4, 8) AND size > 0 THEN size ELSE 10 END AS n FROM m",
    "pending_replies": f"{_M} SELECT query_id, f = 5 AS confirm, CASE WHEN f IN (4, 8) THEN size END AS n, CASE WHEN f = 4 THEN 'hard' END AS difficulty, NULL::VARCHAR AS depth FROM m WHERE f IN (4, 5, 8)",
    "revised_plans": f"{_M} SELECT query_id, CASE WHEN f IN (4, 8) THEN size ELSE 10 END AS n, CASE WHEN f = 4 THEN 'hard' ELSE 'medium' END AS difficulty, 'balanced' AS depth, f = 5 AS confirmed FROM m",
    "sub_query_lines": "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS lines FROM part",
    "source_headers": "SELECT p_partkey, p_name || '|' || p_brand AS titles FROM part",
    "allowed_hosts": "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 5) AS allowed FROM part",
    "chosen_units": "SELECT lang AS work, 'u' || doc_id AS unit_id, CASE WHEN doc_id % 3 > 0 THEN source || '/' || doc_id ELSE 'Section ' || doc_id END AS title FROM documents WHERE doc_id IN (1, 7) OR doc_id BETWEEN 40 AND 44",
    "outlined_units": "SELECT p_partkey::VARCHAR AS work, 'u' || i AS unit_id, CASE WHEN p_partkey % 3 = 0 THEN 'Part ' || i WHEN i = 1 THEN p_name ELSE 'X' END AS title, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN i = 1 THEN 'a,' || p_type || ',c' ELSE 'd' END AS subtopics FROM part, range(1, 4) AS t(i) WHERE p_partkey % 3 = 0 OR i IN (1, 3)",
    "unit_coverage": "SELECT source AS unit, count(*) FILTER (quality = 1) AS accepted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "quizzed_units": f"SELECT {_KEY.format('p_brand')} AS unit_key, count(*) AS questions FROM part WHERE p_size > 5 AND contains({_KEY.format(chr(39) + 'The ' + chr(39) + ' || p_name')}, 'redwidget') GROUP BY 1",
    "page_confidence": "SELECT user_id AS page, round(avg(CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN 0 ELSE greatest(value, 0) END) / 100, 6) AS confidence FROM events WHERE event_id % 7 > 0 GROUP BY user_id",
    "page_decisions": "SELECT p_brand AS decision, count(*) AS files, sum(greatest(p_size - 3, 0))::BIGINT AS pages FROM part GROUP BY p_brand",
    "index_covers": "SELECT count(*) FILTER (doc_id % 20 < 17) / count(*) >= 0.9::DOUBLE AS some, count(*) FILTER (doc_id % 20 < 18) / count(*) >= 0.9::DOUBLE AS most FROM documents",
    "file_titles": "WITH f AS (SELECT DISTINCT 'shelf/' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' vol ' || p_partkey END || '.pdf' AS rel_path, p_name FROM part), b AS (SELECT DISTINCT p_name FROM part WHERE p_size < 40) SELECT rel_path, upper(p_name) AS title FROM f JOIN b USING (p_name)",
    "recognised_pages": "SELECT p_partkey::VARCHAR AS rel_path, 1::BIGINT AS page, p_name || chr(10) || 'line two' AS text FROM part UNION ALL SELECT p_partkey::VARCHAR, 3, p_type FROM part",
    "preferred_texts": "SELECT doc_id::VARCHAR AS rel_path, sha256(coalesce('ocr ' || quality, text)) AS sha FROM documents LEFT JOIN labels USING (doc_id)",
    "progress_lines": "SELECT p_partkey AS i, 2000 AS n, p_size AS done, 1 AS skip, p_partkey % 3 AS err FROM part WHERE p_partkey % 4 > 0",
    "package_metadata": "SELECT p_partkey::VARCHAR AS rel_path, p_name AS title, p_type || '|' || p_brand AS tags FROM part",
    "question_blocks": "SELECT p_partkey::VARCHAR AS doc, 0 AS i, 'What is ' || p_name || '?' AS q, 'B' AS answer, 'easy' AS difficulty, '' AS type, 'A) x|B) ' || p_type AS choices FROM part UNION ALL SELECT p_partkey::VARCHAR, 2, 'again', p_brand, '', 'short_answer', '' FROM part",
    "tool_calls": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'search' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS q FROM part",
    "json_objects": "SELECT p_partkey, p_name AS title, p_size AS n FROM part",
    "normal_questions": "SELECT p_partkey, p_name AS q, ['mcq', 'true_false', 'fill_blank', 'short_answer', 'mcq'][p_partkey % 5 + 1] AS type, CASE WHEN p_size > 20 THEN 'hard' ELSE 'medium' END AS difficulty, CASE WHEN p_partkey % 5 IN (0, 4) THEN 'A) ' || p_type || '|B) ' || p_brand END AS choices, '' AS answer FROM part",
    "depth_scores": "SELECT p_partkey, round(ln(1 + p_partkey % 7) * ln(1 + p_size * 10), 6) AS score FROM part",
    "remaining_times": "SELECT p_partkey, CASE WHEN p_partkey % 50 > 0 THEN printf('%02d:%02d', s // 60, s % 60) END AS left FROM (SELECT *, round((50 - p_partkey % 50) * p_size * 10 / nullif(p_partkey % 50, 0))::BIGINT AS s FROM part)",
    "title_pairs": "WITH n AS (SELECT n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM nation) SELECT 'The ' || a.n_name AS cited, b.n_name AS real FROM n a JOIN n b ON contains('the ' || a.k, b.k) OR contains(b.k, 'the ' || a.k)",
    "enrolled_cards": "WITH c AS (SELECT user_id AS card, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id) SELECT card, CASE WHEN n > 0 THEN 'q' ELSE 'q2' END AS quiz_id, n AS reviews, CASE WHEN n > 0 THEN n * 10 END AS due FROM c WHERE card % 5 > 0",
    "latest_attempts": "SELECT o_custkey AS quiz_id, o_orderkey AS attempt_id, floor(epoch(o_orderdate))::BIGINT AS finished, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "newest_orders": "SELECT o_orderkey, floor(epoch(o_orderdate))::BIGINT AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "answered_points": "SELECT o_orderkey AS point_id, 'q' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE o_orderkey % 50 END AS qid FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE o_orderkey % 50 END < (SELECT count(*) FROM part)",
    "cited_sources": f"WITH {retrieval._B}, h AS (SELECT query_id, top.doc_id, rank, source AS title, text AS document FROM top JOIN documents USING (doc_id) WHERE rank <= 40), s AS (SELECT h.*, len(list_intersect(list_distinct({retrieval.TOK.format('q.text')}), list_distinct({retrieval.TOK.format('document')}))) / len(list_distinct({retrieval.TOK.format('q.text')})) AS rs FROM h JOIN q USING (query_id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) AS nr FROM s), d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, document ORDER BY nr) AS i FROM n WHERE nr <= 24), d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY nr) AS j FROM d1 WHERE i = 1), d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nr) AS place FROM d2 WHERE j <= 3), b AS (SELECT *, sum(len({retrieval.WS.format('document')})) OVER w AS used, count(*) OVER w AS kept FROM d3 WHERE place <= 8 WINDOW w AS (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING)) SELECT query_id, title, min(place)::BIGINT AS place FROM b WHERE used <= 3000 GROUP BY ALL",
    "deep_sections": f"WITH {_SEC} SELECT query_id, doc_id::VARCHAR AS parent_id, pos FROM ds",
    "section_summaries": f"WITH {_SEC}, b AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1) // 6 AS batch FROM ds), g AS (SELECT query_id, batch, 'n=' || length(string_agg('## ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS said FROM b GROUP BY ALL) SELECT query_id, 'n=' || length(string_agg(said, chr(10) || chr(10) ORDER BY batch)) AS summary FROM g GROUP BY query_id",
    "topic_units": f"WITH {retrieval._B} SELECT query_id, doc_id AS unit, rank FROM top WHERE rank <= 4",
    "golden_metrics": "WITH h AS (SELECT p_partkey AS query_id, p_partkey % 3 = 0 AS topic, p_size % 8 AS good, least(p_size % 7 + 1, 5) AS shown FROM part) SELECT query_id, CASE WHEN topic THEN 'topic' ELSE 'retrieval' END AS mode, (good BETWEEN 1 AND shown)::INT AS hit, CASE WHEN good BETWEEN 1 AND shown THEN round(1 / good, 6) ELSE 0 END AS rr, CASE WHEN good BETWEEN 1 AND shown THEN CASE WHEN topic THEN 0.5 ELSE 1 END ELSE 0 END::DOUBLE AS recall, CASE WHEN good BETWEEN 1 AND shown THEN round(1 / shown, 6) ELSE 0 END AS precision FROM h",
}
