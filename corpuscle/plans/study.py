"""Queries over questions, grades, reviews and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, review, study, talk
from ..session import table
from .texts import TOK, WS


def _questions(spark, d):
    """Questions of all kinds made from parts: name, brand and size give text, choices and answer."""
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("mcq", "true_false", "fill_blank", "short_answer"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    choices = F.array(F.concat(F.lit("A) "), F.col("p_name")), F.concat(F.when(F.col("p_partkey") % 5 == 0, "A) ").otherwise("B) "), F.col("p_brand")))
    answer = F.when(kind == "mcq", F.when(F.col("p_partkey") % 3 == 0, "b) x").otherwise(F.concat(F.lit("B) "), F.col("p_brand")))).when(kind == "true_false", F.when(F.col("p_size") % 2 == 0, "True").when(F.col("p_size") % 3 == 0, "maybe").otherwise("false")).otherwise(F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")))
    text = F.when(F.col("p_partkey") % 11 == 0, "Why?").otherwise(F.concat(F.lit("What is "), F.col("p_type")))
    return p.select(F.col("p_partkey").alias("qid"), F.struct(text.alias("q"), kind.alias("type"), F.when(kind == "mcq", choices).alias("choices"), answer.alias("answer")).alias("question"), F.col("p_brand").alias("unit"), F.when(F.col("p_size") < 20, "easy").otherwise("hard").alias("difficulty"), "p_size", "p_name")


def structure_faults(spark, d):
    return _questions(spark, d).select("qid", study.structure_fault(F.col("question")).alias("fault"))


def fault_counts(spark, d):
    q = _questions(spark, d)
    x = study.drop_reasons(q.select("unit", study.structure_fault(F.col("question")).alias("reason")))
    return x.select("unit", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("reasons"))


def _graded(spark, d):
    q = _questions(spark, d)
    given = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.lit("yes")).otherwise(F.lit("B) it"))
    return q.withColumn("correct", study.graded(F.col("question.type"), F.col("question.answer"), given))


def grade_answers(spark, d):
    return _graded(spark, d).select("qid", F.col("question.type").alias("type"), "correct")


def accuracy_sets(spark, d):
    g = _graded(spark, d).where("correct IS NOT NULL").select("unit", "difficulty", F.col("question.type").alias("type"), "correct")
    return study.analytics(g)


def weakness_weights(spark, d):
    x = study.weakness_weights(_graded(spark, d).where("NOT correct"))
    return x.select("unit_key", "misses", F.round("weight", 6).alias("weight"))


def allocate_budget(spark, d):
    units = table(spark, d, "documents").groupBy("source").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    units = units.select("source", F.regexp_extract("source", r"\d+", 0).cast("long").alias("unit_no"), "words", F.lit(1.0).alias("weight"))
    few = study.allocation(units, 12).select("source", F.col("allocation").alias("few"))
    many = study.allocation(units, 107).select("source", F.col("allocation").alias("many"))
    return few.join(many, "source")


def grounding_contains(spark, d):
    """Benchmark items against the documents that hold them."""
    items = table(spark, d, "benchmark").select("item_id", X.collapsed(F.col("text")).alias("x"))
    docs = table(spark, d, "documents").select("doc_id", X.collapsed(F.col("text")).alias("t"))
    return study.holders(docs, items).groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def grounding_faults(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    x = b.join(docs, F.col("item_id") * 3 == F.col("doc_id"), "left")
    x = x.withColumn("excerpt", F.when(F.col("item_id") % 3 == 0, F.substring("body", 10, 80)).when(F.col("item_id") % 3 == 1, F.lit("")).otherwise(F.col("text")))
    ratio = study.grounding_ratio(F.col("excerpt"), F.col("body"))
    return x.select("item_id", study.grounding_fault(F.col("body"), F.col("title"), F.col("title"), F.col("excerpt"), ratio).alias("fault"))


def duplicate_questions(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("q"), (F.col("doc_id") % 10).alias("batch"))
    return study.earlier_duplicates(q)


def stripped_answers(spark, d):
    return study.without_answers(_questions(spark, d)).select("qid", F.sha2(F.to_json("question"), 256).alias("sha"))


def exports(spark, d):
    """GIFT lines of multiple-choice questions."""
    q = _questions(spark, d).where("question.type = 'mcq'")
    options = F.array_join(F.transform("question.choices", lambda c: F.concat(F.when(X.choice_letter(c) == F.upper(F.substring(F.col("question.answer"), 1, 1)), "=").otherwise("~"), X.gift_escaped(c))), " ")
    return q.select("qid", F.concat(F.lit("::q"), F.col("qid").cast("string"), F.lit(":: "), X.gift_escaped(F.col("question.q")), F.lit(" {"), options, F.lit("}")).alias("line"))


def _cards(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("card"), F.col("event_type").alias("quiz_id")).agg(F.max(seconds).alias("last"), F.count("*").alias("reviews"), F.count_if(F.col("value") > 50).alias("passes")).withColumn("due", F.when(F.col("card") % 9 > 0, F.col("last") + 86400 * (F.col("card") % 5)))


NOW = 1706572800  # 2024-01-30


def due_queue(spark, d):
    x = review.due_queue(_cards(spark, d).withColumn("card", F.concat_ws(":", "quiz_id", "card")), F.lit(NOW), 50)
    return x.select("card", "due")


def due_per_quiz(spark, d):
    return _cards(spark, d).where(review.is_due(F.col("due"), F.lit(NOW))).groupBy("quiz_id").agg(F.count("*").alias("due"))


def review_stats(spark, d):
    return review.review_stats(_cards(spark, d), F.lit(NOW))


def strength_over_time(spark, d):
    h = table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("stability"))
    return review.strength_by_day(h).select("day", F.round("stability", 6).alias("stability"), "reviews")


def scheduled_cards(spark, d):
    names = list(review.RATINGS)
    e = table(spark, d, "events")
    rating = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("value")) % 4 + 1).cast("int"))
    x = review.scheduled(e.select(F.col("user_id").alias("card"), rating.alias("rating"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")))
    return x.select("card", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), "due", "reviews")


def stepped_cards(spark, d):
    """Cards with their short steps. Every rating is followed half a minute later by the one of the event's kind."""
    names = F.array(*map(F.lit, review.RATINGS))
    e = table(spark, d, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    pair = F.array(F.struct(F.element_at(names, (F.floor("value") % 4 + 1).cast("int")).alias("rating"), at.alias("ts")), F.struct(F.element_at(names, (F.length("event_type") % 4 + 1).cast("int")).alias("rating"), (at + 30).alias("ts")))
    x = review.scheduled_in_steps(e.select(F.col("user_id").alias("card"), F.inline(pair)))
    return x.select("card", "phase", "step", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), "due", "reviews")


def conv_summary(spark, d):
    return talk.summaries(table(spark, d, "conversations")).select("conv_id", "messages", "last_turn", "title", F.sha2("last_answer", 256).alias("answer_sha"))


def history_budget(spark, d):
    return talk.history(table(spark, d, "conversations"), 2000).select("conv_id", "turn", "used")


def history_budget_recent(spark, d):
    return talk.history(table(spark, d, "conversations"), 2000, newest_first=True).select("conv_id", "turn", "used")


def answer_letters(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("A) ", "b. ", "C", " D: ", "x ", "Apple "))), (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 6 == 2, "").otherwise(F.col("p_name")))
    labels = X.with_letters(F.array("p_name", F.lit(""), F.concat(F.lit("C) "), F.col("p_brand"))))
    return p.select("p_partkey", X.answer_letter(raw).alias("answer"), X.choice_letter(raw).alias("choice"), X.truth(F.element_at(F.array(*map(F.lit, ("Yes", "f", "maybe"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("truth"), F.array_join(labels, "|").alias("labels"), X.titles_agree(F.col("p_name"), F.concat(F.lit("the "), F.col("p_name"))).alias("agree"))


QUERIES = {f.__name__: f for f in (structure_faults, fault_counts, grade_answers, accuracy_sets, weakness_weights, allocate_budget, grounding_contains, grounding_faults, duplicate_questions, stripped_answers, exports, due_queue, due_per_quiz, review_stats, strength_over_time, scheduled_cards, stepped_cards, conv_summary, history_budget, history_budget_recent, answer_letters)}

_Q = r"""q AS (SELECT *, p_partkey AS qid, p_brand AS unit, ['mcq', 'true_false', 'fill_blank', 'short_answer'][p_partkey % 4 + 1] AS type, CASE WHEN p_partkey % 11 = 0 THEN 'Why?' ELSE 'What is ' || p_type END AS q,
 CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'b) x' ELSE 'B) ' || p_brand END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'True' WHEN p_size % 3 = 0 THEN 'maybe' ELSE 'false' END ELSE CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END END AS answer FROM part),
sf AS (SELECT *, CASE WHEN length(q) < 6 THEN 'question_too_short' WHEN type = 'mcq' AND p_partkey % 5 = 0 THEN 'duplicate_choice_letters' WHEN type = 'true_false' AND lower(answer) NOT IN ('true', 'false') THEN 'invalid_true_false_answer' WHEN type IN ('fill_blank', 'short_answer') AND answer = '' THEN 'empty_answer' END AS fault FROM q)"""
_NS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LW = "list_distinct(list_filter(string_split(" + _NS + ", ' '), lambda w: length(w) > 2))"
_G = _Q + rf""", r AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN 'yes' ELSE 'B) it' END AS given FROM q),
g AS (SELECT *, CASE WHEN p_size < 20 THEN 'easy' ELSE 'hard' END AS difficulty, CASE type WHEN 'mcq' THEN nullif(regexp_extract(given, '^\s*([A-D])\s*[).:]*', 1), '') = nullif(regexp_extract(answer, '^\s*([A-D])\s*[).:]*', 1), '') WHEN 'true_false' THEN CASE WHEN lower(given) IN ('yes') AND lower(answer) IN ('true', 'false') THEN lower(answer) = 'true' END
 WHEN 'fill_blank' THEN CASE WHEN {_NS.format('answer')} <> '' THEN contains({_NS.format('given')}, {_NS.format('answer')}) END
 WHEN 'short_answer' THEN CASE WHEN len({_LW.format('answer')}) > 0 THEN len(list_intersect({_LW.format('answer')}, {_LW.format('given')})) / len({_LW.format('answer')}) >= 0.6::DOUBLE END END AS correct FROM r)"""
_ALLOC = "a{n} AS (SELECT *, greatest(1, floor({n} * w / sum(w) OVER ()))::BIGINT AS f FROM u), b{n} AS (SELECT *, ({n} - sum(f) OVER ())::BIGINT AS res, count(*) OVER () AS k, row_number() OVER (PARTITION BY f > 1 ORDER BY f DESC, unit_no) AS i, row_number() OVER (ORDER BY w DESC, unit_no) AS j FROM a{n}), c{n} AS (SELECT source, CASE WHEN res < 0 THEN f - (f > 1 AND i <= -res)::INT WHEN res > 0 THEN f + res // k + (j <= res % k)::INT ELSE f END::BIGINT AS n FROM b{n})"
_CARDS = f"c AS (SELECT user_id AS card, event_type AS quiz_id, max(floor(epoch(ts))::BIGINT) AS last, count(*) AS reviews, count(*) FILTER (value > 50) AS passes FROM events GROUP BY ALL), cards AS (SELECT *, CASE WHEN card % 9 > 0 THEN last + 86400 * (card % 5) END AS due FROM c)"
_HIST = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations), h AS (SELECT conv_id, turn, sum(least(length(text), 2500) + 40) OVER (PARTITION BY conv_id ORDER BY turn {o} ROWS UNBOUNDED PRECEDING) AS used FROM l WHERE i <= 12) SELECT conv_id, turn, used::BIGINT AS used FROM h WHERE used <= 2000"
_FIRST = r"trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '\s+', ' ', 'g'))"

SQL = {
    "structure_faults": f"WITH {_Q} SELECT qid, fault FROM sf",
    "fault_counts": f"WITH {_Q}, n AS (SELECT unit, fault, count(*) AS n FROM sf WHERE fault IS NOT NULL GROUP BY ALL) SELECT unit, string_agg(fault || '=' || n, ',' ORDER BY fault) AS reasons FROM n GROUP BY unit",
    "grade_answers": f"WITH {_G} SELECT qid, type, correct FROM g",
    "accuracy_sets": f"WITH {_G}, s AS (SELECT CASE WHEN grouping(unit) = 0 THEN 'unit' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'type' END AS \"by\", coalesce(unit, difficulty, type) AS value, count(*) FILTER (correct) AS correct, count(*) AS total FROM g WHERE correct IS NOT NULL GROUP BY GROUPING SETS ((unit), (difficulty), (type))) SELECT *, round(correct / total, 4) AS accuracy, \"by\" = 'unit' AND round(correct / total, 4) < 0.6::DOUBLE AS weak FROM s",
    "weakness_weights": f"WITH {_G}, m AS (SELECT regexp_replace(lower(trim(unit)), '[^a-z0-9]+', '', 'g') AS unit_key, count(*) AS misses FROM g WHERE NOT correct GROUP BY ALL) SELECT unit_key, misses, round(1 + misses / max(misses) OVER (), 6) AS weight FROM m",
    "allocate_budget": f"WITH u AS (SELECT source, regexp_extract(source, '\\d+')::BIGINT AS unit_no, sum(len({WS.format('text')}))::DOUBLE AS w FROM documents GROUP BY source), {_ALLOC.format(n=12)}, {_ALLOC.format(n=107)} SELECT source, c12.n AS few, c107.n AS many FROM c12 JOIN c107 USING (source)",
    "grounding_contains": r"WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x FROM benchmark), t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents) SELECT item_id, count(*) AS docs, min(doc_id) AS first FROM b JOIN t ON contains(t, x) GROUP BY item_id",
    "exports": f"WITH {_Q} SELECT qid, '::q' || qid || ':: ' || q || ' {{' || CASE WHEN upper(left(answer, 1)) = 'A' THEN '=' ELSE '~' END || 'A) ' || p_name || ' ' || CASE WHEN upper(left(answer, 1)) = CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'B' END THEN '=' ELSE '~' END || CASE WHEN p_partkey % 5 = 0 THEN 'A) ' ELSE 'B) ' END || p_brand || '}}' AS line FROM q WHERE type = 'mcq'",
    "due_queue": f"WITH {_CARDS} SELECT quiz_id || ':' || card AS card, due FROM cards WHERE due IS NULL OR due <= {NOW} ORDER BY due NULLS FIRST, 1 LIMIT 50",
    "due_per_quiz": f"WITH {_CARDS} SELECT quiz_id, count(*) AS due FROM cards WHERE due IS NULL OR due <= {NOW} GROUP BY quiz_id",
    "review_stats": f"WITH {_CARDS} SELECT count(*) AS total, count(*) FILTER (due IS NULL OR due <= {NOW}) AS due, count(*) FILTER (reviews = 0) AS new, count(*) FILTER (reviews > 0) AS reviewed, coalesce(round(sum(passes) / sum(reviews), 4), 0) AS retention FROM cards",
    "strength_over_time": "SELECT floor(floor(epoch(ts)) / 86400)::BIGINT AS day, round(avg(value), 6) AS stability, count(*) AS reviews FROM events GROUP BY 1",
    "conv_summary": f"WITH s AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, {_FIRST} AS f, arg_max(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id) SELECT conv_id, messages, last_turn, CASE WHEN length(f) > 42 THEN left(f, 42) || '…' ELSE f END AS title, sha256(a) AS answer_sha FROM s",
    "history_budget": _HIST.format(o=""),
    "history_budget_recent": _HIST.format(o="DESC"),
    "answer_letters": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 5 THEN 'A' END AS answer, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE '' END AS choice, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS truth, 'A) ' || p_name || '|C) ' || p_brand AS labels, true AS agree FROM part",
}
