"""What a message asks for, as expressions over its words: verbs, nouns and numbers by where they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_title

# The words that messages are told by.
OPENINGS = "list show find enumerate browse inventory".split()
LOOSE_OPENINGS = OPENINGS + "display give see what which".split()
OPENING_PAIRS = ("how many", "tell me", "what books", "which books")
WORKS = "book books novel novels work works title titles".split()
CATALOGUE = "books novels works titles library collection".split()
PLACES = ("library", "collection")
ABOUT = "about on regarding concerning covering".split()
BETWEEN = "of all every in my about".split() + WORKS + list(PLACES)
QUIZ_WORDS = "quiz quizzes test tests flashcard flashcards exam exams".split()
QUIZ_PAIRS = ("study guide", "practice questions", "generate questions")
SUMMARY_WORDS = "summarize summary describe overview".split()
SUMMARY_PAIRS = ("with notes",)
COUNTED = "question questions q qs item items card cards mcq mcqs problem problems".split()
REQUESTS = "quiz test ask generate build make create give want".split()
REQUEST_LINKS = "me it on about with for of up to around".split()
NUMBER_LINKS = "of with for".split()
CONFIRMATIONS = "yes|yep|yeah|yup|ok|okay|sure|confirm|go|go ahead|do it|make it now|build|build it|generate|generate it|create|create it|start".split("|")
QUESTION_OPENINGS = "what why how who when where which whose whom does do did is are was were can could should would will explain tell list summarize summarise describe define give show find".split()
LEVELS = {"harder": "hard", "easier": "easy"}
DEPTHS = ("deep", "surface", "balanced")
WORK_WORDS = "summarize summary synopsis overview recap about spoiler review contents chapters compare".split()
SINGLE_WORKS = "book novel series".split()
NO_ANSWERS = ("none", "n/a")
MOST_QUESTIONS, MOST_WORDS = 100, 12


def _words(q: Column) -> Column:
    """Lower-case words; a hyphen or an apostrophe inside belongs to its word."""
    return F.regexp_extract_all(F.lower(q), F.lit(r"[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))


def _one_of(word: Column, words) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def _any(ws: Column, words) -> Column:
    return F.exists(ws, lambda w: w.isin(*words))


def _pair(ws: Column, i) -> Column:
    """The i-th word and the one after it."""
    return F.concat_ws(" ", F.get(ws, F.lit(i - 1) if isinstance(i, int) else i - 1), F.get(ws, F.lit(i) if isinstance(i, int) else i))


def _has_pair(ws: Column, pairs) -> Column:
    text = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    out = F.lit(False)
    for p in pairs:
        out = out | F.contains(text, F.lit(f" {p} "))
    return out


def _opens(ws: Column, singles) -> Column:
    return _one_of(F.get(ws, F.lit(0)), singles) | _one_of(_pair(ws, 1), OPENING_PAIRS)


def _place_of(ws: Column, words) -> Column:
    """Where the first of these words stands, from 1; null if none does."""
    return F.get(F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*words), i + 1)), lambda i: i.isNotNull()), F.lit(0))


def is_quiz(q: Column) -> Column:
    ws = _words(q)
    return _any(ws, QUIZ_WORDS) | _has_pair(ws, QUIZ_PAIRS)


def is_listing(q: Column) -> Column:
    """A request for the catalogue: an opening word, then works or the library; or an opening, nothing but such words, and `about`, `on` or the like.
    Requests for a quiz come first."""
    ws = _words(q)
    pair = _one_of(_pair(ws, 1), OPENING_PAIRS)
    rest = F.slice(ws, F.when(pair, 3).otherwise(2), F.size(ws) + 1)
    # `tell me about` and `what books` open with their second word, too
    rest = F.when(_one_of(F.get(ws, F.lit(1)), WORKS) & pair, F.slice(ws, 2, F.size(ws) + 1)).otherwise(rest)
    at = _place_of(rest, ABOUT)
    before = F.slice(rest, 1, F.coalesce(at, F.lit(1)) - 1)
    direct = _opens(ws, OPENINGS) & at.isNotNull() & F.forall(before, lambda w: w.isin(*BETWEEN) | w.rlike("^[0-9]+$"))
    return ~is_quiz(q) & (direct | (_opens(ws, LOOSE_OPENINGS) & _any(rest, CATALOGUE)))


def wants_summary(q: Column) -> Column:
    ws = _words(q)
    return _any(ws, SUMMARY_WORDS) | _has_pair(ws, SUMMARY_PAIRS)


def topic(q: Column) -> Column:
    """What a listing is about: what stands after the first `about`, `on` or the like, as it is written, less the library it is looked for in and a leading
    `the` or `books`; empty for the whole catalogue."""
    raw = F.filter(F.split(F.regexp_replace(F.trim(q), r"[\s?.!]+$", ""), r"\s+"), lambda w: w != "")
    plain = F.transform(raw, lambda w: F.lower(w))
    at = _place_of(plain, ABOUT)
    words = F.slice(raw, at + 1, F.size(raw) + 1)
    # in (my) library
    inside = F.get(F.filter(F.transform(words, lambda w, i: F.when((F.lower(w) == "in") & (_one_of(F.lower(F.get(words, i + 1)), PLACES) | (_one_of(F.lower(F.get(words, i + 1)), ("my",)) & _one_of(F.lower(F.get(words, i + 2)), PLACES))), i)), lambda i: i.isNotNull()), F.lit(0))
    words = F.slice(words, 1, F.coalesce(inside, F.size(words)))
    for lead in ("all every some any the".split(), WORKS):
        words = F.when(_one_of(F.lower(F.get(words, F.lit(0))), lead) & (F.size(words) > 1), F.slice(words, 2, F.size(words))).otherwise(words)
    return F.coalesce(F.when(at.isNotNull() & (F.size(raw) > at), F.array_join(words, " ")), F.lit(""))


def kind(q: Column) -> Column:
    ws = _words(q)
    non = _any(ws, ("nonfiction", "non-fiction")) | _has_pair(ws, ("non fiction",))
    return F.when(non, "nonfiction").when(_any(ws, ("fiction",)), "fiction")


def count(q: Column, otherwise: int) -> Column:
    """A number of questions, from 1 to MOST_QUESTIONS: one before a word for questions, else one that a request leads to, else one after `of`, `with` or `for`."""
    ws = _words(q)
    number = F.transform(ws, lambda w: F.when(w.rlike("^[0-9]{1,3}$"), w.cast("int")))

    def first(holds) -> Column:
        hit = F.transform(ws, lambda w, i: F.when(F.get(number, i).between(1, MOST_QUESTIONS) & holds(i), F.get(number, i)))
        return F.get(F.filter(hit, lambda n: n.isNotNull()), F.lit(0))

    def leads(i) -> Column:
        before = F.filter(F.slice(ws, 1, i), lambda w: ~w.isin(*REQUEST_LINKS))
        return _one_of(F.get(before, F.size(before) - 1), REQUESTS)

    return F.coalesce(first(lambda i: _one_of(F.get(ws, i + 1), COUNTED)), first(leads), first(lambda i: _one_of(F.get(ws, i - 1), NUMBER_LINKS)), F.lit(otherwise))


def is_question(q: Column) -> Column:
    return F.endswith(F.trim(q), F.lit("?")) | _one_of(F.get(_words(q), F.lit(0)), QUESTION_OPENINGS)


def reply(q: Column) -> Column:
    """What a message does to a pending plan: confirm, or a change of count, difficulty or depth; null if it does nothing to it. Questions and long
    messages do nothing."""
    ws = _words(q)
    bare = F.array_join(F.filter(ws, lambda w: w != "please"), " ")
    confirms = _one_of(bare, CONFIRMATIONS) & (F.size(ws) > 0)
    numbered = F.transform(ws, lambda w, i: F.when(w.rlike("^[0-9]+$") & _one_of(F.get(ws, i + 1), ("question", "questions", "q")), w.cast("int")))
    n = F.when(~F.exists(ws, lambda w: F.startswith(w, F.lit("unit"))), F.get(F.filter(numbered, lambda x: x.isNotNull()), F.lit(0)))
    level = F.get(F.filter(ws, lambda w: w.isin(*LEVELS)), F.lit(0))
    difficulty = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[level]
    depth = F.get(F.filter(ws, lambda w: w.isin(*DEPTHS)), F.lit(0))
    changes = (F.size(ws) <= MOST_WORDS) & (n.isNotNull() | difficulty.isNotNull() | depth.isNotNull())
    out = F.struct(confirms.alias("confirm"), F.when(~confirms, n).alias("count"), F.when(~confirms, difficulty).alias("difficulty"), F.when(~confirms, depth).alias("depth"))
    return F.when(~is_question(q) & (confirms | changes), out)


def is_about_a_work(q: Column) -> Column:
    """A word for a summary or the like, or an end such as `the green book`."""
    ends = rf"(?U)\b(the|this)\s+\w+\s+({'|'.join(SINGLE_WORKS)})$"
    return _any(F.split(norm_title(q), " "), WORK_WORDS) | F.lower(q).rlike(ends)


def sub_queries(text: Column, most: int = 3) -> Column:
    """The first lines of an answer that are queries, without list marks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"""^[^\p{L}\p{N}]*(?:[0-9]+[^\p{L}\p{N}]+)?""", "")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NO_ANSWERS)), 1, most)


def source_titles(material: Column) -> Column:
    """Titles in the source headers of a context (`--- Source 1: title (file) [KIND], p.3 ---`), each once."""
    heads = F.transform(F.filter(F.split(material, "\n"), lambda x: x.rlike(r"^---\s*Source\s+[0-9]+:.*---")), lambda x: F.regexp_replace(F.regexp_replace(x, r"^---\s*Source\s+[0-9]+:\s*", ""), r"\s*---.*$", ""))
    bare = F.transform(heads, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r",\s*p\.[0-9]+\s*$", ""), r"\s*\[[A-Z-]+\]\s*$", ""), r"\s*\([^()]*\)\s*$", "")))
    return F.array_distinct(F.filter(bare, lambda t: (t != "") & (F.lower(t) != "unknown")))


def host_allowed(url: Column, hosts: tuple = ("localhost", "127.0.0.1", "::1")) -> Column:
    """Whether a host header or an origin names one of these hosts; the port doesn't matter."""
    bare = F.lower(F.trim(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")))
    bare = F.regexp_replace(bare, "[/?#].*$", "")
    name = F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).when(F.size(F.split(bare, ":")) > 2, bare).otherwise(F.regexp_replace(bare, ":[0-9]*$", ""))
    return _one_of(name, hosts)
