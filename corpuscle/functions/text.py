"""Scalar text expressions. All are built-in column expressions, so they stay inside generated code."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings of chunks that are front matter, and the least words of a usable chunk.
JUNK_MARKS = ("isbn", "bf575", "to my wife", "contents")
JUNK_WORDS = 30
# Forms of heading lines (named, numbered, marked), their greatest length, and the share of capitals of a line in capitals.
HEADING_FORMS = (
    r"(?i)^(?:chapter|chap\.?|part|section|appendix)\s+[\dIVXLC]+\b[.:—–-]?\s*.{0,90}$",
    r"^\d{1,2}(?:\.\d{1,2}){0,3}[.:)]?\s+\S.{0,90}$",
    r"^#{1,6}\s+\S.{0,90}$",
)
HEADING_LONGEST, HEADING_UPPER, HEADING_LEAST = 100, 0.9, 8
# Punctuation that clean text may hold.
CLEAN_SIGNS = ".,;:!?'\"-—–()[]{}/*\\%$&+=<>@#|~_`^€£¥°¿¡ªº®™"
# Words too common to tell works apart.
TERM_STOP = "the a an and or of to in on for with by from at as is are be was were it its his her they we you your my their who what which when where how why this that these those not no can could would should will just about".split()
FICTION_TAGS = ("FR", "ES")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def norm_spaced(text: Column) -> Column:
    """Lower case; runs of anything else than letters and digits are one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_title(text: Column) -> Column:
    """Lower case; every other character is a blank, inner runs stay."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def title_key(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")


def collapsed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text: Column, otherwise: str = "work") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(otherwise))


def safe_name(text: Column) -> Column:
    """A file name of letters, digits and - _ . only; a name of dots only becomes a fixed one."""
    s = F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")
    return F.when(s.rlike(r"^\.*$"), F.lit("_")).otherwise(s)


def without_possessive(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "'s$", "")


def is_store_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{12}$"), F.lit(False))


def kind_of(tags: Column, fiction=FICTION_TAGS) -> Column:
    """fiction if a tag equals a fiction tag, whatever the case."""
    has = F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(t.lower()) for t in fiction]))
    return F.when(has, "fiction").otherwise("nonfiction")


def normal_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin("fiction", "nonfiction"), k)


def is_junk(text: Column) -> Column:
    marks = F.lit(False)
    for m in JUNK_MARKS:
        marks = marks | F.contains(F.lower(text), F.lit(m))
    return marks | (word_count(text) < JUNK_WORDS)


def needs_ocr(text: Column, least: int = 50) -> Column:
    """Ingestion: under `least` characters of text."""
    return F.length(F.trim(text)) < least


def has_text_layer(text: Column, most: int = 50) -> Column:
    """Scanning: over `most` characters; exactly 50 is neither this nor needs_ocr."""
    return F.length(F.trim(text)) > most


def is_heading(line: Column) -> Column:
    s = F.trim(line)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    known = F.lit(False)
    for form in HEADING_FORMS:
        known = known | s.rlike(form)
    shout = (F.length(s) >= HEADING_LEAST) & (letters > 0) & (upper >= HEADING_UPPER * letters)
    return (F.length(s) > 0) & (F.length(s) <= HEADING_LONGEST) & (known | shout)


#: Named references of HTML that stand for one character, from the standard library's table; the few with very long names stay as they are.
REFERENCES = {n[:-1]: c for n, c in html5.items() if n.endswith(";") and len(c) == 1 and len(n) <= 8}


def decoded(text: Column) -> Column:
    """Character references, each decoded once: the text between ampersands is taken apart, so what a reference stands for begins no other one."""
    table = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")

    def one(part, i):
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);", 1)
        number = F.when(F.startswith(name, F.lit("#x")) | F.startswith(name, F.lit("#X")), F.conv(F.substring(name, 3, 8), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 9)).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(valid, _character(number)).when(F.startswith(name, F.lit("#")), F.lit("\ufffd")).otherwise(F.try_element_at(table, name))
        return F.when(i == 0, part).when((name != "") & sign.isNotNull(), F.concat(sign, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def _character(point: Column) -> Column:
    """The character of a code point, by its bytes in UTF-8."""
    def byte(x):
        return F.lpad(F.hex(x.cast("long")), 2, "0")

    six = lambda k: F.lit(128) + F.shiftright(point, k).bitwiseAND(F.lit(63))
    data = (
        F.when(point < 0x80, byte(point))
        .when(point < 0x800, F.concat(byte(F.lit(192) + F.shiftright(point, 6)), byte(six(0))))
        .when(point < 0x10000, F.concat(byte(F.lit(224) + F.shiftright(point, 12)), byte(six(6)), byte(six(0))))
        .otherwise(F.concat(byte(F.lit(240) + F.shiftright(point, 18)), byte(six(12)), byte(six(6)), byte(six(0))))
    )
    return F.decode(F.unhex(data), "UTF-8")


def html_text(html: Column) -> Column:
    """Paragraphs of a page, separated by blank lines: block tags end a paragraph, other tags vanish, references are decoded."""
    s = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", "")
    s = F.regexp_replace(s, r"(?is)</?(?:p|div|br|h[1-6]|li|tr|section|article|blockquote)(?:\s[^>]*)?/?>", "\n\n")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", "")
    s = decoded(s)
    parts = F.transform(F.split(s, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def html_headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"(?s)<[^>]*>", ""), r"\s+", " ")))


def sentences(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"""(?<=[.!?])\s+(?=["'‘“A-Z0-9])"""), lambda s: F.trim(s) != "")


def garbage(text: Column) -> Column:
    """How much of a text looks like recognition noise: 0.7 for poor tokens among the first 800 over all tokens (mostly signs, single letters,
    no vowel), 0.3 for characters that clean text doesn't hold."""
    ws = words(text)
    signs = "".join("\\" + c if c in "[]\\^-&" else c for c in CLEAN_SIGNS)
    odd = F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{N}}\s{signs}]"))

    def poor(w: Column) -> Column:
        signs_mostly = F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")) < 0.6 * F.length(w)
        lone = (F.length(w) == 1) & ~F.lower(w).isin("a", "i")
        dry = (F.length(w) >= 2) & ~F.lower(w).rlike("[aeiouy]")
        return signs_mostly | (w.rlike(r"^\p{L}+$") & (lone | dry))

    junk = 0.7 * F.size(F.filter(F.slice(ws, 1, 800), poor)) / F.greatest(F.size(ws), F.lit(1))
    return F.when(F.size(ws) == 0, 1.0).otherwise(F.least(F.lit(1.0), junk + 0.3 * odd / F.greatest(F.length(text), F.lit(1))))


def recognition_score(confidence: Column, garbage_ratio: Column) -> Column:
    return 0.6 * confidence + 0.4 * (1 - garbage_ratio)


def tags_of(raw: Column) -> Column:
    """Tags from a JSON list, a JSON string or comma-separated text."""
    listed = F.from_json(raw, "array<string>")
    one = F.when(raw.rlike(r'^\s*".*"\s*$'), F.array(F.regexp_replace(raw, r'^\s*"|"\s*$', "")))
    plain = F.when(~raw.rlike(r"^\s*\["), F.split(raw, ","))
    found = F.coalesce(F.when(raw.rlike(r"^\s*\["), listed), one, plain, F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def gift_escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([{}\\])", r"\\$1")


def answer_letter(text: Column) -> Column:
    """The capital A to D that an answer begins with; a small letter is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([A-D])\s*[).:]*", 1), F.lit(""))


def choice_letter(text: Column) -> Column:
    """The letter of a choice, whatever its case: alone, or before one of ). and a colon."""
    return F.regexp_extract(F.upper(F.trim(text)), r"^([A-D])(?:\s*[).:]|$)", 1)


def with_letters(choices: Column) -> Column:
    """Choices that have no letter get one by their place; empty ones go."""
    def one(c, i):
        c = F.trim(c)
        return F.when(c.rlike(r"^[A-D]\s*[).:]") | (i >= 8), c).otherwise(F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), c))

    return F.transform(F.filter(F.transform(choices, lambda c, i: F.struct(F.trim(c).alias("c"), i.alias("i"))), lambda x: x["c"] != ""), lambda x: one(x["c"], x["i"]))


def truth(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "t", "yes", "y", "1"), F.lit(True)).when(t.isin("false", "f", "no", "n", "0"), F.lit(False))


def clamped_int(raw: Column, otherwise: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(raw.try_cast("int"), F.lit(otherwise)), F.lit(low)), F.lit(high))


def trimmed_words(text: Column, most: int) -> Column:
    """At most so many words, with a mark where something was cut."""
    ws = words(text)
    return F.when(F.size(ws) > most, F.concat(F.array_join(F.slice(ws, 1, most), " "), F.lit(" …[truncated]"))).otherwise(F.array_join(ws, " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def chunk_id(rel: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rel.cast("string"), index.cast("string")), 256), 1, 16)


def parent_id(rel: Column, ordinal: Column) -> Column:
    return F.substring(F.sha2(F.concat(rel.cast("string"), F.lit(":section"), ordinal.cast("string")), 256), 1, 16)


def titles_agree(a: Column, b: Column) -> Column:
    """Equal, one within the other, or two words in common."""
    x, y = norm_spaced(a), norm_spaced(b)

    def long_words(t):
        return F.filter(F.split(t, " "), lambda w: F.length(w) > 1)

    shared = F.size(F.array_intersect(long_words(x), long_words(y)))
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x) | (shared >= 2)


def truth_or_letter(kind: Column, text: Column) -> Column:
    return F.when(kind == "true_false", truth(text).cast("string")).otherwise(answer_letter(text))


def remaining_time(done: Column, total: Column, seconds: Column) -> Column:
    """Minutes and seconds that are left at the rate so far, as mm:ss; null before anything is done."""
    left = F.when(done > 0, F.round((total - done) * seconds / done).cast("long"))
    return F.when(left.isNotNull(), F.format_string("%02d:%02d", F.floor(left / 60), left % 60))
