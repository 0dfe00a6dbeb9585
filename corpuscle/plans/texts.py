"""Queries over texts: tokens, chunks, headings, pages, kinds, manifest states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, index, manifest, marks, scopes
from ..session import table

WS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _docs(spark, d):
    return table(spark, d, "documents")


def tokenize_docs(spark, d):
    ts = X.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_distinct"), F.array_join(F.slice(ts, 1, 5), " ").alias("head"))


def term_frequency(spark, d):
    return index.term_frequency(_docs(spark, d))


def doc_frequency(spark, d):
    return index.doc_frequency(index.term_frequency(_docs(spark, d)))


def corpus_stats(spark, d):
    s = index.Statistics(_docs(spark, d))
    return s.idf().agg(F.lit(s.docs).cast("long").alias("n_docs"), F.round(F.lit(s.average), 6).alias("avg_len"), F.count("*").alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))


def common_terms(spark, d):
    s = index.Statistics(_docs(spark, d))
    return index.common_terms(s.frequencies, s.docs)


def flat_chunks(spark, d):
    return chunks.flat_chunks(_docs(spark, d)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), F.sha2("document", 256).alias("document_sha"), "chunk_id", X.word_count(F.col("document")).alias("n_words"))


def chunk_metadata(spark, d):
    docs = _docs(spark, d)
    meta = docs.select("doc_id", F.col("source").alias("title"), X.kind_of(F.array("lang", "source")).alias("kind"), "lang")
    got = chunks.flat_chunks(docs).join(meta, "doc_id")
    return got.groupBy("title", "kind", "lang").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum(X.word_count(F.col("document"))).alias("words"))


def line_offsets(spark, d):
    x = chunks.lines_with_offsets(_docs(spark, d))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start_char", F.length("line").cast("long").alias("n_chars"))


def heading_lines(spark, d):
    x = chunks.lines_with_offsets(_docs(spark, d)).where(X.is_heading(F.col("line")))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("title"))


def repeated_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("doc_id", F.trim("line").alias("line")).agg(F.count("*").alias("times")).where("times >= 4")


def section_map(spark, d):
    docs = _docs(spark, d)
    x = chunks.normal_sections(chunks.detect_sections(docs), docs.select("doc_id", F.length("text").cast("long").alias("total")))
    return x.select("doc_id", "title", F.col("ordinal").cast("long").alias("ordinal"), "start_char", "end_char")


def _pages_and_marks(spark, d):
    """Every line of a document as a page, and bookmarks: one for every third page, a second one on some of them, and one of a page that isn't there."""
    docs = _docs(spark, d)
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    mine = pages.where("page % 3 = 0").select("doc_id", (F.col("page") * 2).alias("seq"), (F.col("page") % 4 + 1).alias("level"), F.col("text").alias("title"), "page")
    twice = pages.where("page % 6 = 0").select("doc_id", (F.col("page") * 2 + 1).alias("seq"), F.lit(1).alias("level"), F.lit("Again").alias("title"), "page")
    gone = docs.select("doc_id", F.lit(0).alias("seq"), F.lit(1).alias("level"), F.lit("Gone").alias("title"), F.lit(0).alias("page"))
    return marks.page_offsets(pages), mine.unionByName(twice).unionByName(gone)


def bookmark_sections(spark, d):
    pages, own = _pages_and_marks(spark, d)
    return marks.marked_sections(own, pages).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("title", 256).alias("title_sha"), "level", "parent", "start_char", "end_char")


def pages_in_sections(spark, d):
    """The section that holds each page, found by its last character."""
    pages, own = _pages_and_marks(spark, d)
    at = pages.withColumn("last_char", F.greatest(F.col("end_char") - 1, F.col("start_char")))
    return marks.sections_at(at, marks.marked_sections(own, pages), at="last_char").select("doc_id", "page", "section")


def html_text(spark, d):
    t = X.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.size(F.split(t, "\n\n")).cast("long").alias("n_paragraphs"), F.sha2(t, 256).alias("text_sha"))


def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(X.html_headings(F.col("html"))).alias("i", "heading")).select("page_id", F.col("i").cast("long").alias("i"), "heading")


def sentence_counts(spark, d):
    s = X.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.element_at(s, 1).alias("first"))


def parent_child_chunks(spark, d):
    x = chunks.recursive_chunks(_docs(spark, d))
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), X.word_count(F.col("document")).alias("n_words"), F.sha2("document", 256).alias("document_sha"))


def parent_text(spark, d):
    docs = _docs(spark, d)
    whole = chunks.normal_sections(chunks.detect_sections(docs), docs.select("doc_id", F.length("text").cast("long").alias("total")))
    return chunks.parents(docs, whole).select("doc_id", "parent_id", "section_title", F.col("ordinal").cast("long").alias("ordinal"), X.word_count(F.col("text")).alias("n_words"))


def garbage_ratio(spark, d):
    g = X.garbage(F.col("text"))
    return _docs(spark, d).select("doc_id", F.round(g, 6).alias("garbage"), F.round(X.recognition_score(F.lit(0.9), g), 6).alias("score"))


def classify_kind(spark, d):
    return _docs(spark, d).select("doc_id", X.kind_of(F.array("lang", "source")).alias("kind"), X.normal_kind(F.concat(F.lit(" "), F.upper("lang"))).alias("normal"))


def scan_stats(spark, d):
    kind = X.kind_of(F.array("lang", "source"))
    return _docs(spark, d).groupBy(F.col("source").alias("ext")).agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(X.needs_ocr(F.col("text"))).alias("ocr_needed"), F.count_if(X.has_text_layer(F.col("text"))).alias("with_text"), F.count_if(kind == "fiction").alias("fiction")
    )


def ocr_needed(spark, d):
    return _docs(spark, d).where(X.needs_ocr(F.col("text"))).select("doc_id", F.length(F.trim("text")).cast("long").alias("n_chars"))


def junk_chunks(spark, d):
    return chunks.flat_chunks(_docs(spark, d)).groupBy(X.is_junk(F.col("document")).alias("junk")).agg(F.count("*").alias("chunks"))


def sampled_passages(spark, d):
    """Chunks of each source, evenly spread."""
    docs = _docs(spark, d)
    c = chunks.flat_chunks(docs).join(docs.select("doc_id", F.col("source").alias("work")), "doc_id")
    x = scopes.sampled_chunks(c.withColumn("place", F.struct("doc_id", "chunk_index")), 20)
    return x.select("work", "chunk_id", F.col("pos").cast("long").alias("pos"), F.sha2("document", 256).alias("document_sha"))


def normalised_titles(spark, d):
    n = F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("'s"))
    return table(spark, d, "part").select("p_partkey", X.norm_spaced(n).alias("spaced"), X.norm_title(n).alias("title"), X.title_key(n).alias("key"), X.collapsed(n).alias("collapsed"), X.slug(n).alias("slug"), X.safe_name(n).alias("safe"), X.without_possessive(n).alias("word"), X.markdown_cell(F.replace(n, F.lit("/"), F.lit("|"))).alias("cell"), X.gift_escaped(F.concat(F.lit("{"), n, F.lit("}"))).alias("gift"), X.is_store_id(F.substring(F.sha2(n, 256), 1, 12)).alias("is_id"))


def change_detect(spark, d):
    docs = _docs(spark, d)
    scan = docs.select(F.col("doc_id").alias("rel_path"), F.col("doc_id").cast("double").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
    # an older manifest: a third is missing, some times moved on, some texts had another size
    old = docs.where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("rel_path"), (F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("double").alias("mtime"), (F.octet_length("text") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("size"), F.sha2("text", 256).alias("content_hash")
    )
    return manifest.change_state(scan, old)


def stale_files(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("rel_path"), "source")
    return manifest.stale(docs, docs.where("rel_path % 3 <> 0"))


def upsert_rows(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 2 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), F.lit("new").alias("source"), "n_chars")
    return manifest.deleted_where(manifest.upserted(docs, new, ["doc_id"]), docs.where("source = 'src3'"), ["source"])


def rename_set(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", (F.col("doc_id") % 50).alias("rel_path"), F.when(F.col("lang") == "fr", "old").when(F.col("lang") == "de", "new").otherwise("other").alias("set_name"))
    return manifest.renamed_set(docs, "old", "new", ["rel_path"]).select("doc_id", "set_name")


def calibre_tags(spark, d):
    part, line, supp = (table(spark, d, t) for t in ("part", "lineitem", "supplier"))
    books = part.select(F.col("p_partkey").alias("book"), F.col("p_name").alias("title"))
    links = line.select(F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("tag"))
    tags = supp.select(F.col("s_suppkey").alias("tag"), F.col("s_name").alias("name"))
    return manifest.with_tags(books, links, tags).select("book", "title", F.array_join("tags", "|||").alias("tags"))


def tag_lists(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("lang", "source"))).when(F.col("doc_id") % 3 == 1, F.concat_ws(", ", "lang", "source", F.lit(" "))).otherwise(F.concat(F.lit('"'), F.col("lang"), F.lit('"')))
    return _docs(spark, d).select("doc_id", F.array_join(X.tags_of(raw), ";").alias("tags"))


def clamped_fields(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "x1").when(F.col("event_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", X.clamped_int(raw, 8, 1, 50).alias("top_k"))


def exact_texts(spark, d):
    return _docs(spark, d).groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def section_words(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.count("*").alias("sections"))


QUERIES = {f.__name__: f for f in (sampled_passages, bookmark_sections, pages_in_sections, tokenize_docs, term_frequency, doc_frequency, corpus_stats, common_terms, flat_chunks, chunk_metadata, line_offsets, heading_lines, repeated_lines, section_map, html_text, html_headings, sentence_counts, parent_child_chunks, parent_text, garbage_ratio, classify_kind, scan_stats, ocr_needed, junk_chunks, normalised_titles, change_detect, stale_files, upsert_rows, rename_set, calibre_tags, tag_lists, clamped_fields, exact_texts, section_words)}

_TF = f"tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS token FROM documents) GROUP BY ALL), lens AS (SELECT doc_id, len({TOK.format('text')}) AS len FROM documents WHERE len({TOK.format('text')}) > 0), nd AS (SELECT count(*) AS n, avg(len) AS al FROM lens), df AS (SELECT token, count(*) AS doc_freq FROM tf GROUP BY token), raw AS (SELECT token, doc_freq, ln(n - doc_freq + 0.5) - ln(doc_freq + 0.5) AS raw FROM df, nd), idf AS (SELECT token, doc_freq, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"
_CHUNKS = f"w AS (SELECT *, {WS.format('text')} AS ws FROM documents), chunks AS (SELECT *, array_to_string(ws[s + 1 : s + 330], ' ') AS document, s // 270 AS chunk_index, ((len(ws) - 1) // 270) + 1 AS total_chunks FROM w, unnest(range(0, len(ws), 270)) AS t(s))"
_LINES = "ls AS (SELECT doc_id, string_split(text, chr(10)) AS l, length(text) AS total FROM documents), lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line, total, coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start_char FROM ls, unnest(range(1, len(l) + 1)) AS t(i))"
_HEAD = r"""(length(trim(line)) BETWEEN 1 AND 100 AND (regexp_matches(trim(line), '(?i)^(?:chapter|chap\.?|part|section|appendix)\s+[\dIVXLC]+\b[.:—–-]?\s*.{0,90}$') OR regexp_matches(trim(line), '^\d{1,2}(?:\.\d{1,2}){0,3}[.:)]?\s+\S.{0,90}$') OR regexp_matches(trim(line), '^#{1,6}\s+\S.{0,90}$')
 OR (length(trim(line)) >= 8 AND length(regexp_replace(trim(line), '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(trim(line), '[^\p{Lu}]', '', 'g')) >= 0.9 * length(regexp_replace(trim(line), '[^\p{L}]', '', 'g')))))"""
_KIND = "CASE WHEN lower(lang) IN ('fr', 'es') OR lower(source) IN ('fr', 'es') THEN 'fiction' ELSE 'nonfiction' END"
_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', '', 'g'), '(?is)</?(?:p|div|br|h[1-6]|li|tr|section|article|blockquote)(?:\s[^>]*)?/?>', chr(10) || chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_PARAS = rf"list_filter(list_transform(regexp_split_to_array({_HTML}, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '')"
_NAME = "(p_name || ' / ' || p_brand || '''s')"
_CLEAN = "".join("\\" + c if c in "[]\\^-&" else c for c in X.CLEAN_SIGNS).replace("'", "''")

_MARKS = r"""pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
po AS (SELECT doc_id, page, text, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS a FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mk AS (SELECT doc_id, page * 2 AS seq, page % 4 + 1 AS level, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) AS title, page FROM pg WHERE page % 3 = 0 UNION ALL SELECT doc_id, page * 2 + 1, 1, 'Again', page FROM pg WHERE page % 6 = 0),
mo AS (SELECT mk.*, a, count(*) OVER (PARTITION BY doc_id) AS n FROM mk JOIN po USING (doc_id, page) WHERE title <> ''),
m1 AS (SELECT * FROM mo WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY seq) = 1),
tot AS (SELECT doc_id, max(a + length(text)) AS total FROM po GROUP BY doc_id),
sx AS (SELECT doc_id, row_number() OVER w - 1 AS ordinal, title, level, a, coalesce(lead(a) OVER w, total) AS z FROM m1 JOIN tot USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a))"""

SQL = {
    "sampled_passages": f"WITH {_CHUNKS}, g AS (SELECT source AS work, doc_id, chunk_index, trim(document) AS document FROM chunks WHERE NOT regexp_matches(lower(document), 'isbn|bf575|to my wife|contents') AND len({WS.format('document')}) >= 30), x AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY doc_id, chunk_index) - 1 AS pos, count(*) OVER (PARTITION BY work) AS n FROM g), y AS (SELECT * FROM x WHERE pos % greatest(1, n // 20) = 0), z AS (SELECT *, row_number() OVER (PARTITION BY work, left(document, 200) ORDER BY pos) AS i FROM y), o AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY pos) AS j FROM z WHERE i = 1) SELECT work, substr(sha256(doc_id || ':' || chunk_index), 1, 16) AS chunk_id, pos, sha256(document) AS document_sha FROM o WHERE j <= 20",
    "bookmark_sections": f"WITH {_MARKS} SELECT s.doc_id, s.ordinal, sha256(s.title) AS title_sha, s.level, (SELECT max(t.ordinal) FROM sx t WHERE t.doc_id = s.doc_id AND t.ordinal < s.ordinal AND t.level < s.level) AS parent, s.a AS start_char, s.z AS end_char FROM sx s",
    "pages_in_sections": f"WITH {_MARKS} SELECT po.doc_id, po.page, (SELECT max(ordinal) FROM sx WHERE sx.doc_id = po.doc_id AND sx.a <= greatest(po.a + length(po.text) - 1, po.a)) AS section FROM po",
    "tokenize_docs": f"SELECT doc_id, len({TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOK.format('text')}))::BIGINT AS n_distinct, array_to_string({TOK.format('text')}[1:5], ' ') AS head FROM documents",
    "term_frequency": f"WITH {_TF} SELECT * FROM tf",
    "doc_frequency": f"WITH {_TF} SELECT * FROM df",
    "corpus_stats": f"WITH {_TF} SELECT (SELECT n FROM nd) AS n_docs, round((SELECT al FROM nd), 6) AS avg_len, count(*) AS n_terms, round(avg(idf), 6) AS mean_idf FROM idf",
    "common_terms": f"WITH {_TF} SELECT token, doc_freq FROM df, nd WHERE doc_freq / n >= 0.01",
    "flat_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, total_chunks, sha256(document) AS document_sha, substr(sha256(doc_id || ':' || chunk_index), 1, 16) AS chunk_id, len({WS.format('document')})::BIGINT AS n_words FROM chunks",
    "chunk_metadata": f"WITH {_CHUNKS} SELECT source AS title, {_KIND} AS kind, lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs, sum(len({WS.format('document')}))::BIGINT AS words FROM chunks GROUP BY ALL",
    "line_offsets": f"WITH {_LINES} SELECT doc_id, line_no, start_char, length(line) AS n_chars FROM lines",
    "heading_lines": f"WITH {_LINES} SELECT doc_id, line_no, trim(line) AS title FROM lines WHERE {_HEAD}",
    "repeated_lines": f"WITH {_LINES} SELECT doc_id, trim(line) AS line, count(*) AS times FROM lines WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) >= 4",
    "section_map": f"""WITH {_LINES}, m AS (SELECT *, trim(line) AS title, count(*) OVER (PARTITION BY doc_id, trim(line)) AS times FROM lines WHERE {_HEAD}), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS marks FROM m WHERE times < 4),
s AS (SELECT doc_id, title, start_char, total FROM k WHERE marks >= 3 AND start_char < total), f AS (SELECT * FROM s UNION ALL SELECT doc_id, '', 0, any_value(total) FROM s GROUP BY doc_id HAVING min(start_char) > 0
 UNION ALL SELECT doc_id, '', 0, length(text) FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id, title, row_number() OVER w - 1 AS ordinal, start_char, coalesce(lead(start_char) OVER w, total)::BIGINT AS end_char FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start_char)""",
    "html_text": f"WITH p AS (SELECT page_id, {_PARAS} AS ps FROM pages), t AS (SELECT page_id, array_to_string(ps, chr(10) || chr(10)) AS t FROM p) SELECT page_id, length(t) AS n_chars, len(string_split(t, chr(10) || chr(10)))::BIGINT AS n_paragraphs, sha256(t) AS text_sha FROM t",
    "html_headings": r"WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages) SELECT page_id, i - 1 AS i, trim(regexp_replace(regexp_replace(h[i], '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS heading FROM h, unnest(range(1, len(h) + 1)) AS t(i)",
    "garbage_ratio": rf"""WITH w AS (SELECT doc_id, text, {WS.format('text')} AS ws FROM documents), g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN 1.0 ELSE least(1.0, 0.7::DOUBLE * len(list_filter(ws[1:800], lambda x: length(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')) < 0.6 * length(x)
 OR (regexp_full_match(x, '\p{{L}}+') AND ((length(x) = 1 AND lower(x) NOT IN ('a', 'i')) OR (length(x) >= 2 AND NOT regexp_matches(lower(x), '[aeiouy]')))))) / len(ws) + 0.3::DOUBLE * len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s{_CLEAN}]')) / greatest(length(text), 1)) END AS g FROM w)
SELECT doc_id, round(g, 6) AS garbage, round(0.6::DOUBLE * 0.9::DOUBLE + 0.4::DOUBLE * (1 - g), 6) AS score FROM g""",
    "classify_kind": f"SELECT doc_id, {_KIND} AS kind, NULL::VARCHAR AS normal FROM documents",
    "scan_stats": f"SELECT source AS ext, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (length(trim(text)) < 50) AS ocr_needed, count(*) FILTER (length(trim(text)) > 50) AS with_text, count(*) FILTER ({_KIND} = 'fiction') AS fiction FROM documents GROUP BY source",
    "ocr_needed": "SELECT doc_id, length(trim(text)) AS n_chars FROM documents WHERE length(trim(text)) < 50",
    "junk_chunks": f"WITH {_CHUNKS} SELECT lower(document) LIKE '%isbn%' OR lower(document) LIKE '%bf575%' OR lower(document) LIKE '%to my wife%' OR lower(document) LIKE '%contents%' OR len({WS.format('document')}) < 30 AS junk, count(*) AS chunks FROM chunks GROUP BY ALL",
    "normalised_titles": rf"""WITH n AS (SELECT p_partkey, {_NAME} AS n FROM part) SELECT p_partkey, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS spaced, trim(regexp_replace(lower(n), '[^a-z0-9 ]', ' ', 'g')) AS title, regexp_replace(lower(trim(n)), '[^a-z0-9]+', '', 'g') AS key, lower(trim(regexp_replace(n, '\s+', ' ', 'g'))) AS collapsed,
 trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(n, '[^\p{{L}}\p{{N}}._-]', '_', 'g') AS safe, regexp_replace(lower(n), '''s$', '') AS word, replace(replace(n, '/', '|'), '|', '\|') AS cell, '\{{' || n || '\}}' AS gift, true AS is_id FROM n""",
    "change_detect": "SELECT doc_id AS rel_path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'current' WHEN doc_id % 7 <> 0 THEN 'touched' ELSE 'changed' END AS state FROM documents",
    "stale_files": "SELECT doc_id AS rel_path, source FROM documents WHERE doc_id % 3 = 0",
    "upsert_rows": "WITH n AS (SELECT doc_id + 1000 AS doc_id, 'new' AS source, n_chars FROM documents WHERE doc_id % 2 = 0) SELECT * FROM (SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) WHERE source <> 'src3'",
    "rename_set": "WITH s AS (SELECT doc_id, doc_id % 50 AS rel_path, CASE lang WHEN 'fr' THEN 'old' WHEN 'de' THEN 'new' ELSE 'other' END AS set_name FROM documents) SELECT doc_id, CASE set_name WHEN 'old' THEN 'new' ELSE set_name END AS set_name FROM s WHERE set_name <> 'new' OR rel_path NOT IN (SELECT rel_path FROM s WHERE set_name = 'old')",
    "calibre_tags": "SELECT p_partkey AS book, any_value(p_name) AS title, coalesce(string_agg(DISTINCT s_name, '|||' ORDER BY s_name), '') AS tags FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey",
    "tag_lists": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang || ';' || source ELSE lang END AS tags FROM documents",
    "clamped_fields": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 8 ELSE least(greatest(user_id, 1), 50) END::INT AS top_k FROM events",
    "exact_texts": "SELECT sha256(text) AS text_sha, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "section_words": f"SELECT source, sum(len({WS.format('text')}))::BIGINT AS words, count(*) AS sections FROM documents GROUP BY source",
}
