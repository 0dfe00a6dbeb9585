"""Queries over retrieval: BM25, neighbours, fusion, diversification, budgets, titles, catalogue, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as X
from ..operators import best, chunks, evaluation, index, library, postings, rank, study
from ..session import register, stored, table, work_path
from .texts import _CHUNKS, _KIND, _TF, TOK, WS


def _docs(spark, d):
    return table(spark, d, "documents")


def _asks(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, d):
    s = best.bm25_top(_docs(spark, d), _asks(spark, d), 10)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_zero_fill(spark, d):
    docs = _docs(spark, d)
    asks = _asks(spark, d)
    s = index.zero_filled(best.bm25_top(docs, asks, 25), docs, asks, 25)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_per_title(spark, d):
    s = best.bm25_sums(_docs(spark, d).select(F.col("source").alias("title"), "text"), _asks(spark, d))
    return library.bm25_leg(s).select("query_id", "title", F.round("score", 4).alias("score"), "rank")


def _changed_store(spark, d):
    """An index of all documents after two batches of changes: texts are changed, documents go, get other ids and come back, and every benchmark item becomes a document."""
    docs, k = _docs(spark, d).select("doc_id", "text", "lang"), F.col("doc_id") % 7
    store = postings.PostingStore.create(docs, work_path(spark, "posting-store"))
    some = docs.where(k.isin(1, 2, 3)).select("doc_id", F.when(k == 1, F.concat_ws(" ", "text", "lang")).alias("text"), F.when(k == 3, F.col("doc_id") + 1_000_000_000).alias("to"))
    new = table(spark, d, "benchmark").select((F.col("item_id") + 2_000_000_000).alias("doc_id"), "text", F.lit(None).cast("long").alias("to"))
    store = store.apply(some.unionByName(new), renamed="to")
    back = docs.where((k == 2) & (F.col("doc_id") % 5 == 0)).select("doc_id", "text")
    gone = docs.where((k == 3) & (F.col("doc_id") % 3 == 0)).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return store.apply(back.unionByName(gone))


def frequencies_after_changes(spark, d):
    """Documents and occurrences of each token, from the sums of signed deltas."""
    store = _changed_store(spark, d)
    occurrences = store.postings().groupBy("token").agg(F.sum("tf").alias("occurrences"))
    return store.statistics().frequencies.join(occurrences, "token").select("token", "doc_freq", "occurrences")


def bm25_after_changes(spark, d):
    s = _changed_store(spark, d).top(_asks(spark, d), 10)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _sql_session(spark, d):
    """Views of the tables and the functions for SQL."""
    register(spark, d)
    sql.register_functions(spark)


def sql_search(spark, d):
    """Ingestion and search by SQL: statistics and weights of what is asked over views, each task's best by table functions that hold a block of queries, the best of all by another."""
    _sql_session(spark, d)
    # the empty token stands for the document itself and brings its length along
    counts = spark.sql("""
        WITH texts AS (SELECT corpus_tokens(text) AS ts FROM documents),
        each AS (SELECT size(ts) AS len, explode(concat(array(''), array_distinct(ts))) AS token FROM texts WHERE size(ts) > 0)
        SELECT token, count(*) AS df, sum(IF(token = '', len, 0)) AS len FROM each GROUP BY token""")
    stored(counts, "token-counts").createOrReplaceTempView("token_counts")
    asked = spark.sql("""
        WITH raw AS (SELECT token, ln(n - df + 0.5D) - ln(df + 0.5D) AS raw FROM token_counts CROSS JOIN (SELECT df AS n FROM token_counts WHERE token = '') WHERE token <> ''),
        idf AS (SELECT token, IF(raw < 0, 0.25D * (SELECT avg(raw) FROM raw), raw) AS idf FROM raw),
        asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, explode(ts) AS token FROM (SELECT item_id, corpus_tokens(text) AS ts FROM benchmark)) GROUP BY item_id, token)
        SELECT query_id, token, times * idf AS weight FROM asked JOIN idf USING (token)""")
    mean_len = spark.sql("SELECT coalesce(sum(len) / sum(df), 0D) AS mean_len FROM token_counts WHERE token = ''").first()["mean_len"]
    functions = best.best_functions(stored(asked, "asked-tokens"), mean_len, 10)
    hits = " UNION ALL ".join(f"SELECT query_id, doc_id, round(score, 6) AS score FROM {f}(TABLE(SELECT doc_id, ts FROM texts))" for f in functions)
    return spark.sql(f"""
        WITH texts AS (SELECT doc_id, ts FROM (SELECT doc_id, corpus_tokens(text) AS ts FROM documents) WHERE size(ts) > 0),
        hits AS ({hits})
        SELECT query_id, doc_id, score, rank FROM corpus_top(TABLE(SELECT * FROM hits) PARTITION BY query_id ORDER BY (score DESC, doc_id), 10)""")


def sql_packed_chunks(spark, d):
    """Chunks of all documents by one table function, and those of each source that fit a budget of words by another."""
    _sql_session(spark, d)
    return spark.sql("""
        WITH chunks AS (SELECT source, doc_id, c.chunk_index, c.total_chunks, c.n_words, sha2(c.document, 256) AS document_sha FROM documents, LATERAL corpus_chunks(text, 330, 60) c)
        SELECT source, doc_id, chunk_index, total_chunks, document_sha, used FROM corpus_budget(TABLE(SELECT * FROM chunks) PARTITION BY source ORDER BY (doc_id, chunk_index), 'n_words', 20000, 1)""")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _vector_asks(spark, d, every: int = 20):
    return _vectors(spark, d).where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")


def _knn(spark, d, k=10, where="true"):
    return rank.cosine_knn(_vectors(spark, d).where(where), _vector_asks(spark, d), k)


def cosine_knn(spark, d):
    return _knn(spark, d).select("query_id", "vec_id", F.round(F.col("score"), 6).alias("score"), "rank")


def cosine_knn_parts(spark, d):
    """The same by parts of space; each query visits only those that may hold a neighbour."""
    found = rank.cosine_knn(_vectors(spark, d), _vector_asks(spark, d), 10, centres=64)
    return found.select("query_id", "vec_id", F.round(F.col("score"), 6).alias("score"), "rank")


def cosine_knn_filtered(spark, d):
    return _knn(spark, d, 5, "label IN (1, 3, 5)").select("query_id", "vec_id", F.round(F.col("score"), 6).alias("score"), "rank")


def cosine_per_label(spark, d):
    x = _knn(spark, d, library.LEG).join(_vectors(spark, d).select("vec_id", F.col("label").cast("string").alias("title")), "vec_id")
    return library.dense_leg(x).select("query_id", "title", F.round("best", 6).alias("best"), "hits", "rank")


def cosine_pairs(spark, d):
    """The expression form, on neighbouring rows."""
    v = _vectors(spark, d)
    x = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return x.select("vec_id", (F.round(X.cosine(F.col("embedding"), F.col("other")), 6) + 0.0).alias("cosine"))


def _legs(spark, d):
    """A dense leg over vectors and a lexical one over documents with the same ids, for queries known by number."""
    dense = _knn(spark, d, 24).select((F.col("query_id") / 20).cast("long").alias("query_id"), F.col("vec_id").alias("id"), "rank")
    lexical = best.bm25_top(_docs(spark, d), _asks(spark, d), 24).select("query_id", F.col("doc_id").alias("id"), "rank")
    return dense, lexical


def hybrid_search(spark, d):
    dense, lexical = _legs(spark, d)
    return rank.hybrid(dense, lexical, "id").where("rank <= 40").select("query_id", "id", F.round("fused", 9).alias("fused"), "rank")


def rrf_overlapping(spark, d):
    dense, lexical = _legs(spark, d)
    return rank.fused(dense, lexical, key="id").where("rank <= 40").select("query_id", "id", F.round("fused", 9).alias("fused"), "legs", "rank")


def _hits(spark, d, k=60):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("title"), F.col("text").alias("document"))
    return best.bm25_top(_docs(spark, d), _asks(spark, d), k).join(docs, "doc_id")


def rerank(spark, d):
    hits = _hits(spark, d, 60).join(_asks(spark, d).withColumnRenamed("text", "query"), "query_id")
    out = rank.reranked(hits, rank.lexical_overlap(F.col("query"), F.col("document")))
    return out.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def diversify(spark, d):
    return rank.diversified(_hits(spark, d), cap=2, limit=12).select("query_id", "doc_id", "title", F.col("place").alias("place"))


def word_budget(spark, d):
    return rank.within_budget(_hits(spark, d, 10), 1500).select("query_id", "doc_id", "rank", "used")


def parent_collapse(spark, d):
    hits = _hits(spark, d, 20).withColumn("chunk_id", F.col("doc_id").cast("string")).withColumn("parent_id", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))))
    # every fourth document is the parent of those before the next; short ones are no parents
    parents = _docs(spark, d).where("doc_id % 4 = 0 AND n_chars > 300").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")).alias("parent_id"), "text")
    return rank.with_parents(hits, parents).select("query_id", "chunk_id", "rank", F.sha2("document", 256).alias("document_sha"))


def first_source(spark, d):
    from pyspark.sql import Window

    hits = _hits(spark, d, 30).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    w = Window.partitionBy("query_id", "title", "lang").orderBy("rank")
    return hits.withColumn("i", F.row_number().over(w)).where("i = 1").select("query_id", "title", "lang", "rank")


def context_blocks(spark, d):
    hits = rank.diversified(_hits(spark, d), limit=4).drop("rank").withColumnRenamed("place", "rank")
    return rank.context(hits, 50).select("query_id", F.sha2("context", 256).alias("context_sha"))


def _titles(spark, d):
    """Works by the names of parts, nations and regions."""
    return table(spark, d, "part").select(F.col("p_name").alias("title")).union(table(spark, d, "nation").select("n_name")).union(table(spark, d, "region").select("r_name")).distinct()


def _title_asks(spark, d):
    """Messages that name works in one of eight ways: within the text, as a part of a word, as names in capitals, by words in another order, with and without a word such as
    `summary`, or by a part of a title."""
    p = table(spark, d, "part").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("p_partkey") % 25)  # 25 nations
    name, nation, ws = F.col("p_name"), F.initcap("n_name"), F.split("p_name", " ")
    a, b = F.get(ws, F.lit(0)), F.get(ws, F.lit(1))
    forms = [
        F.concat(F.lit("Summarize "), name, F.lit(" please")),
        F.concat(F.lit("Who buys in "), nation, F.lit("'s harbours?")),
        F.concat(F.lit("which "), F.initcap(b), F.lit(" "), F.initcap(a), F.lit(" is best?")),
        F.concat(F.lit("a summary of the "), b, F.lit(" or "), a, F.lit(" for "), nation),
        F.concat(F.lit("sell the "), b, F.lit(" or "), a),
        F.concat(F.lit("overview for "), a),
        F.concat(F.lit("zz"), name, F.lit("zz and The "), nation, F.lit(" series")),
        F.substring("p_name", 2, 5),
    ]
    return p.select(F.col("p_partkey").alias("query_id"), F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("text"))


def title_match(spark, d):
    return rank.matched_titles(_title_asks(spark, d), _titles(spark, d))


def distinctive_terms(spark, d):
    return rank.distinctive(table(spark, d, "part").select(F.col("p_name").alias("title")).distinct())


def proper_names(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(rank.proper_phrases(F.col("text")), ";").alias("phrases"))


def even_spread_sample(spark, d):
    return rank.even_spread(_docs(spark, d).select("doc_id", "source"), 7, "doc_id", "source").select("source", "doc_id", F.col("pos").cast("long").alias("pos"))


def shuffled_sample(spark, d):
    """A deterministic shuffle: by a hash with a seed."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    return _docs(spark, d).select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(100)


def _books(spark, d):
    x = _docs(spark, d).select("doc_id", F.concat(F.lit("Work "), F.col("source")).alias("title"), F.col("source"), X.kind_of(F.array("lang", "source")).alias("kind"), F.array("lang", "source").alias("tags"))
    return library.works(x)


def find_works(spark, d):
    books = _books(spark, d)
    topics = books.select(F.regexp_extract("source", r"\d+", 0).cast("long").alias("query_id"), F.concat(F.lit("work "), F.col("source")).alias("text")).distinct()
    scores = best.bm25_sums(_docs(spark, d).select(F.concat(F.lit("Work "), F.col("source")).alias("title"), "text"), _asks(spark, d))
    legs = [library.lexical_leg(topics, books), library.bm25_leg(scores)]
    out = library.find_works(legs, books.where("source <> 'src7'"), 10)
    return out.select("query_id", "title", F.round("fused", 9).alias("fused"), "rank")


def catalog_markdown(spark, d):
    return library.markdown_rows(_books(spark, d)).select(F.col("place").cast("long").alias("place"), "line")


def hit_metrics(spark, d):
    """Whether benchmark items find the documents that hold them word for word; items that no document holds are left out."""
    docs, asks = _docs(spark, d), _asks(spark, d)
    hits = best.bm25_top(docs, asks, 10).select("query_id", F.col("doc_id").alias("item"), "rank")
    texts = docs.select("doc_id", X.collapsed(F.col("text")).alias("t"))
    wanted = study.holders(texts, asks.select(F.col("query_id").alias("item_id"), X.collapsed(F.col("text")).alias("x")))
    m = evaluation.query_metrics(hits, wanted.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item")), 5)
    return m.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("rr", "recall", "precision")])


def eval_diff(spark, d):
    v = table(spark, d, "labels").join(_docs(spark, d), "doc_id").groupBy(F.col("source").alias("metric")).agg(F.avg(F.col("quality").cast("double")).alias("value"))
    base = table(spark, d, "labels").agg(F.avg(F.col("quality").cast("double")).alias("value"))
    both = v.select("metric").join(F.broadcast(base))  # one row
    return evaluation.regressions(v, both).select("metric", F.round("current", 6).alias("current"), F.round("baseline", 6).alias("baseline"), "regressed")


QUERIES = {f.__name__: f for f in (hybrid_search, bm25_topk, frequencies_after_changes, bm25_after_changes, sql_search, sql_packed_chunks, bm25_zero_fill, bm25_per_title, cosine_knn, cosine_knn_parts, cosine_knn_filtered, cosine_per_label, cosine_pairs, rrf_overlapping, rerank, diversify, word_budget, parent_collapse, first_source, context_blocks, title_match, distinctive_terms, proper_names, even_spread_sample, shuffled_sample, find_works, catalog_markdown, hit_metrics, eval_diff)}


def _bm25(asks: str) -> str:
    return f"{_TF}, q AS ({asks}), qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({TOK.format('text')}) AS token FROM q) GROUP BY ALL), sc AS (SELECT query_id, tf.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS score FROM qt JOIN idf USING (token) JOIN tf USING (token) JOIN lens ON lens.doc_id = tf.doc_id, nd GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)"


# what the documents are after the changes
_FINAL = "final AS (SELECT CASE WHEN doc_id % 7 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 1 THEN concat_ws(' ', text, lang) ELSE text END AS text FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 5 > 0) AND NOT (doc_id % 7 = 3 AND doc_id % 3 = 0) UNION ALL SELECT item_id + 2000000000, text FROM benchmark)"
_B = _bm25("SELECT item_id AS query_id, text FROM benchmark")
_V = "va AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), vs AS (SELECT query_id, vec_id, label, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM va, embeddings {w}), vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs)"
_LEGS = f"{_B}, {_V.format(w='')}, dense AS (SELECT query_id // 20 AS query_id, vec_id AS id, rank FROM vk WHERE rank <= 24), lexical AS (SELECT query_id, doc_id AS id, rank FROM top WHERE rank <= 24)"
_FUSE = "f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS fused, min(leg * 1000 + rank) AS seen, count(*) AS legs FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, seen, id) AS rank FROM f)"
_HITS = f"{_B}, hits AS (SELECT query_id, top.doc_id, score, rank, source AS title, lang, text AS document FROM top JOIN documents USING (doc_id))"
_NT = "trim(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.TERM_STOP)
_OWN = "list_distinct(list_filter(string_split(" + _NT + f", ' '), lambda w: w <> '' AND w NOT IN ({_STOP})))"
_BOOKS = f"books AS (SELECT 'Work ' || source AS title, source, min({_KIND}) AS kind, list_sort(list_distinct(flatten(list([lang, source])))) AS tags FROM documents GROUP BY source)"
_DIV = "d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, document ORDER BY rank) AS i FROM hits WHERE rank <= 60), d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY rank) AS j FROM d1 WHERE i = 1), d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM d2 WHERE j <= {cap})"

_NOT_PROPER = ", ".join(f"'{w}'" for w in rank.NOT_PROPER)
_TSTOP = ", ".join(f"'{w}'" for w in rank.TITLE_STOP)
_TOWN = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> '' AND w NOT IN (" + _TSTOP + ")))"
_CAP = "upper({0}[1]) || lower({0}[2:])"
_RAW = r"regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*')"
# the rules of routing over every message and every title
_TITLES = rf"""
WITH t0 AS (SELECT p_name AS title FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region),
p AS (SELECT p_partkey AS query_id, p_partkey % 8 AS f, p_name AS n, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b,
    array_to_string(list_transform(string_split(n_name, ' '), lambda w: {_CAP.format('w')}), ' ') AS c FROM part JOIN nation ON n_nationkey = p_partkey % 25),
m AS (SELECT query_id, CASE f WHEN 0 THEN 'Summarize ' || n || ' please' WHEN 1 THEN 'Who buys in ' || c || '''s harbours?' WHEN 2 THEN 'which ' || {_CAP.format('b')} || ' ' || {_CAP.format('a')} || ' is best?'
    WHEN 3 THEN 'a summary of the ' || b || ' or ' || a || ' for ' || c WHEN 4 THEN 'sell the ' || b || ' or ' || a WHEN 5 THEN 'overview for ' || a WHEN 6 THEN 'zz' || n || 'zz and The ' || c || ' series' ELSE substring(n, 2, 5) END AS text FROM p),
q AS (SELECT query_id, text, {_NT.format('text')} AS q FROM m),
k AS (SELECT query_id, i, w, regexp_replace(lower(w), '''s$', '') AS base FROM (SELECT query_id, unnest({_RAW}) AS w, generate_subscripts({_RAW}, 1) AS i FROM q)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY query_id ORDER BY i) AS run FROM k WHERE regexp_matches(w, '^[A-Z]') AND length(base) >= 2 AND base NOT IN ({_NOT_PROPER})),
ph AS (SELECT query_id, min(i) AS i, string_agg(base, ' ' ORDER BY i) AS name FROM r GROUP BY query_id, run),
t AS (SELECT title, {_NT.format('title')} AS t, {_TOWN.format(_NT.format('title'))} AS own FROM t0 WHERE length({_NT.format('title')}) >= 3),
lone AS (SELECT DISTINCT query_id, name FROM ph WHERE NOT contains(name, ' ') AND (SELECT count(*) FROM t WHERE list_contains(string_split(t, ' '), name)) / (SELECT count(*) FROM t) < 0.03),
g AS (SELECT query_id, q, {_TOWN.format('q')} AS asked, len(list_intersect(string_split(q, ' '), ['summarize', 'summary', 'synopsis', 'overview', 'recap', 'about', 'spoiler', 'review', 'contents', 'chapters', 'compare'])) > 0 OR regexp_matches(lower(text), '\b(the|this)\s+\w+\s+(book|novel|series)$') AS about FROM q),
long AS (SELECT query_id, title, min_by(len(string_split(name, ' ')), i) AS n FROM ph, t WHERE contains(name, ' ') AND list_has_all(own, string_split(name, ' ')) GROUP BY ALL),
lo AS (SELECT query_id, title, count(*) AS n FROM lone, t WHERE list_contains(own, name) GROUP BY ALL),
s AS (SELECT g.query_id, t.title, CASE WHEN contains(q, t) OR contains(t, q) THEN 100 + length(t) WHEN long.n IS NOT NULL THEN 60 + length(t) + 10 * long.n WHEN lo.n IS NOT NULL THEN 40 + length(t) + 5 * lo.n
    WHEN NOT about THEN NULL WHEN len(own) >= 2 AND len(list_intersect(own, asked)) >= 2 THEN 60 + length(t) WHEN len(list_intersect(own, asked)) = 1 AND length(list_intersect(own, asked)[1]) >= 5 THEN 40 + length(t) END AS score
    FROM g CROSS JOIN t LEFT JOIN long ON long.query_id = g.query_id AND long.title = t.title LEFT JOIN lo ON lo.query_id = g.query_id AND lo.title = t.title),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title) AS rank FROM s WHERE score IS NOT NULL)
SELECT query_id, title, score, rank FROM o WHERE rank <= 4"""

SQL = {
    "bm25_topk": f"WITH {_B} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10",
    "sql_search": f"WITH {_B}, r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM sc), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) SELECT query_id, doc_id, score, rank FROM o WHERE rank <= 10",
    "sql_packed_chunks": f"WITH {_CHUNKS}, n AS (SELECT doc_id, source, chunk_index, total_chunks, document, len({WS.format('document')}) AS n_words FROM chunks), b AS (SELECT *, (sum(n_words) OVER w)::BIGINT AS used, count(*) OVER w AS i FROM n WINDOW w AS (PARTITION BY source ORDER BY doc_id, chunk_index ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, chunk_index, total_chunks, sha256(document) AS document_sha, used FROM b WHERE used <= 20000 OR i <= 1",
    "frequencies_after_changes": f"WITH {_FINAL}, {_TF.replace('FROM documents', 'FROM final')} SELECT token, doc_freq, sum(tf)::BIGINT AS occurrences FROM tf JOIN df USING (token) GROUP BY ALL",
    "bm25_after_changes": f"WITH {_FINAL}, {_B.replace('FROM documents', 'FROM final')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10",
    "bm25_zero_fill": f"WITH {_B}, z AS (SELECT q.query_id, d.doc_id, coalesce(score, 0) AS score FROM q CROSS JOIN documents d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = d.doc_id), zr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM z) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM zr WHERE rank <= 25",
    "bm25_per_title": f"WITH {_B}, p AS (SELECT query_id, source AS title, sum(score) AS score FROM sc JOIN documents USING (doc_id) GROUP BY ALL) SELECT query_id, title, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, title) AS rank FROM p",
    "cosine_knn": f"WITH {_V.format(w='')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vk WHERE rank <= 10",
    "cosine_knn_parts": f"WITH {_V.format(w='')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vk WHERE rank <= 10",
    "cosine_knn_filtered": f"WITH {_V.format(w='WHERE label IN (1, 3, 5)')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vk WHERE rank <= 5",
    "cosine_per_label": f"WITH {_V.format(w='')}, t AS (SELECT query_id, label::VARCHAR AS title, max(score) AS best, count(*) AS hits FROM vk WHERE rank <= 500 GROUP BY ALL) SELECT query_id, title, round(best, 6) AS best, hits, row_number() OVER (PARTITION BY query_id ORDER BY round(best, 9) DESC, hits DESC, title) AS rank FROM t",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "hybrid_search": f"WITH {_LEGS}, rest AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lexical WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM dense)), u AS (SELECT *, 0 AS leg FROM dense UNION ALL SELECT *, 1 FROM rest), {_FUSE} SELECT query_id, id, round(fused, 9) AS fused, rank FROM r WHERE rank <= 40",
    "rrf_overlapping": f"WITH {_LEGS}, u AS (SELECT *, 0 AS leg FROM dense UNION ALL SELECT *, 1 FROM lexical), {_FUSE} SELECT query_id, id, round(fused, 9) AS fused, legs, rank FROM r WHERE rank <= 40",
    "rerank": f"WITH {_HITS}, s AS (SELECT h.*, len(list_intersect(list_distinct({TOK.format('q.text')}), list_distinct({TOK.format('document')}))) / len(list_distinct({TOK.format('q.text')})) AS rs FROM hits h JOIN q USING (query_id) WHERE rank <= 48), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) AS nr FROM s) SELECT query_id, doc_id, round(rs, 6) AS rerank_score, nr AS rank FROM n WHERE nr <= 24",
    "diversify": f"WITH {_HITS}, {_DIV.format(cap=2)} SELECT query_id, doc_id, title, place FROM d3 WHERE place <= 12",
    "word_budget": f"WITH {_HITS}, b AS (SELECT *, sum(len({WS.format('document')})) OVER w AS used, count(*) OVER w AS kept FROM hits WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) SELECT query_id, doc_id, rank, used::BIGINT AS used FROM b WHERE used <= 1500 OR kept <= 1",
    "parent_collapse": f"WITH {_HITS}, x AS (SELECT h.query_id, h.doc_id::VARCHAR AS chunk_id, h.rank, coalesce(p.text, h.document) AS document, coalesce('p' || p.doc_id // 4, 'self:' || h.doc_id) AS g FROM hits h LEFT JOIN documents p ON h.doc_id % 4 > 0 AND p.doc_id = h.doc_id // 4 * 4 AND p.n_chars > 300 WHERE rank <= 20), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank) AS i FROM x) SELECT query_id, chunk_id, rank, sha256(document) AS document_sha FROM y WHERE i = 1",
    "first_source": f"WITH {_HITS}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, lang ORDER BY rank) AS i FROM hits WHERE rank <= 30) SELECT query_id, title, lang, rank FROM x WHERE i = 1",
    "context_blocks": f"WITH {_HITS}, {_DIV.format(cap=3)}, c AS (SELECT query_id, place, '[' || place || '] ' || title || chr(10) || array_to_string({WS.format('document')}[1:50], ' ') || CASE WHEN len({WS.format('document')}) > 50 THEN ' …[truncated]' ELSE '' END AS t FROM d3 WHERE place <= 4) SELECT query_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY place)) AS context_sha FROM c GROUP BY query_id",
    "title_match": _TITLES,
    "distinctive_terms": f"WITH t AS (SELECT {_NT.format('p_name')} AS t FROM (SELECT DISTINCT p_name FROM part)), k AS (SELECT t FROM t WHERE length(t) >= 3), w AS (SELECT unnest(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS word FROM k) SELECT word, count(*) AS titles, count(*) / (SELECT count(*) FROM k) < 0.03 AS rare FROM w GROUP BY word",
    "even_spread_sample": "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM documents) SELECT source, doc_id, pos FROM p WHERE m <= 7 OR list_contains([(0 * m) // 7, (1 * m) // 7, (2 * m) // 7, (3 * m) // 7, (4 * m) // 7, (5 * m) // 7, (6 * m) // 7], pos)",
    "shuffled_sample": "SELECT doc_id, md5(doc_id || ':42') AS h FROM documents ORDER BY h, doc_id LIMIT 100",
    "find_works": f"WITH {_B}, {_BOOKS}, tp AS (SELECT regexp_extract(source, '\\d+')::BIGINT AS query_id, lower('work ' || source) AS topic FROM books), bt AS (SELECT title, lower(title || ' ' || array_to_string(tags, ' ') || ' ' || source) AS about FROM books), l0 AS (SELECT query_id, title, len(list_intersect(list_distinct({TOK.format('topic')}), list_distinct({TOK.format('about')}))) + CASE WHEN contains(about, topic) THEN 3 ELSE 0 END AS score FROM tp, bt), l1 AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), title) AS rank FROM l0 WHERE score > 0), p AS (SELECT query_id, 'Work ' || source AS title, sum(score) AS score FROM sc JOIN documents USING (doc_id) GROUP BY ALL), l2 AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, title) AS rank FROM p), u AS (SELECT query_id, title AS id, rank, 0 AS leg FROM l1 WHERE title <> 'Work src7' UNION ALL SELECT query_id, title, rank, 1 FROM l2 WHERE title <> 'Work src7'), {_FUSE} SELECT query_id, id AS title, round(fused, 9) AS fused, rank FROM r WHERE rank <= 10",
    "catalog_markdown": f"WITH {_BOOKS}, n AS (SELECT *, row_number() OVER (ORDER BY lower(title), source) AS place FROM books) SELECT place, '| ' || place || ' | ' || title || ' | ' || CASE kind WHEN 'fiction' THEN '\U0001f4d6' ELSE '\U0001f4da' END || ' | ' || array_to_string(tags[1:3], ', ') || CASE WHEN len(tags) > 3 THEN ' (+' || (len(tags) - 3) || ')' ELSE '' END || ' | ' || source || ' | ' || kind || ' |' AS line FROM n",
    "hit_metrics": f"WITH {_B}, c AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), x AS (SELECT query_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x FROM q), w AS (SELECT query_id, doc_id FROM x JOIN c ON contains(t, x)), h AS (SELECT query_id, doc_id, rank FROM top WHERE rank <= 5), a AS (SELECT w.query_id, count(*) AS wanted, count(rank) AS found, min(rank) AS best FROM w LEFT JOIN h USING (query_id, doc_id) GROUP BY w.query_id), s AS (SELECT query_id, count(*) AS shown FROM h GROUP BY query_id) SELECT query_id, (best IS NOT NULL)::INT AS hit, coalesce(round(1 / best, 6), 0) AS rr, round(found / wanted, 6) AS recall, coalesce(round(found / shown, 6), 0) AS precision FROM a LEFT JOIN s USING (query_id)",
    "eval_diff": "WITH v AS (SELECT source AS metric, avg(quality) AS current FROM labels JOIN documents USING (doc_id) GROUP BY source), b AS (SELECT avg(quality) AS baseline FROM labels) SELECT metric, round(current, 6) AS current, round(baseline, 6) AS baseline, current < baseline * (1 - 0.05::DOUBLE) AS regressed FROM v, b",
}
