"""Chat formatting, language identification, HTML extraction, token counts, licences."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import chat, html_text, language, licences, tokens

from ..oracle import compare


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op2_query(spark, sf):
    compare(chat.op2_chat(spark, sf), chat.SQL["op2_chat"], sf)


def test_op2_odd_rows(spark):
    rows = [(1, 0, "user", "a\\b[c]<d>\\["), (1, 1, "assistant", None), (1, 2, None, "</s>[INST] x"), (1, 3, "tool]", "t\n"), (2, 1, "assistant", "first"), (2, 0, "system", ""), (2, 0, "system", ""), (None, 0, "user", "q"), (3, None, "user", "no turn"), (3, 5, "assistant", "\\" * 5 + "[/INST]"), (4, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(b.role, b.text) for b in out[c].back] == [t[1:] for t in turns]
        assert out[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
        assert "".join(s.text for s in out[c].segments) == out[c].formatted
    assert out[None].valid is False and out[2].first_bad_turn == 1 and out[3].valid is True and out[1].first_bad_turn == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_op6_query(spark, sf):
    got = language.op6_language(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    first = sorted(tuple(r) for r in got.collect())
    assert first == sorted(tuple(r) for r in language.op6_language(spark, sf).collect())


def test_op6_labels_of_held_out_rows_dont_count(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = (sorted(tuple(r) for r in language.op6_language(spark, d).collect()) for d in (sf, str(tmp_path)))
    assert a == b


def test_op6_odd_rows(spark, odd, nothing):
    known = language.train(odd)
    out = language.identify(odd, known).collect()
    assert {r.lid_lang for r in out} <= {"en", "fr", "ja", "und"}
    assert all(r.lid_lang == "und" and r.lid_rejected for r in out if r.doc_id in (4, 5, 6, 14))
    assert all(r.lid_lang == "ja" for r in out if r.doc_id in (11, 12))
    assert len(out) == odd.count()
    nobody = language.train(nothing)
    assert language.identify(nothing, known).count() == 0
    assert {r.lid_lang for r in language.identify(odd, nobody).collect()} == {"und"}


def test_op6_rejects_an_unknown_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = language.train(docs.where("lang <> 'de'"))
    out = language.identify(docs, known).groupBy("lang").agg(F.avg(F.col("lid_rejected").cast("double")).alias("share")).collect()
    share = {r.lang: r.share for r in out}
    assert share["de"] > 0.8 and max(v for k, v in share.items() if k != "de") < 0.05


def test_kneser_ney_is_a_distribution():
    import numpy as np

    words = ["abab", "abba", "baab", "cab"]
    grams = {}
    for w in words:
        s = language._PAD * 4 + w + language._END
        for i in range(len(s) - 4):
            grams[s[i : i + 5]] = grams.get(s[i : i + 5], 0) + 1
    m = language.KneserNey(sorted(grams), np.array([grams[g] for g in sorted(grams)]))
    for head in ("\x02\x02ab", "\x02cab", "zzzz", "abab"):
        total = 2**m.unknown
        for c in "abc\x03":
            points = np.frombuffer((head + c).encode("utf-32-le"), np.uint32)
            hashes = [None] + [language._hashes(points, k) for k in range(1, 6)]
            total += 2 ** m.score(hashes, np.array([4]))[0]
        assert total == pytest.approx(1, abs=0.15) and total < 1.0001 + 2**m.unknown


def test_op6_brute_kneser_ney():
    """Word scores from arrays against the textbook recursion on dictionaries."""
    import math

    rng = random.Random(21)
    train = ["".join(rng.choice("aab" if rng.random() < 0.6 else "cdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    n = language.ORDER
    counts = [None] * n + [{}]
    for w in train:
        s = language._PAD * (n - 1) + w + language._END
        for i in range(len(s) - n + 1):
            counts[n][s[i : i + n]] = counts[n].get(s[i : i + n], 0) + 1
    for k in range(n - 1, 0, -1):  # a lower order counts the different characters before
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discount(k):
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        return min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)

    def p(head, c):
        k = len(head) + 1
        lower = 1 / (len(counts[1]) + 1) if k == 1 else p(head[1:], c)
        follow = {g[-1]: x for g, x in counts[k].items() if g[:-1] == head}
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(c, 0) - discount(k), 0) / total + discount(k) * len(follow) / total * lower

    grams = sorted(counts[n])
    m = language.Identifier({"x": language.KneserNey(grams, np.array([counts[n][g] for g in grams]))})
    words = train[:30] + ["zzz", "abz", "é", "dedede", "aaaaaaaaaaaa"]
    for w, got in zip(words, m.word_scores(words)[:, 0]):
        s = language._PAD * (n - 1) + w + language._END
        assert got == pytest.approx(sum(math.log2(p(s[i : i + n - 1], s[i + n - 1])) for i in range(len(w) + 1)), abs=1e-3)


def test_op6_keeps_all_grams(spark):
    """More 5-grams than 300,000, as in text of a large character set without blanks."""
    import numpy as np

    rng = random.Random(12)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4500)) for _ in range(90)]
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    got = language.train(df)
    apart = {r.doc_id for r in df.where("pmod(xxhash64(doc_id, 'calibration'), 8) = 0").collect()}
    grams = {}
    for i, t in enumerate(texts):
        if i not in apart:
            s = language._PAD * 4 + t + language._END
            for k in range(len(s) - 4):
                grams[s[k : k + 5]] = grams.get(s[k : k + 5], 0) + 1
    assert apart and len(grams) > 300_000
    want = language.KneserNey(sorted(grams), np.array([grams[g] for g in sorted(grams)]))
    (m,) = got.models
    assert m.unknown == want.unknown
    for k in range(1, 6):
        assert all(np.array_equal(a, b) for a, b in zip(m.tables[k], want.tables[k]))
        assert k == 1 or all(np.array_equal(a, b) for a, b in zip(m.weights[k], want.weights[k]))


def test_op6_calibrates_rare_languages(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(("abc", "bca", "cab", "aab", "bbc")) for _ in range(20)), "en") for i in range(3000)]
    rows += [(i, " ".join(rng.choice(("xyz", "yzx", "zxy", "xxy", "yyz")) for _ in range(20)), "fr") for i in range(3000, 3080)]
    spread = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), calibration=40).spread
    assert set(spread) == {"en", "fr"} and spread["fr"][1] > 0


PAGES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>a &amp; b<p>c", "a & b c"),
    ("<body><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One <b>two</b>\n three.</p><ul><li>x<li>y</ul></article><footer>f</footer>", "T One two three. x y"),
    ("<article><p>kept</p><aside>no</aside><div class='comments'><p>no</p></div><form><p>no</p></form><script>if (a<b) x='</p>'</script><p>too</p></article>", "kept too"),
    ("<body><div id='cookie-notice'>We use cookies</div><div class='sidebar'><p>links</p></div><main><p>body text</p></main>", "body text"),
    ("<article><p>cut off in a ta<b", "cut off in a ta"),
    ("<article><p>nbsp&nbsp;here &#233; &eacute; &lt;tag&gt;</p></article>", "nbsp here é é <tag>"),
    ("<div><div><p>" + "long text " * 50 + "</p><p>" + "more text " * 50 + "</p></div></div><div><a href='a'>l1</a> <a href='b'>l2</a></div>", ("long text " * 50 + "more text " * 50).strip()),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_op8_pages(page, want):
    assert html_text.main_text(page) == want


_LEAD, _ITEMS = "lead " * 75, [f"item{k} " + "abcd " * 23 for k in range(5)]
_LIST = "<ul>" + "".join(f"<li>{x}</li>" for x in _ITEMS) + "</ul>"
_BESIDE = " ".join(f"{_LEAD} {' '.join(_ITEMS)}".split())


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><article>{_LEAD}{_LIST}</article></body>", _BESIDE),
        (f"<body><article>{_LEAD}{_LIST}after <b>the</b> list<br>end</article></body>", _BESIDE + " after the list end"),
        (f"<body><div><div>{_LEAD[:100]}<br><br>{_LEAD[100:]}{_LIST}</div></div></body>", _BESIDE),
        (f"<body>{_LEAD}{_LIST}tail</body>", _BESIDE + " tail"),
        (f"<body>Skip to content<article>{_LEAD}{_LIST}</article>Imprint</body>", _BESIDE),
        (f"<body>Skip to content<article><p>{_LEAD}</p><p>more</p></article></body>", _LEAD + "more"),
    ],
)
def test_op8_direct_text_beside_blocks(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div><aside>ads</div><article><p>the text</p><p>and more</p></article>", "the text and more"),
        ('<div class="post ad-free"><p>article one two</p></div>', "article one two"),
        ('<div id="search-results"><p>article x y</p></div>', "article x y"),
        ('<p>hello <a title="x>world</a>', "hello world"),
        ("<p don't>it <i title='a > b'>is</i> fine</p>", "it is fine"),
        ("<div><span>a</div>b<table><tr><td>c<td>d</table>", "a b c d"),
        ("<body><nav><ul><li>x</nav><p>y</p></body>", "y"),
        ("<p>&copy; &hellip; &notit; &#x41;&#66</p>", "© … ¬it; AB"),
    ],
)
def test_op8_broken_markup(page, want):
    assert html_text.main_text(page) == want


def _plain_page(rng, paragraphs):
    """No telling element, class or id: boxes of links around a box of text."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = [words(rng.randint(40, 120)) for _ in range(paragraphs)]
    links = lambda n: "".join(f"<div><a href='/{k}'>{words(2)}</a></div>" for k in range(n))
    page = f"<div>{links(12)}</div><div><div>{links(3)}</div><div>{''.join(f'<p>{t}</p>' for t in texts)}</div></div><div>{links(6)}</div>"
    return page, " ".join(texts)


def test_op8_density_alone():
    rng = random.Random(4)
    for k in range(60):
        page, want = _plain_page(rng, rng.randint(2, 8))
        assert html_text.main_text(page) == want
        assert html_text.everything(html_text.parse(page)) != want


def test_op8_long_comments():
    rng = random.Random(5)
    page, want = _plain_page(rng, 3)
    said = "".join(f"<div class='comment'><p>{'what a fine text this is ' * 9}</p></div>" for _ in range(12))
    assert html_text.main_text(f"{page}<div class='comments'>{said}</div>") == want
    assert html_text.main_text(f"<article><p>{want}</p><p>end of it</p><section id='comments'>{said}</section></article>") == want + " end of it"


def test_op8_brute_densities():
    """Densities, sums and the selection against a plain restatement on nested lists."""
    import math

    rng = random.Random(3)

    def box(depth):
        return ["box", *((box(depth - 1) if depth and rng.random() < 0.6 else ["text", "w" * rng.randint(1, 60)] if rng.random() < 0.7 else ["link", "v" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 4)))]

    def written(x):
        return f"<div>{''.join(map(written, x[1:]))}</div>" if x[0] == "box" else x[1] + " " if x[0] == "text" else f"<a>{x[1]}</a> "

    def measure(x):  # characters, tags, characters and tags of links
        if x[0] != "box":
            n = len(x[1])
            return (n, 0, 0, 0) if x[0] == "text" else (n, 1, n, 1)
        return tuple(sum(y) + k for y, k in zip(zip(*map(measure, x[1:])), (0, 1, 0, 0)))

    def density(m, ratio):
        c, t, lc, lt = m
        return c / t * math.log(max(1, c / max(lc, 1) * t / max(lt, 1))) / math.log(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e**math.e)) if c else 0.0

    for _ in range(300):
        tree = ["box", *(box(3) for _ in range(3))]
        whole = measure(tree)
        ratio = whole[2] / whole[0]
        density_of = lambda x: density(measure(x), ratio)
        ranked: list = []

        def visit(x, path):
            ranked.append((-sum(density_of(y) for y in x[1:] if y[0] == "box"), len(ranked), x, path))
            for y in x[1:]:
                if y[0] == "box":
                    visit(y, path + [x])

        visit(tree, [])
        total, _, best, path = min(ranked, key=lambda r: r[:2])
        if not total:
            best, path = tree, []
        least = min(map(density_of, [best, *path]))

        def text(x, whole):
            if x[0] != "box":
                return x[1]
            if any(x is y for y in path):  # outside of any article element direct texts stay within the path's boxes
                return " ".join(text(y, False) for y in x[1:])
            return " ".join(text(y, True) for y in x[1:]) if whole or x is best or density_of(x) >= least else ""

        want = " ".join(text(tree, False).split())
        assert html_text.main_text("".join(map(written, tree[1:]))) == want


def test_op8_never_fails():
    rng = random.Random(8)
    parts = ["<p>", "</p>", "<div class='x'>", "</div>", "<", ">", "\"", "'", "text ", "&amp;", "&", "<!--", "-->", "<script>", "</script>", "<a href=", "</a>", "<ul>", "<li>", "<article>", "</article>", "<br/>", "<td>", "\x00"]
    for _ in range(500):
        html_text.main_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    html_text.main_text("<div>" * 30_000 + "x")


def test_op8_query(spark, sf):
    got = html_text.op8_html(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert rows and all(r.n_chars == len(r.text) for r in rows)
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", pages[r.page_id])[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())


def test_op9_query(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tokens.op9_tokens(spark, sf).collect():
        n = len(lib.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())


def test_op9_odd_rows(spark, odd, odd_rows, nothing):
    lib = _library()
    got = sorted(((r.doc_id or -1, r.text or "", r.tok_count, r.tok_cut) for r in tokens.count_tokens(odd, limit=50, cut=True).collect()))
    assert [g[:3] for g in got] == sorted((r[0] or -1, r[1] or "", len(lib.encode(r[1] or ""))) for r in odd_rows)
    for _, t, n, cut in got:
        assert cut == len(t) if n <= 50 else len(lib.encode(t[:cut])) <= 50
    assert tokens.count_tokens(nothing).count() == 0
    clash = tokens.count_tokens(odd.withColumn("Tok_Count", F.lit("x")))
    assert [c for c in clash.columns if c.lower() == "tok_count"] == ["tok_count"] and clash.agg(F.min("tok_count")).first()[0] == 0


def test_op9_prefixes():
    c, lib = tokens.PrefixCounter(tokens.model_path(), kept=500), _library()
    rng = random.Random(6)
    texts = ["hello  world", " a", "<s>x</s>", "日本語 text", "𝕏\n\nab", "", " ", "a▁b", "  𝕏", "a" * 700, " " * 40 + "x"] + ["".join(rng.choice(" ▁abthe日𝕏é\n\t.,1") for _ in range(25)) for _ in range(300)]
    for t in texts:
        p = c.prefixes(t)
        assert p.counts.tolist() == [len(lib.encode(t[:i])) for i in range(len(t) + 1)]
        assert c.count(t) == p.at(len(t))


def test_op9_random_pieces():
    c, lib = tokens.PrefixCounter(tokens.model_path(), kept=2000), _library()
    rng = random.Random(8)
    texts = ["".join(rng.choice([rng.choice(c.pieces), " ", "  ", rng.choice("ab\né日𝕏\x00.,&")]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert c.counts(texts) == [len(lib.encode(t)) for t in texts]
    a, b = (np.array([rng.randrange(len(c.pieces)) for _ in range(5000)]) for _ in "ab")
    assert c.pairs_hold(a, b).tolist() == [c.follows(c.pieces[x], c.pieces[y]) for x, y in zip(a, b)]


def test_op9_long_blanks_and_words():
    c, lib = tokens.PrefixCounter(tokens.model_path()), _library()
    blanks = " " * 1_000_000
    at = c.prefixes(blanks).within(4096)
    assert len(lib.encode(blanks[:at])) <= 4096 < len(lib.encode(blanks[: at + 1]))
    word = "".join(random.Random(2).choice("abcdefghij0123") for _ in range(60_000))
    assert c.count(word) == len(lib.encode(word))


LICENCES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("You need a license to operate this strange machine under the permission of nobody", None),
    ("You need a driving license to operate this vehicle.", None),
    ("He asked his parents for permission to go.", None),
    ("You can copy and modify this freely for any purpose.", "unknown"),
    ("Licensed under the Zope Public License, Version 2.1", "unknown"),
]


@pytest.fixture(scope="module")
def licence_model(spark, sf):
    return licences.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_op1_families(spark, licence_model):
    rows = [(i, f"Some plain words before\n\n{t}\nand some more words after that", "own") for i, (t, _) in enumerate(LICENCES)]
    df = spark.createDataFrame(rows + [(90, None, ""), (91, "", ""), (92, "\n \n", ""), (93, "word " * 50_000, "")], "doc_id long, text string, family string")
    out = {r.doc_id: r for r in licences.scan(df, licence_model).collect()}
    for i, (_, want) in enumerate(LICENCES):
        assert [(f.line, f.family, f.confirmed) for f in out[i].lic_found] == ([(2, want, want != "unknown")] if want else []) and out[i].lic_lines == 3
    assert [out[k].lic_lines for k in (90, 91, 92, 93)] == [0, 0, 0, 1] and not out[93].lic_found


def _wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_op1_hard_wrapped_notices(spark, licence_model):
    cases = [(name, t, width, mark) for name, ts in licences.TEMPLATES.items() for t in ts if len(t.split()) > 14 for width, mark in ((72, ""), (50, " * "))]
    rows = [(i, f"Plain words before it\n\n{_wrapped(t, width, mark)}\n\nand other words behind it") for i, (_, t, width, mark) in enumerate(cases)]
    # of two documents beside each other no line is joined, nor across a blank line
    mit = licences.TEMPLATES["mit"][1].split()
    rows += [(900, " ".join(mit[:25])), (901, " ".join(mit[25:])), (902, " ".join(mit[:25]) + "\n"), (903, " ".join(mit[25:])), (904, " ".join(mit[:25]) + "\n\n" + " ".join(mit[25:]))]
    # a notice in one line stays one, and two are two
    rows += [(910, "Released under the MIT License.\nReleased under the MIT License."), (911, _wrapped(licences.TEMPLATES["gpl"][1], 60) + "\nReleased under the MIT License.")]
    out = {r.doc_id: r.lic_found for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), licence_model).collect()}
    for i, (name, *_) in enumerate(cases):
        assert [(f.line, f.family, f.confirmed) for f in out[i]] == [(2, name, True)], cases[i]
    assert not any(f.confirmed for k in range(900, 905) for f in out[k])
    assert [(f.line, f.family) for f in out[910]] == [(0, "mit"), (1, "mit")]
    assert [(f.family, f.confirmed) for f in out[911]] == [("gpl", True), ("mit", True)]


@pytest.mark.parametrize("line,want", [("MIT License", "mit"), ("The MIT License (MIT)", "mit"), ("GNU GENERAL PUBLIC LICENSE", "gpl"), ("GNU LESSER GENERAL PUBLIC LICENSE", "lgpl"), ("Apache License", "apache"), ("Mozilla Public License Version 2.0", "mpl"), ("BSD 3-Clause License", "bsd")])
def test_op1_key_phrases(licence_model, line, want):
    family, _, confirmed = licence_model.judge(*licences._columns([line]))
    assert licence_model.families[family[0]] == want and confirmed[0]


def test_op1_query(spark, sf):
    rows = licences.op1_licences(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {"gpl": "General Public License", "cc-by-nc": "CC BY-NC", "mit": "MIT License", "apache": "Apache License"}
    for r in rows:
        assert r.confirmed_families.split(",") == ([k for k, m in sorted(marks.items()) if m in docs[r.doc_id]] or [""])
        assert set(r.families.split(",")) - set(r.confirmed_families.split(",")) <= {"", "unknown", "proprietary"}
    assert sum("unknown" in r.families for r in rows) <= 2


def test_op1_brute_scores(licence_model):
    """Probabilities from n-grams one by one; long lines in parts."""
    import re

    m = licence_model
    rng = random.Random(2)
    vocabulary = [w for ts in licences.TEMPLATES.values() for t in ts for w in t.split()] + ["Ruße", "thing", "x1", "the", "of"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 10, 59, 60, 61, 79, 80, 95, 140, 0)] + ["MIT License", "!!", ""]

    def one(units):
        z, n = m.bias.astype(float) * 0, 0
        for h in units:
            z, n = z + m._weights_of(np.array([h], np.uint64))[0], n + 1
        z = (z / max(n, 1) ** 0.5 + m.bias) / m.temperature
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def plain(line):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", line.lower())
        grams = [[int(licences.features(*licences._columns([" ".join(words[i : i + n])]))[n - 1][1][0]) for n in (1, 2, 3) if i + n <= len(words)] for i in range(len(words))]
        if not words:
            return np.eye(m.none + 1)[m.none]
        if len(words) <= licences.LONG:
            return one([h for g in grams for h in g])
        half = licences.PART // 2
        ends = [half * (k + 2) for k in range(len(words) // half - 1)]
        ends[-1] = len(words)
        return min((one([h for g in grams[half * k : e] for h in g]) for k, e in enumerate(ends)), key=lambda p: p[m.none])

    got = m._probabilities(licences.features(*licences._columns(lines)), len(lines))
    assert np.allclose(got, [plain(t) for t in lines], atol=2e-4)


PARAPHRASES = [
    ("This project is MIT licensed", "mit"),
    ("see the Apache 2 licence", "apache"),
    ("Released under GPLv3", "gpl"),
    ("all code here is LGPL", "lgpl"),
    ("under the BSD licence", "bsd"),
    ("our work is CC0", "cc0"),
    ("the text is CC-BY-SA", "cc-by-sa"),
    ("text is CC-BY-NC only", "cc-by-nc"),
    ("MPL 2.0 applies", "mpl"),
    ("She renewed her fishing licence at the lake", None),
    ("The copyright of the painting was disputed in court", None),
    ("Without permission of the king nobody was to leave", None),
    ("Licensed under the ISC license", "unknown"),
    ("Made available under the Eclipse Public License", "unknown"),
]


def test_op1_classifier_decides(licence_model):
    """Better than the nearest template alone, on lines whose wording no template has."""
    m = licence_model
    texts = [t for t, _ in PARAPHRASES]
    family, _, _ = m.judge(*licences._columns(texts))
    names = [*m.families, "unknown", None]
    good = sum(names[k] == want for k, (_, want) in zip(family, PARAPHRASES))

    def nearest(t):
        _, h = licences._flat(licences.features(*licences._columns([t])))
        share, k = max((licences._share(np.unique(h), grams), -k) for k, grams in m.templates)
        return m.families[-k] if share >= licences.CONFIRMED_AT else None

    assert good >= len(PARAPHRASES) - 3 and good > 3 + sum(nearest(t) == want for t, want in PARAPHRASES)


@pytest.mark.parametrize("family", ["mpl", "apache", "proprietary"])
def test_op1_families_held_out(spark, sf, family):
    """Notices of a family that wasn't trained on count as unknown or as no licence, rarely as another family."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    m = licences.Model(sorted(x[:400] for r in rows for x in (r.text or "").split("\n")[:20] if x.strip())[:2000], without=(family,))
    rng = np.random.default_rng(1)
    texts = [m._variant(t, ["thing", "word"], rng) for t in licences.TEMPLATES[family] for _ in range(10)]
    got, _, _ = m.judge(*licences._columns(texts))
    assert (got < m.unknown).mean() <= 0.1 and (family == "proprietary" or (got == m.unknown).mean() >= 0.5)


def test_op1_variants(licence_model):
    """Held-out variants: families are told apart and other text isn't taken for a licence."""
    import numpy as np

    rng = np.random.default_rng(99)
    good = total = 0
    for name, ts in licences.TEMPLATES.items():
        for t in ts:
            for _ in range(5):
                buf, off = licences._columns([licences.Model._variant(t, ["thing", "other", "word"], rng)])
                family, _, _ = licence_model.judge(buf, off)
                k = int(family[0])
                good += k < len(licence_model.families) and licence_model.families[k] == name
                total += 1
    assert good / total > 0.85


def test_op1_empty(spark, nothing, licence_model):
    assert licences.scan(nothing, licence_model).count() == 0
    licences.train(nothing)
