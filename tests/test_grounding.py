"""Grounding queries against brute force on small made-up tables."""

import difflib
import random
import re

from corpuscle.plans import study


def _tables(spark, path, texts, items):
    spark.createDataFrame([(i, t, "en", f"src{i % 5}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def _collapsed(t):
    return re.sub(r"\s+", " ", t).strip().lower()


def test_grounding_contains_items_of_any_length(spark, tmp_path):
    rng = random.Random(4)
    words = [rng.choice("ab cd efg hij kl mno".split()) + rng.choice("xyz") for _ in range(3000)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 3000, 50)]
    items = [" ".join(words[k : k + n]) for n in range(1, 14) for k in range(20, 30)] + [(" ".join(words[k : k + 8]))[1:-1] for k in range(5)] + ["Not There", "of any of them, not even a part of it all"]
    _tables(spark, tmp_path, texts, items)
    want = {}
    for i, x in enumerate(items):
        found = [d for d, t in enumerate(texts) if _collapsed(x) in _collapsed(t)]
        if found:
            want[i] = (len(found), found[0])
    assert {r.item_id: (r.docs, r["first"]) for r in study.grounding_contains(spark, str(tmp_path)).collect()} == want


def test_grounding_faults_of_all_items_and_whole_bodies(spark, tmp_path):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    items = [prose(12) for _ in range(50)]
    texts = [prose(150) for _ in range(140)]  # so that some items have no document
    for i in range(2, 47, 6):  # with a word changed, far into the body
        texts[3 * i] += " " + items[i].replace(" ", " - ", 1) + " end"
    _tables(spark, tmp_path, texts, items)
    want = {}
    for i, item in enumerate(items):
        if 3 * i >= len(texts):
            want[i] = "parent_not_found"
            continue
        body = texts[3 * i]
        excerpt = _collapsed((body[9:89], "", item)[i % 3])
        t, n = _collapsed(body), max(8, len(excerpt))
        ratio = 1.0 if excerpt in t else max(difflib.SequenceMatcher(None, excerpt, t[k : k + n]).ratio() for k in range(0, len(t) - n + 1, n // 2))
        want[i] = "missing_excerpt" if not excerpt else f"weak_grounding:{ratio:.2f}" if ratio < 0.85 else None
    assert {r.item_id: r.fault for r in study.grounding_faults(spark, str(tmp_path)).collect()} == want
