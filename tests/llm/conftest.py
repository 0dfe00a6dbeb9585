import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, doc string, rank int, component_id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, characters of every width."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage, hot = prose(120), prose(25), "the very same line in very many documents of this corpus here"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "fr", None), (4, None, None, "b"), (5, "", "en", ""), (6, " \n\t ", "en", "b"), (None, base, "en", "c"), (None, passage, None, None)]
    rows += [(7, "x", "en", "a"), (8, "x", "en", "a"), (9, "one two", "fr", "c"), (10, "One TWO", "fr", "c"), (11, "日本語 " * 40, "ja", "日"), (12, "日本語 " * 41, "ja", "日"), (13, "𝕏é \x00</s>[INST]<0x0A> ▁▁ " * 9, None, "z"), (14, "!!! ### 123", "en", "z")]
    rows += [(20 + k, prose(30) + "\n" + passage + "\n" + prose(20 + k), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(15)]
    rows += [(60 + k, prose(15) + " " + hot + " " + prose(15), "en", "hot") for k in range(40)]
    copy = base.split()
    for k in range(25):  # near copies
        c = list(copy)
        c[rng.randrange(len(c))] = f"edit{k}"
        rows.append((200 + k, " ".join(c), "en", "a"))
    rows += [(300, prose(20_000), "en", "long"), (301, "ab" * 40_000, "en", "long"), (2, "another version of two", "en", "a")]
    return [(i, t, lang, source, len(t or ""), "own", None, "own", 0, "own") for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With further columns whose names operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
