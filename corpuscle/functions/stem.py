"""English stemming by the published Porter2 rules, as a pandas UDF with a bounded table of words in each worker."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Endings and exceptions of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWELS = "aeiouy"
LI_AFTER = "cdeghkmnrt"


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    def after(at: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in UNCHANGED:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals and the like
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w
    # past and progressive forms
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if end == "li":
            w = before if before and before[-1] in LI_AFTER else w
        elif end == "ogi":
            w = before + "og" if before.endswith("l") else w
        else:
            w = before + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stemmed(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stems(text: Column) -> Column:
    """Stems of a text's tokens, in order."""
    return F.pandas_udf(_stemmed, "array<string>")(tokens(text))


def stem_map(text: Column) -> Column:
    """The stem of each of a text's tokens, for expressions over arrays, in which no UDF may stand."""
    words = F.array_distinct(tokens(text))
    return F.map_from_arrays(words, F.pandas_udf(_stemmed, "array<string>")(words))
