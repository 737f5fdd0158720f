"""The Porter stemmer (published algorithm of 1980) and tokenising, for the full-text index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"

#: Suffix tables of steps 2 to 4 (fixed values of the algorithm).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in _VOWELS or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            return head + table[suffix] if _measure(head) >= least else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            head = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2, 1), STEP3, 1)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head[-1:] in ("s", "t")):
                word = head
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def terms(text: str | None) -> list[str]:
    return [stem(t) for t in TOKEN.findall((text or "").lower())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def terms_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(terms)
