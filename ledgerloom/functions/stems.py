"""The Porter stemmer, with the usual extensions, and the stems of token arrays."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

#: Words whose stems no rule gives.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what replaces them where a syllable or more remains, tried in this order.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words whose stems are remembered by a worker.
MOST = 100_000


def _shape(word: str) -> str:
    """v for vowels, and for y behind a consonant; c for the rest."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How many runs of vowels a run of consonants follows."""
    return len(re.findall("v+c+", _shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or shape == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + put
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _final_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c" else word


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    """By the first rule whose suffix the word has, if a syllable remains."""
    for suffix, put in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + put if _measure(stem) else word
    return word


def _step_2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]):
        return _step_2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) else word
    return _replaced(word, STEP_2)


def _step_4(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else word
    return word


def _step_5(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        word = stem if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@functools.lru_cache(maxsize=MOST)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two characters are their own."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _step_5(_step_4(_replaced(_step_2(word), STEP_3)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Tokens of more than three characters as their stems; null arrays stay null."""
    return pd.Series([None if row is None else [stem(t) if len(t) > 3 else t for t in row] for row in tokens])
