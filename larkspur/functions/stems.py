"""English stems (the published algorithm of 1980) and accent folding of terms.

Every distinct term is stemmed once per Python worker and batch of arrays; terms with
other characters than a to z, and those of one or two letters, stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what they become, in the order of the published steps.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How many times a run of consonants follows a run of vowels."""
    shape = _shape(word)
    return sum(a + b == "vc" for a, b in zip(shape, shape[1:]))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel and a consonant other than w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _without_inflection(word: str) -> str:
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _without_inflection(word)
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    if word.endswith("e"):
        n = _measure(word[:-1])
        word = word[:-1] if n > 1 or (n == 1 and not _short(word[:-1])) else word
    return word[:-1] if word.endswith("l") and _doubled(word) and _measure(word) > 1 else word


@lru_cache(maxsize=200_000)
def folded(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def stemmed(terms: Column) -> Column:
    """Array of terms to the array of their stems, accents folded; null stays null."""

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda words: None if words is None else [stem(folded(w)) for w in words])

    return run(terms)
