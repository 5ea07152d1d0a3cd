"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), run once for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings of steps 2, 3 and 4 with what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and words with others than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive forms
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (ending := _longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    # longer endings, one of each step
    for endings in (STEP_2, STEP_3):
        ending = _longest(word, endings)
        if ending and measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + endings[ending]
    ending = _longest(word, STEP_4)
    if ending and measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    # a last e, a double l
    if word.endswith("e"):
        count = measure(word[:-1])
        if count > 1 or (count == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if measure(word) > 1 and _doubled(word) and word[-1] == "l" else word


def with_stems(rows: DataFrame, term: str = "term") -> DataFrame:
    """Rows with `stem`. Each distinct term is stemmed once and joined back, so Python sees the vocabulary, not the corpus."""

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    known = rows.select(term).where(F.col(term).isNotNull()).distinct().withColumn("stem", stemmed(term))
    return rows.join(known, term, "left")
