"""Stems of English words by Porter's algorithm (1980), and words without diacritics."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published algorithm's steps 2 to 4 and what they become.
STEP2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al "
    "iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
).split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
LONGEST_FIRST = {k: sorted(s, key=len, reverse=True) for k, s in (("2", STEP2), ("3", STEP3), ("4", STEP4))}


def shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(word)))


def ends_short(word: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last one not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def plural(w: str) -> str:
    for ending, rest in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            return w[: -len(ending)] + rest
    return w


def past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for ending in ("ed", "ing"):
        if w.endswith(ending) and "v" in shape(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if doubled(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if measure(w) == 1 and ends_short(w) else w
    return w


def replaced(w: str, step: str, table: dict[str, str]) -> str:
    """Its longest suffix of the table is replaced, if what stands before has a measure."""
    ending = next((e for e in LONGEST_FIRST[step] if w.endswith(e)), None)
    return w[: -len(ending)] + table[ending] if ending and measure(w[: -len(ending)]) else w


def dropped(w: str) -> str:
    ending = next((e for e in LONGEST_FIRST["4"] if w.endswith(e)), None)
    before = w[: -len(ending)] if ending else ""
    return before if ending and measure(before) > 1 and (ending != "ion" or before[-1] in "st") else w


def stem(w: str) -> str:
    """Porter's stem of a word of small letters a to z; other words, and those of one or two letters, stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    w = past(plural(w))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = dropped(replaced(replaced(w, "2", STEP2), "3", STEP3))
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not ends_short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=100_000)
def bare_stem(word: str) -> str:
    """The stem of a word without its diacritics."""
    letters = unicodedata.normalize("NFD", word)
    return stem("".join(c for c in letters if not unicodedata.combining(c)))


def stems(words: Column) -> Column:
    """bare_stem() of a column of words; best of distinct ones."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else bare_stem(w) for w in column], dtype=object)

    return run(words)
