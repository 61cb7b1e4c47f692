"""Porter's stemmer (1980) and the column function that applies it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The algorithm's published suffix rules.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v or c for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _m(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a small-letter word; words of other than a-z, or of one or two letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    again = False
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old) and "v" in _shape(word[: -len(old)]):
                word, again = word[: -len(old)], True
                break
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _m(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        for old in sorted(rules, key=len, reverse=True):
            if word.endswith(old):
                if _m(word[: -len(old)]) > 0:
                    word = word[: -len(old)] + rules[old]
                break
    for old in sorted((*STEP4, "ion"), key=len, reverse=True):
        if word.endswith(old):
            rest = word[: -len(old)]
            if _m(rest) > 1 and (old != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _m(rest) > 1 or (_m(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of arrays of words; each distinct word of a batch is stemmed once."""
    for batch in batches:
        held = batch.notna()
        flat = np.concatenate([np.empty(0, object), *batch[held]])
        places, words = pd.factorize(flat)
        stems = np.array([stem(w) for w in words], object)[places] if len(flat) else flat
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        ends = np.cumsum([len(w) for w in batch[held]])[:-1]
        for at, found in zip(np.flatnonzero(held), np.split(stems, ends), strict=False):
            out.iat[at] = found.tolist()
        yield out


@F.pandas_udf(StringType())
def stem_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of words; each distinct word of a batch is stemmed once."""
    for batch in batches:
        places, words = pd.factorize(batch)
        yield pd.Series(np.array([*map(stem, words), None], object)[places], index=batch.index)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters below the marks, by Unicode's decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain_letters()


def tokens(text: Column, fold: bool = True) -> Column:
    """Runs of letters and digits, small; fold: without marks on Latin letters."""
    small = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.translate(small, MARKED.lower() + MARKED, PLAIN.lower() + PLAIN) if fold else small, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
