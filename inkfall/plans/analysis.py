"""How text becomes index terms: split at what is neither letter nor digit, lower-cased; folded and stemmed on demand."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfall.functions.lazy import pandas_function

SEPARATORS = r"[^\p{L}\p{N}]+"


def split_terms(c: Column) -> Column:
    """Terms in order, without the empty ones at the edges."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def fold(word: str) -> str:
    """Lower case without diacritics; letters that are no combination, like ß and œ, stay."""
    return "".join(x for x in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(x))


def tokens_of(text: str, stem: bool = False) -> list[str]:
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return [porter(fold(w)) for w in words] if stem else words




def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant, letters beyond a-z count as two consonants."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c" if x.isascii() else "cc"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1:] not in "wxy"


# The suffixes of steps 2, 3 and 4 of the published algorithm (Porter 1980).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a word by Porter's algorithm; words of one or two letters, or with others than a-z, are kept."""
    if len(word) < 3 or not re.fullmatch(r"[^\W\d_]+|.*[a-z]$", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)][-1:] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _ends_cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@pandas_function("string")
def stemmed(s: pd.Series) -> pd.Series:
    """Folded and stemmed terms; meant for the distinct words of a corpus, not for every token."""
    return s.map(lambda w: porter(fold(w)), na_action="ignore")
