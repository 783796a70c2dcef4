"""The Snowball stemmer for English (Porter 2), as a function of a word and as a column function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm's definition: words with a stem of their own, words that are left as they are (from the start, and after
# the plural step), beginnings whose end is the first region, and the endings of the steps.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_WHOLE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_BEGINNINGS = ("gener", "commun", "arsen")
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    start = next((len(b) for b in _BEGINNINGS if word.startswith(b)), None)
    if start is None:
        start = found.end() if (found := _REGION.search(word)) else len(word)
    return start, found.end() if (found := _REGION.search(word, start)) else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and re.search("[aeiouy]", word[:-2]) else word


def _past(word: str, first: int) -> str:
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= first else word
    if not re.search("[aeiouy]", rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", rest):
        return rest[:-1]
    return rest + "e" if _SHORT.search(rest) and len(rest) <= first else rest


def _derived(word: str, first: int, second: int) -> str:
    end = _longest(word, _STEP_2)
    if end is not None and len(word) - len(end) >= first:
        rest = word[: -len(end)]
        if not (end == "ogi" and not rest.endswith("l") or end == "li" and not rest.endswith(tuple("cdeghkmnrt"))):
            word = rest + _STEP_2[end]
    end = _longest(word, _STEP_3)
    if end is not None and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + _STEP_3[end]
    end = _longest(word, _STEP_4)
    if end is not None and len(word) - len(end) >= second and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        at = len(word) - 1
        return word[:-1] if at >= second or at >= first and not _SHORT.search(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and len(word) - 1 >= second else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and what is no word, are left as they are."""
    if len(word) < 3 or word in _OWN:
        return _OWN.get(word, word)
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = _plural(re.sub("('s'|'s|')$", "", word))
    if word in _WHOLE:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    return _derived(word, first, second).replace("Y", "y")


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """The stem of each word of a column; null stays null."""
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: [stem(w) for w in words], na_action="ignore")
