"""Stems of English words by Porter's algorithm (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values: (suffix, what takes its place), the longest that fits being tried; the stem before it must have a measure over 0.
DOUBLE = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
SINGLE = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
#: Suffixes that go where the stem before them has a measure over 1.
LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last no w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for n in range(min(7, len(word)), 0, -1):
        if word[-n:] in table:
            return word[:-n] + table[word[-n:]] if _measure(word[:-n]) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a small word; words of one or two letters, and those with other characters than a to z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        base = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if base is not None and "v" in _shape(base):
            double = len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c"
            word = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if double and base[-1] not in "lsz" else base + "e" if _measure(base) == 1 and _short(base) else base
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, DOUBLE), SINGLE)
    for suffix in sorted(LAST, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1] in "st"):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
