"""Tokens of full-text search: folded case, no diacritics, runs of letters and digits, Porter stems.

Written from the published description of the Porter algorithm.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}]+").findall
_VOWELS = "aeiou"

# The suffix rules of steps 2, 3 and 4 as published.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# The longest suffix counts.
_LONG2, _LONG3, _LONG4 = sorted(_STEP2, key=lambda r: -len(r[0])), sorted(_STEP3, key=lambda r: -len(r[0])), sorted(_STEP4, key=len, reverse=True)


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _replaced(w: str, rules, least: int) -> str:
    for suffix, to in rules:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + to if _measure(stem) > least else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or len(w) > 20 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if _has_vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _LONG2, 0)
    w = _replaced(w, _LONG3, 0)
    for suffix in _LONG4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    """Tokens of a text in order."""
    folded = (text or "").lower()
    if not folded.isascii():
        folded = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    return [stem(w) for w in _WORD(folded)] if stemmed else _WORD(folded)
