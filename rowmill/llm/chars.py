"""Character folding shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

# Latin and Greek letters that look like a Cyrillic letter, and back.
CYR_LOOK = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсух", "ABESIJKMHOPCTYXaesijopcyx"))
LAT_TO_CYR = dict(zip("ABEKMHOPCTYXaekmopcyxuntbrgd", "АВЕКМНОРСТУХаекморсухиптьгдд"))
STRICT_LAT_TO_CYR = dict(zip("ABCEHKMOPTXYaceopxyk", "АВСЕНКМОРТХУасеорхук"))
GREEK_TO_CYR = dict(zip("ΑΒΕΗΙΚΜΝΟΡΤΥΧΓΠΦΛαεικορτυχνγπ", "АВЕНІКМNОРТУХГПФЛаеікортухνгп"))
INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­͏؜᠎︀-️ᅟᅠㅤ]")
HYPHENS = re.compile("[‐-―−﹘﹣－]")
_SPACES = re.compile(r"[\s  -   　]+")
_STRICT = str.maketrans(STRICT_LAT_TO_CYR | {k: v for k, v in GREEK_TO_CYR.items() if v in "АВЕНКМОРТУХГПФЛаекортухгп"})
_MIXED = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """Composed, without invisible characters, ordinary hyphens and single spaces."""
    text = unicodedata.normalize("NFKC", text.replace("№", "\ue000")).replace("\ue000", "№")
    return _SPACES.sub(" ", HYPHENS.sub("-", INVISIBLE.sub("", text))).strip()


def cyrillic(text: str) -> str:
    """Look-alike Latin and Greek letters become Cyrillic in words that have a
    Cyrillic letter and in words made of look-alikes only."""

    def fold(m: re.Match) -> str:
        w = m.group()
        folded = w.translate(_STRICT)
        return folded if all("Ѐ" <= c <= "ӿ" for c in folded) else w

    return _MIXED.sub(fold, text)


def osa(a: str, b: str, most: int = 99) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions); ``most + 1`` if beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def deletes(word: str, depth: int) -> set[str]:
    """``word`` and everything left of it after up to ``depth`` deletions."""
    found = layer = {word}
    for _ in range(depth):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        found = found | layer
    return found
