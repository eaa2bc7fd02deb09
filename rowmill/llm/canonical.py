"""Freely typed values mapped to the entries of a reference list.

The words of all entries form a dictionary; every word is indexed under itself and under
what is left of it after up to ``depth`` deletions (symmetric delete), so a typed word
meets each dictionary word within that many edits without a scan. The reference list is
fixed and small, its index goes to the workers with the function (its size is checked).
Typed words found this way vote for entries; entries are ranked by the weighted
Damerau-Levenshtein cost of their key words, then by how often the entry occurs
verbatim, then by id. A value none of whose entries has all its key words is a miss.

Distinct values are mapped, not rows: a value that fills a third of the table is
mapped once.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.chars import cyrillic, deletes, plain
from rowmill.session import spread

_VOWELS = set("аеиоуыэюя")
# Letters that keyboards and scanners confuse.
_NEAR = {frozenset(p) for p in ("ил", "нп", "шщ", "гт", "ао", "еи", "ое", "цщ", "ьъ", "пл", "нк", "вы", "чс", "рп", "тг", "иц", "ен")}


def weighted(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein cost; inf beyond ``most``. Swapped neighbours, doubled
    letters, one vowel for another and letters often confused cost less than other edits."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most + 1:
        return float("inf")
    before: list[float] = []
    prev = [0.0]
    for j in range(1, len(b) + 1):
        prev.append(prev[-1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i, x in enumerate(a, 1):
        gap = 0.7 if i > 1 and x == a[i - 2] else 1.0
        row = [prev[0] + gap]
        for j, y in enumerate(b, 1):
            if x == y:
                swap = prev[j - 1]
            else:
                swap = prev[j - 1] + (0.8 if x in _VOWELS and y in _VOWELS or frozenset((x, y)) in _NEAR else 1.0)
            best = min(prev[j] + gap, row[-1] + (0.7 if j > 1 and y == b[j - 2] else 1.0), swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return float("inf")
        before, prev = prev, row
    return prev[-1] if prev[-1] <= most else float("inf")


@dataclass(frozen=True)
class Field:
    """How the values of one field are read.

    optional: words that identify nothing (matched fuzzily, then dropped); phrases:
    (pattern, expansion) of fixed short forms; initials: entries may be written as the
    first letters of the parts of their key word and of the words in this field.
    """

    optional: tuple[str, ...] = ()
    phrases: tuple[tuple[str, str], ...] = ()
    initials: str = ""
    tolerance: dict[str, float] = field(default_factory=dict)


# Words without weight and short forms of the three fields.
FIELDS = {
    "issued_by": Field(
        ("района", "району", "район", "город", "города", "вербограда", "вербоград", "по"),
        (
            (r"\bо\.?\s?в\.?\s?д\b\.?", "отдел внутренних дел "), (r"\bо\.?\s?м\.?\s?у\b\.?", "отделение миграционного учета "), (r"\bп\s?/\s?с\b\.?|\bп\.\s?с\.", "паспортный стол "),
            (r"\bр-?н[ауе]?\b\.?|\bр-он[ау]?\b\.?", "района "), (r"\b(?:гор|г)\.\s?|\bг\s", "город "),
            (r"\bотд\.\s?(?=м)", "отделение "), (r"\bотд\.\s?(?=в)", "отдел "), (r"\bмиграц\.?\s", "миграционного "), (r"\bвн(?:утр)?\.\s?", "внутренних "), (r"\bпасп(?:орт)?\.\s?", "паспортный "),
        ),
    ),
    "district": Field(("район", "района"), ((r"\bр-?о?н[ауе]?\b\.?:?", "район "),)),
    "administrative_okrug": Field(("административный", "округ", "адм", "окр", "ао"), ((r"\bа\.\s?о\.?$", "ао"), (r"\bадм\.", "адм "), (r"\bокр\.", "окр ")), initials="ао"),
}

_WORD = re.compile(r"[а-яa-z]+(?:-[а-яa-z]+)*\.?|\d+")


def words_of(value: str, f: Field) -> list[str]:
    text = re.sub(r"(?<=[а-яё])(?=[А-ЯЁ][а-яё])", " ", plain(value))
    text = cyrillic(text).lower().replace("ё", "е")
    for pattern, full in f.phrases:
        text = re.sub(pattern, full, text)
    return _WORD.findall(text)


def _most(word: str) -> float:
    n = len(word)
    return 1.0 if n <= 3 else 1.6 if n <= 5 else 2.1 if n <= 8 else 3.0


class Lookup:
    """The entries of one field: (ref_id, name, frequency)."""

    def __init__(self, entries: list[tuple[int, str, int]], f: Field, depth: int = 2):
        self.f, self.depth, self.cache = f, depth, {}
        self.entries: list[tuple[int, list[str], int, str]] = []
        self.index: dict[str, set[str]] = {}
        self.whole: dict[str, set[int]] = {}
        for n, (ref, name, count) in enumerate(entries):
            keys = [w.rstrip(".") for w in words_of(name, f)]
            keys = [w for w in dict.fromkeys(keys) if w not in f.optional]
            self.entries.append((ref, keys, count, name))
            for w in keys:
                for d in deletes(w, depth):
                    self.index.setdefault(d, set()).add(w)
            for d in deletes("".join(keys), 1):
                self.whole.setdefault(d, set()).add(n)
        self.longest_whole = max((len("".join(keys)) for _, keys, _, _ in self.entries), default=0)
        self.drop: dict[str, set[str]] = {}
        for w in f.optional:
            for d in deletes(w, depth if len(w) > 4 else 0):
                self.drop.setdefault(d, set()).add(w)
        self.by_word: dict[str, set[int]] = {}
        for n, (_, keys, _, _) in enumerate(self.entries):
            for w in keys:
                self.by_word.setdefault(w, set()).add(n)
        self.ordered = sorted(self.by_word)
        self.longest = max(map(len, self.ordered), default=0)
        self.heads: dict[str, set[tuple[str, int]]] = {}  # beginnings of words, less up to one letter
        for w in self.ordered:
            for n in range(4, len(w) + 1):
                for d in deletes(w[:n], 1):
                    self.heads.setdefault(d, set()).add((w, n))

    def near(self, word: str) -> dict[str, float]:
        """Dictionary words that ``word`` may stand for, with their costs."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[word] = self._near(word)
        return found

    def _near(self, word: str) -> dict[str, float]:
        bare = word.rstrip(".")
        found: dict[str, float] = {}
        if len(bare) > self.longest + self.depth:
            return found  # longer than any word within reach
        for d in deletes(bare, self.depth):
            for w in self.index.get(d, ()):
                if w not in found and (c := weighted(bare, w, _most(w))) < float("inf"):
                    found[w] = c + (1.1 if len(w) > 3 and w[0] != bare[:1] else 0.0)  # first letters are seldom mistyped
        dotted = word.endswith(".")
        if dotted and len(bare) >= 3 or len(bare) >= 5:
            at = bisect.bisect_left(self.ordered, bare)
            while at < len(self.ordered) and self.ordered[at].startswith(bare):
                w = self.ordered[at]
                if len(w) > len(bare):
                    found[w] = min(found.get(w, 9.0), 0.4 if dotted else 0.3 * (len(w) - len(bare)))
                at += 1
        if dotted and len(bare) >= 4:
            for w, n in {x for d in deletes(bare, 1) for x in self.heads.get(d, ())}:
                if n - len(bare) in (0, 1) and len(w) > len(bare) and w[0] == bare[0] and not w.startswith(bare) and (c := weighted(bare, w[:n], 1.0)) <= 1.0:
                    found[w] = min(found.get(w, 9.0), 0.8 + c)
        return found

    def acronym(self, words: list[str]) -> int | None:
        tail = self.f.initials
        letters = "".join(w.rstrip(".") for w in words)
        if not tail or not letters.endswith(tail) or not len(tail) < len(letters) <= len(tail) + 3 or any(len(w.rstrip(".")) > len(letters) for w in words):
            return None
        head = letters[: -len(tail)]
        fit = [ref for ref, keys, _, _ in self.entries if keys and re.match(head[0] + "".join(rf".*[ое]{x}" for x in head[1:]), keys[0])]
        if len(head) == 1:  # a lone letter stands for a name that is not made of parts
            short = [ref for ref, keys, _, _ in self.entries if keys and keys[0][0] == head]
            fit = short if len(short) == 1 else fit
        return fit[0] if len(fit) == 1 else None

    def find(self, value: str) -> tuple[int, float]:
        """(ref_id, cost) of the entry meant; (-1, inf) if none."""
        typed = words_of(value, self.f)
        seen: dict[str, float] = {}
        for w in typed:
            for k, c in self.near(w).items():
                seen[k] = min(seen.get(k, 9.0), c)
        best: tuple = (float("inf"), 0, 0)
        if (short := self.acronym(typed)) is not None:
            best = (0.1, 0, short)  # only a name that is written out is a better candidate
        ranked = set().union(*(self.by_word[k] for k in seen)) if seen else set()
        for n in ranked:
            ref, keys, count, _ = self.entries[n]
            if keys and all(k in seen for k in keys):
                best = min(best, (sum(seen[k] for k in keys), -count, ref))
        if best[0] == float("inf"):  # words run together or apart
            joined = "".join(w.rstrip(".") for w in typed if not self._idle(w))
            if 5 <= len(joined) <= self.longest_whole + 1:
                for n in {n for d in deletes(joined, 1) for n in self.whole.get(d, ())}:
                    ref, keys, count, _ = self.entries[n]
                    c = weighted(joined, "".join(keys), 2.0)
                    best = min(best, (c, -count, ref))
        return (best[2], best[0]) if best[0] < float("inf") else (-1, float("inf"))

    def _idle(self, word: str) -> bool:
        bare = word.rstrip(".")
        return bare in self.f.optional or any(weighted(bare, w, 1.6) <= 1.6 for d in deletes(bare, 1) for w in self.drop.get(d, ()))


MAX_ENTRIES = 100_000


@lru_cache(maxsize=2)
def _lookups(fields: tuple) -> tuple[dict[str, Lookup], dict[tuple[str, str], int]]:
    """The indexes of all fields, built once in a worker."""
    return {k: Lookup(list(v), FIELDS.get(k, Field())) for k, v in fields}, {(k, name): ref for k, v in fields for ref, name, _ in v}


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """field_name, value, n, ref_id, cost of every distinct value.

    values: field_name, value (rows as they come; nulls are dropped); reference: field_name,
    ref_id, canonical_name. Values equal to a name are their own entry at cost 0. Blank
    values and values of fields without entries are misses (ref_id -1, cost null).
    """
    counted = values.filter(F.col("value").isNotNull()).groupBy("field_name", "value").agg(F.count("*").alias("n"))
    names = reference.select("field_name", "ref_id", F.col("canonical_name").alias("value"))
    used = names.join(counted, ["field_name", "value"], "left").select("field_name", "ref_id", "value", F.coalesce("n", F.lit(0)).alias("n")).limit(MAX_ENTRIES + 1).collect()
    if len(used) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries; split it by field")
    fields: dict[str, list[tuple[int, str, int]]] = {}
    for r in used:
        fields.setdefault(r.field_name, []).append((r.ref_id, r.value, r.n))

    sent = values.sparkSession.sparkContext.broadcast(tuple(sorted((k, tuple(sorted(v))) for k, v in fields.items())))  # at most MAX_ENTRIES names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookups, exact = _lookups(sent.value)
        for pdf in batches:
            got = [
                (exact[f, v], 0.0) if (f, v) in exact else lookups[f].find(v) if f in lookups else (-1, float("inf"))
                for f, v in zip(pdf["field_name"], pdf["value"])
            ]
            pdf["ref_id"] = [int(r) for r, _ in got]
            pdf["cost"] = [None if c == float("inf") else float(c) for _, c in got]
            yield pdf

    return spread(counted, "value").mapInPandas(run, "field_name string, value string, n long, ref_id int, cost double")
