"""Text of scanned pages: what the scanner did to it, and the text repaired.

Two passes. The first counts: words, hyphenated words, lines. From the counts come

* corrections: words that are rare meet frequent words through a join on positional
  q-grams; boosted trees rank the pairs by what the confusions of the corpus, the counts
  and the place of the difference say; the confusions themselves are learned from the
  pairs. The trees are fitted to frequent words that were misread on purpose (by the
  learned confusions) against pairs of frequent words that are merely alike;
* running headers: short lines that come back in many texts, are complete in themselves and
  stand after all sorts of lines, where labels and values always follow the same ones;
* labels that have a number of their own before them.

The second pass reads each text line by line. Patterns nominate; classifiers of line pairs,
boosted trees fitted to the sample, decide (see :func:`fit_judges`): whether a line between
two others is furniture (a header, a page mark, a number alone on its line), which goes
first, so a word broken around it is whole again; whether a hyphen between two pieces is a
break; and which of the remaining lines continue each other. Learned headers and explicit page
marks inside a line are found there.

Counts cover all texts. Only fits use samples: at most ``SAMPLE`` word pairs and
``SAMPLE_TEXTS`` texts, chosen by hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.boosting import Boosted
from rowmill.llm.chars import osa
from rowmill.session import written

SAMPLE, SAMPLE_TEXTS, MAX_SENT = 20_000, 2_000, 3_000_000
#: Keys that a task counts before it hands them on.
KEYS = 100_000
_C = "а-яё"
_WORD = re.compile(rf"[{_C}]{{2,}}")
_LONG = re.compile(rf"[{_C}][{_C}]{{3,}}+")
# Two or three letters are a word only if nothing adjoins them: 'V-НВ' is a series, 'на(' a piece of a word.
_ADJOINS = r"\w@€<('/¬-"
_WHOLE = re.compile(rf"[{_C}][{_C}]++(?:(?<=[{_C}]{{4}})|(?![{_ADJOINS}])(?:(?<=[{_C}]{{3}})(?<![,{_ADJOINS}][{_C}]{{3}})|(?<![{_C}]{{3}})(?<![,{_ADJOINS}][{_C}]{{2}})))")
_HYPHENED = re.compile(rf"(?<![{_C}-])[{_C}]{{2,}}-[{_C}]{{2,}}(?![{_C}-])")
_TOKEN = re.compile(r"[^\s\"«»;:!?№\[\]]+")
_BLANK = re.compile(r"[\s\"«»;:!?№\[\]]")  # what ends a token
_BROKEN = re.compile(rf"(?<=[{_C}])\s?[-¬]\s?\n\s*(?=[{_C}])")
_LINE_END = re.compile(r"[-¬]\s?\n")
_FOREIGN = re.compile(rf"[іѵ€@<]|[{_C}][a-z']|[a-z'][{_C}]|[{_C}]\([{_C}]+[^)]*$|[{_C}]/[01][{_C}]")
_DIGIT = re.compile(rf"[{_C}]\d{{1,2}}[{_C}]")
# The same letters in both cases, spelled out as patterns that ignore case are slow.
_CYR, _LAT = "а-яёА-ЯЁ\u1c80-\u1c86", "a-zA-Z\u0130\u0131\u017f\u212a"
_SUSPECT = re.compile(rf"[іѵІѴ€@<{_LAT}'(/\d](?:(?<=[іѵІѴ€@<])|(?<=[{_CYR}].)|(?=[{_CYR}])(?<=[{_LAT}']))")
_END = re.compile(rf"[{_C}]\s?[-¬‐]\s?$", re.I)
_FILLED, _SIGNS, _NO_WORD = re.compile(r"\S+"), re.compile(r"[^\w@€(<']+"), re.compile(r"[^\w@€(<]")
_NUMBERS = re.compile(r"\s*\d[\d. ]{5,}$")
_HYPHEN, _LAST, _FIRST = re.compile(r"\s?[-¬‐]\s?$"), re.compile(rf"[{_CYR}]+$"), re.compile(rf"[{_CYR}]+")
_LETTERS = re.compile(rf"[{_C}a-z]+")
_LETTER = re.compile(f"[{_CYR}]")
_AFTER = re.compile(rf"[-¬] [{_CYR}]{{2}}")
_INSIDE = re.compile(rf"(?<![{_C}-])([{_C}]{{2,}})[-¬] ([{_C}]{{2,}})", re.I)
_EXPLICIT = re.compile(r"^\W*([a-zа-яёі€@(0-9/<',. ]{0,12}?)[.,]?\s*(\d{1,3})\s*(из|/|и3)?\s*(\d{1,3})?\W*$", re.I)
_FRAMED = re.compile(r"^[\[(—–-]\s*\d{1,3}\s*[\])—–-]$")
_ANY_DIGIT = re.compile(r"\d")
_LONE = re.compile(r"^\d{1,2}$")
_DATE = re.compile(r"\d[\d. :/]*")
# Words that name a page.
PAGE_WORDS = ("стр", "страница", "лист", "с")
_OTHER_CASES = {"листа", "листе", "листу", "листы", "листов", "страницы", "странице", "страницу", "страниц"}
_IN_LINE = re.compile(r"(?<!\S)(?:[-—–] \d{1,2} [-—–]|\[\d{1,3}\]|[сСcC\u1c83]\. ?\d{1,2}/\d{1,2}|([%s%s€@(0-9/<']{3,9})[.,]? ?(?<!\d)(\d{1,3})(\s(?:[иИ][зЗ]|[иИ]3|/) ?\d{1,3})?)(?!\S)" % (_CYR, _LAT))
_HOUSE = re.compile(r"(?:\b(?:д|дом|к|кор|корп|корпус)[.,]? ?№? ?[\d/]+ ?[а-я]?|корпус -|к\. -)[,.]?\s*$", re.I)
_FLAT = re.compile(r"\s*(?:[,;]|кв\b|квартира|оф\b)", re.I)


def joined(text: str) -> str:
    """The text with words that are broken across a line end closed (for counting)."""
    return _BROKEN.sub("", text) if _LINE_END.search(text) else text


def noisy_token(token: str) -> bool:
    """A Cyrillic word with signs in it that no word has."""
    t = token.lower().strip(".,")
    t = t if "(" in t else t.rstrip(")")
    t = t[1:] if t[:1] == "(" else t
    return bool(_FOREIGN.search(t)) or not t[:1].isdigit() and bool(_DIGIT.search(t))


@lru_cache(maxsize=200_000)
def line_key(line: str) -> str:
    return " ".join(_LETTERS.findall(_DATE.sub(" ", line.lower())))


def before_key(line: str) -> str:
    """The key of a line before another one; long lines are marked, as no header is that long."""
    key = line_key(line)
    return "#" if not key else key if len(key) <= 40 else "+" + key


def odd_tokens(text: str) -> list[str]:
    out, end = [], 0
    for m in _SUSPECT.finditer(text):  # what is suspect lies within one token
        at = m.start()
        if at < end:
            continue
        while at and not _BLANK.match(text, at - 1):
            at -= 1
        t = _TOKEN.match(text, at)[0]
        end = at + len(t)
        if noisy_token(t) and _LETTER.search(t):
            out.append(t)
    return out


_COUNT = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("hits", pa.int64())])


def count_corpus(texts: DataFrame) -> DataFrame:
    """kind, key, n, hits. kind: ``word`` (odd ones too), ``hyphened``, ``line`` (hits: the next
    line goes on in small letters), ``before`` (a line and, after a tab, the one before it), ``label`` (hits: with a number alone on the line before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hyphened, line_n, line_hits, before_n, label_hits = counters = [Counter() for _ in range(6)]

        def counted() -> pa.RecordBatch:
            out = [("line", k, c, line_hits.get(k, 0)) for k, c in line_n.items()] + [("label", k, c, label_hits.get(k, 0)) for k, c in line_n.items()] + [("before", k, c, 0) for k, c in before_n.items()] + [(k, w, c, 0) for k, own in (("word", found), ("hyphened", hyphened)) for w, c in own.items()]
            for c in counters:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, _COUNT)], schema=_COUNT)

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                whole = joined(text)
                low = whole.lower()
                found.update(_WHOLE.findall(low))
                found.update(t.lower().strip(".,)(") for t in odd_tokens(whole))
                if "-" in low:
                    hyphened.update(_HYPHENED.findall(low))
                lines = [x.strip() for x in text.split("\n")]
                for i, line in enumerate(lines):
                    if not line or len(line) > 80 or not line[0].isupper() or line[-1] in ".,":
                        continue
                    key = line_key(line)
                    line_n[key] += 1
                    before = lines[i - 1] if i else ""
                    after = lines[i + 1] if i + 1 < len(lines) else ""
                    if after and after[0].islower():
                        line_hits[key] += 1
                    if ":" not in line and 10 <= len(line) <= 70 and not page_mark(line):
                        before_n[f"{key}\t{'^' if not before or page_mark(before) else before_key(before)}"] += 1
                    if _LONE.match(before):
                        label_hits[key] += 1
            if sum(map(len, counters)) > KEYS:  # counts of several batches are handed on together, as far as memory allows
                yield counted()
        yield counted()

    counted = texts.select("text").mapInArrow(run, "kind string, key string, n long, hits long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


# Corrections ------------------------------------------------------------------------------


def difference(seen: str, meant: str) -> tuple[str, str, int, int]:
    """(part of ``seen``, part of ``meant``, letters before, letters after) once the common
    beginning and end are taken off."""
    a = 0
    while a < min(len(seen), len(meant)) and seen[a] == meant[a]:
        a += 1
    z = 0
    while z < min(len(seen), len(meant)) - a and seen[-1 - z] == meant[-1 - z]:
        z += 1
    return seen[a : len(seen) - z], meant[a : len(meant) - z], a, z


def features(seen: str, meant: str, n: int, m: int, confusions: dict[tuple[str, str], float]) -> list[float]:
    x, y, a, z = difference(seen, meant)
    rate = confusions.get((y, x), 0.0)
    if not rate and len(x) == len(y) > 1:
        parts = [confusions.get((q, p), 0.0) for p, q in zip(x, y) if p != q]
        rate = min(parts) / 10 if parts else 0.0
    foreign = float(bool(re.search(rf"[^{_C}-]", seen)))
    return [np.log(rate + 1e-6), np.log(m + 1.0) - np.log(n + 1.0), float(len(x)), float(len(y)), float(a), float(z), foreign, float(len(meant)), float(abs(len(x) - len(y)))]


def _grams(word: "F.Column", size: int, shifts: tuple[int, ...]) -> "F.Column":
    at = F.sequence(F.lit(1), F.length(word) - size + 1)
    one = lambda i: F.array(*[F.concat_ws("|", F.lit(str(size)), (i + s).cast("string"), F.substring(word, i, F.lit(size))) for s in shifts])
    return F.when(F.length(word) >= size, F.flatten(F.transform(at, one))).otherwise(F.array().cast("array<string>"))


def _one_less(word: "F.Column") -> "F.Column":
    """The word and the word less one letter: two words one edit apart share one of these."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.lit("-|"), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.concat(F.array(F.concat(F.lit("-|"), word)), less)


def candidate_pairs(words: DataFrame, ratio: int = 8, least: int = 12) -> DataFrame:
    """word, n, meant, m: rare or odd words with frequent words that share a q-gram near its
    place (three letters, four in long words) or, in words under eight letters, are one edit
    away, and are within a third of its length in edits."""
    w = words.filter(F.length("key") >= 2).select(F.col("key").alias("word"), "n")
    known = w.filter((F.col("n") >= least) & F.col("word").rlike(f"^[{_C}]+$")).select(F.col("word").alias("meant"), F.col("n").alias("m"))
    long_ = F.length("meant") >= 8
    known = known.withColumn("gram", F.explode(F.when(long_, _grams(F.col("meant"), 4, (0,))).otherwise(F.array_distinct(F.concat(_grams(F.col("meant"), 3, (0,)), _one_less(F.col("meant")))))))
    short = F.when(F.length("word") <= 8, _one_less(F.col("word"))).otherwise(F.array().cast("array<string>"))
    seen = w.withColumn("gram", F.explode(F.array_distinct(F.concat(_grams(F.col("word"), 3, (-2, -1, 0, 1)), _grams(F.col("word"), 4, (-2, -1, 0, 1)), short))))
    met = seen.join(known, "gram").filter((F.col("m") >= ratio * F.col("n")) & (F.abs(F.length("word") - F.length("meant")) <= 3))
    met = met.select("word", "n", "meant", "m").dropDuplicates(["word", "meant"])
    pure = F.col("word").rlike(f"^[{_C}]+$")
    edits = F.levenshtein("word", "meant")
    return met.filter((edits <= F.when(pure, 2).otherwise(F.least(F.lit(5), F.ceil(F.length("meant") / 2)))) & (edits > 0))


def learn_confusions(pairs: DataFrame, share: float = 0.0025) -> dict[tuple[str, str], float]:
    """(meant, seen) parts with their share of all single differences; only those of at
    least ``share``, so at most 1 / share of them. Each word counts with its nearest, most frequent neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for w, n, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, y, _, z = difference(w, m)
                if len(x) <= 3 and len(y) == 1 and (z > 2 or re.search(rf"[^{_C}]", x)):  # endings change for other reasons
                    c[y, x] += n
            out = [(y, x, k) for (y, x), k in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["meant", "seen", "n"])

    nearest = pairs.filter(F.col("m") >= 12 * F.col("n")).groupBy("word", "n").agg(F.max_by("meant", F.struct(-F.levenshtein("word", "meant"), "m", "meant")).alias("meant"))
    sums = nearest.select("word", "n", "meant").mapInArrow(run, "meant string, seen string, n long").groupBy("meant", "seen").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 1
    kept = sums.filter(F.col("n") >= share * total).collect()
    return {(r.meant, r.seen): r.n / total for r in kept}


def fit_ranker(known: list[tuple[str, int]], alike: list[tuple[str, int, str, int]], confusions: dict[tuple[str, str], float]) -> Boosted:
    """Trees that tell a misread word from another word (see the module)."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    by_letter: dict[str, list[tuple[str, float]]] = {}
    for (y, x), r in confusions.items():
        by_letter.setdefault(y, []).append((x, r))
    for w, m in known:
        places = [i for i, ch in enumerate(w) if ch in by_letter]
        for i in rng.permutation(places)[:3]:
            options = by_letter[w[i]]
            x = options[int(rng.integers(len(options)))][0]
            bad = w[:i] + x + w[i + 1 :]
            rows.append(features(bad, w, max(1, int(m * rng.choice([0.001, 0.003, 0.01, 0.03, 0.08]))), m, confusions))
            labels.append(1.0)
    for w, n, v, m in alike:
        rows.append(features(w, v, max(1, int(n * rng.choice([0.01, 0.05, 0.2, 1.0]))), m, confusions))
        labels.append(0.0)
    return Boosted().fit(np.array(rows).reshape(len(rows), 9), np.array(labels))


def corrections(words: DataFrame) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """(word, meant, score) of misread words, and the confusions learned. Score >= 0.5; the
    best candidate of each word, ties by its count and order."""
    words = written(words, "words")
    pairs = written(candidate_pairs(words), "pairs")
    confusions = learn_confusions(pairs)
    known = words.filter((F.col("n") >= 50) & F.col("key").rlike(f"^[{_C}]{{2,}}$")).orderBy(F.xxhash64("key")).limit(SAMPLE // 4).select("key", "n").collect()
    top = {r.key for r in known}
    near = known and words.filter((F.col("n") >= 50) & F.col("key").rlike(f"^[{_C}]{{2,}}$"))
    alike = []
    if known:
        two = candidate_pairs(near, ratio=1).filter("n < m").orderBy(F.xxhash64("word", "meant")).limit(SAMPLE).collect()
        # Frequent words that differ by a learned confusion may be misread themselves; they are no examples.
        alike = [(r.word, r.n, r.meant, r.m) for r in two if (lambda d: (d[1], d[0]) not in confusions or r.n * 20 > r.m)(difference(r.word, r.meant))]
    model = fit_ranker([(r.key, r.n) for r in known if r.key in top], alike, confusions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n, v, m = (b.column(i).to_pylist() for i in range(4))
            x = np.array([features(*t, confusions) for t in zip(w, v, n, m)]).reshape(len(w), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(model.score(x))], names=["word", "meant", "m", "score"])

    scored = pairs.select("word", "n", "meant", "m").mapInArrow(run, "word string, meant string, m long, score double").filter("score >= 0.5")
    best = scored.groupBy("word").agg(F.max_by(F.struct("meant", "score"), F.struct("score", "m", "meant")).alias("b"))
    best = best.select("word", "b.meant", "b.score")
    for _ in range(3):  # a word misread twice may meet one misread once; counts rise eightfold with each step, so 8 steps reach the end
        best = written(best, "best")
        best = best.join(best.select(F.col("word").alias("meant"), F.col("meant").alias("root")), "meant", "left").select("word", F.coalesce("root", "meant").alias("meant"), "score")
    return best, confusions


# Lines ------------------------------------------------------------------------------------


class Forms:
    """What the counts say about lines: running headers, and labels with a number before them."""

    def __init__(self, headers: list[str], numbered: list[str], hyphened: list[str]):
        self.headers, self.numbered, self.hyphened = set(headers), set(numbered), set(hyphened)
        self.parts = [(h, len(h), {h[i : i + 3] for i in range(len(h) - 2)}) for h in headers]
        self.cache: dict[str, bool] = {}
        self.places: dict[str, list[tuple[int, list[str]]]] = {}  # a word of a header: its place, the header
        for h in sorted(headers, key=lambda x: (-len(x), x)):
            for i, w in enumerate(h.split()):
                if len(w) >= 4:
                    self.places.setdefault(w, []).append((i, h.split()))

    def words(self, text: str) -> set[str]:
        """The words of headers that stand in a text in small letters."""
        return self.places.keys() & _LONG.findall(text)

    def inside(self, line: str, words: set[str] | None = None) -> list[tuple[int, int]]:
        """Places of headers within a longer line: the longest header around a word that was read right.
        words: those of headers in the whole text, if they are known."""
        low = line.lower()
        if not any(w in low for w in words) if words is not None else self.places.keys().isdisjoint(_WORD.findall(low)):
            return []
        tokens = [(x, m.start(), m.end()) for m in _FILLED.finditer(low) if (x := m[0] if m[0].isalnum() else _SIGNS.sub("", m[0]).strip("(")) and not x.isdigit()]
        out: list[tuple[int, int]] = []
        stop = 0
        for t, (word, _, _) in enumerate(tokens):
            best = None
            for i, words in self.places.get(word, ()):
                a, z = t - i, t - i + len(words)
                if a < stop or z > len(tokens) or line[tokens[a][1]].islower() or best and z - a <= best[1] - best[0]:
                    continue
                h = " ".join(words)
                if osa(" ".join(x[0] for x in tokens[a:z]), h, max(2, len(h) // 5)) <= max(2, len(h) // 5):
                    best = a, z
            if best:
                out.append((tokens[best[0]][1], tokens[best[1] - 1][2]))
                stop = best[1]
        return out

    def header(self, line: str) -> bool:
        if not 10 <= len(line) <= 80 or line[-1] in ".," or line[0].islower():
            return False
        hit = self.cache.get(line)
        if hit is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            hit = self.cache[line] = self._header(line)
        return hit

    def _header(self, line: str) -> bool:
        key = line_key(line)
        if key in self.headers:
            return True
        plain = line.lower()
        plain = (_NUMBERS.sub("", plain) if plain[-1] in ". " or plain[-1].isdigit() else plain).strip()
        parts = [x for x in self.parts if abs(len(plain) - x[1]) <= 8]
        grams = {plain[i : i + 3] for i in range(len(plain) - 2)} if parts else set()
        for h, n, own in parts:
            if len(grams & own) >= 0.35 * len(own) and osa(_SIGNS.sub(" ", plain).strip(), h, max(2, n // 4)) <= max(2, n // 4):
                return True
        return False


def page_mark(line: str) -> bool:
    """An unmistakable page or sheet number."""
    if len(line) > 24 or not _ANY_DIGIT.search(line):
        return False
    if _FRAMED.match(line):
        return True
    m = _EXPLICIT.match(line)
    if not m:
        return False
    word = m[1].lower()
    word = word if word.isalnum() else _NO_WORD.sub("", word)
    if word == "с" or word == "c":
        return bool(m[3]) or line.lower().startswith(("с.", "c."))
    return len(word) >= 3 and any(osa(word, w, 2) <= (0 if len(w) < 4 and len(word) < 3 else 1 if len(w) < 6 else 2) for w in PAGE_WORDS[:3])


@lru_cache(maxsize=100_000)
def _page_word(word: str, of: bool) -> bool:
    if word in _OTHER_CASES or sum(c.isdigit() for c in word) > 1:
        return False
    if word == "стр" or re.search(rf"[^{_C}]", word) and len(word) == 3 and osa(word, "стр", 1) <= 1:
        return True
    return len(word) >= 4 and (osa(word, "лист", 1) <= (1 if of or re.search(rf"[^{_C}]", word) else 0) or osa(word, "страница", 2) <= 2)


def cut_marks(line: str, forms: Forms, words: set[str] | None = None) -> tuple[str, str, set[str]]:
    """The line without the headers and page marks that stand inside it, what was cut out,
    and the kinds of it. 'стр. 2' in an address is a building. words: those of headers in the whole text, if they are known."""
    spans = [(a, z, "header") for a, z in forms.inside(line, words)] if words is None or words else []
    if _ANY_DIGIT.search(line):
        for m in _IN_LINE.finditer(line):
            if m[1] and not _page_word(m[1].lower(), bool(m[3])):
                continue
            if m[1] and len(m[1]) == 3 and not m[3] and (_HOUSE.search(line[: m.start()]) or _FLAT.match(line, m.end())):
                continue
            if not any(a < m.end() and m.start() < z for a, z, _ in spans):
                spans.append((*m.span(), "pagenum"))
    if not spans:
        return line, "", set()
    left, cut, at = [], [], 0
    for a, z, _ in sorted(spans):
        left.append(line[at:a].strip())
        cut.append(line[a:z])
        at = z
    left.append(line[at:].strip())
    return " ".join(x for x in left if x), "\n".join(cut), {k for _, _, k in spans}


def person_like(line: str) -> bool:
    words = line.split()
    return 2 <= len(words) <= 4 and all(w[0].isupper() and not w[0].isdigit() for w in words) and line[-1] not in ".:;," and not any(w.isdigit() for w in words)


class Judge:
    """A classifier over few discrete features, each combination of which is scored once."""

    def __init__(self, model: Boosted):
        self.model, self.known = model, {}

    def __call__(self, x: tuple[float, ...]) -> bool:
        if x not in self.known:
            self.known[x] = bool(self.model.score(np.array([x]))[0] >= 0.5)
        return self.known[x]


def line_features(before: str, line: str, after: str, taken: bool, forms: Forms) -> tuple[float, ...]:
    """What a nominated line and its neighbours say about it. taken: the value of the name before it was seen."""
    lone = bool(_LONE.match(line))  # only a number alone may be a value
    return (
        float(page_mark(line)), float(bool(line) and forms.header(line)), float(lone), float(lone and bool(before) and person_like(before) and not taken), float(lone and line_key(after) in forms.numbered),
        float(lone and bool(re.fullmatch(r"\d+/\d+", before))), float(before[-1:] == ":"), float(after[:1].islower()),
    )


def break_features(left: str, right: str, sign: str, ends_line: bool, forms: Forms, known) -> tuple[float, ...]:
    """What two pieces and the sign between them say about it."""
    whole = (left + right).lower()
    return (float(sign == "¬"), float(ends_line), float(right[:1].islower()), float(f"{left}-{right}".lower() in forms.hyphened), float(known(whole)), float(known(right.lower())))


def fit_judges(texts: list[str], forms: Forms, known) -> tuple[Judge, Judge]:
    """(furniture, breaks): classifiers of line pairs, fitted to what the sample leaves no doubt about.

    Furniture: explicit marks and learned headers are; a number alone on its line is where an
    explicit mark might stand, or if the lines around it stand side by side elsewhere; it is not beside a label that has numbers
    before it or behind a name. Lines nobody nominates are not. Breaks: a hyphen is one if the
    closed word is known, or if its second piece is none; it is not in a word that is
    written with a hyphen, or between two known words that make none.
    """
    beside: set[tuple[str, str]] = set()
    split = [[x for x in (y.strip() for y in t.split("\n")) if x] for t in texts]
    for lines in split:
        beside.update(zip(map(line_key, lines), map(line_key, lines[1:])))
    rows: list[tuple] = []
    labels: list[float] = []
    pieces: list[tuple] = []
    closed: list[float] = []
    for lines in split:
        for i, line in enumerate(lines):
            before, after = lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""
            x = line_features(before, line, after, False, forms)
            value = x[3] or x[4]
            if x[0] or x[1]:
                rows.append(x)
                labels.append(1.0)
                if x[0]:  # where a mark stands, a number alone might stand
                    rows.append(line_features(before, "1", after, False, forms))
                    labels.append(1.0)
            elif not x[2]:
                if i % 8 == 0:  # most lines are of this kind
                    rows.append(x)
                    labels.append(0.0)
            elif value or before and after and (line_key(before), line_key(after)) in beside:
                rows.append(x)
                labels.append(float(not value))
            for left, sign, right, ends in _pieces(line, after):
                y = break_features(left, right, sign, ends, forms, known)
                if y[0] or y[3] or y[4] or y[5] or ends:
                    pieces.append(y)
                    closed.append(float(bool(y[0] or not y[3] and y[2] and (ends or y[4] or not y[5]))))
    for w in sorted(forms.hyphened)[:SAMPLE]:  # written with a hyphen and broken there
        left, _, right = w.partition("-")
        for ends in (True, False):
            pieces.append(break_features(left, right, "-", ends, forms, known))
            closed.append(0.0)
    for w in sorted({w for lines in split for line in lines for w in _WORD.findall(line.lower()) if len(w) >= 6 and known(w)})[: SAMPLE // 4]:  # broken on purpose
        for sign, ends in (("-", True), ("-", False), ("¬", True)):
            pieces.append(break_features(w[:3], w[3:], sign, ends, forms, known))
            closed.append(1.0)
    fit = lambda x, y, n: Judge(Boosted(rounds=30).fit(np.array(x, float).reshape(len(x), n), np.array(y)))
    return fit(rows, labels, 8), fit(pieces, closed, 6)


def _pieces(line: str, after: str) -> Iterator[tuple[str, str, str, bool]]:
    """(piece, sign, piece, whether a line ends between them) of the possible breaks of a line."""
    for m in _INSIDE.finditer(line):
        yield m[1], m[0][len(m[1])], m[2], False
    if after and line[-1:] in "-¬‐" and _END.search(line):
        left = re.search(rf"[{_C}]+$", re.sub(r"\s?[-¬‐]\s?$", "", line), re.I)
        right = re.match(rf"[{_C}]+", after, re.I)
        if left and right:
            yield left[0], line.rstrip()[-1], right[0], True


def nominate(line: str, forms: Forms) -> str:
    """``header`` or ``pagenum`` for a line that looks like one, else ""."""
    return "" if not line else "header" if forms.header(line) else "pagenum" if page_mark(line) else ""


def furniture(lines: list[str], forms: Forms, judge: Judge, nominated: list[str] | None = None) -> list[str]:
    """``header``, ``pagenum`` or "" for each line. nominated: what :func:`nominate` says of them, if it is known."""
    kinds = nominated or [nominate(x, forms) for x in lines]
    filled = [i for i, x in enumerate(lines) if x]
    for j, i in enumerate(filled):  # marks and headers
        if kinds[i] and not judge(line_features(lines[filled[j - 1]] if j else "", lines[i], lines[filled[j + 1]] if j + 1 < len(filled) else "", False, forms)):
            kinds[i] = ""
    body = [i for i in filled if not kinds[i]]
    taken = False
    for j, i in enumerate(body):
        if not _LONE.match(lines[i]):
            taken = False
            continue
        before = lines[body[j - 1]] if j else ""
        after = lines[body[j + 1]] if j + 1 < len(body) else ""
        if not judge(line_features(before, lines[i], after, taken, forms)):
            taken = True
        else:
            kinds[i] = "pagenum"
            # the line before this one may still be the value of a name: keep looking from it
            if j:
                lines_before = [k for k in body[:j] if not kinds[k]]
                taken = bool(lines_before) and _LONE.match(lines[lines_before[-1]]) is not None
    return kinds


def close_words(lines: list[str], forms: Forms, known, judge: Judge) -> tuple[list[str], bool]:
    """Lines with broken words closed, and whether there were any."""
    out: list[str] = []
    found = False
    for line in lines:
        if out and line and line[0].islower() and out[-1][-1:] in "-¬‐" and _END.search(out[-1]):
            head = _HYPHEN.sub("", out[-1])
            left = _LAST.search(head)
            right = _FIRST.match(line)
            if judge(break_features(left[0] if left else "", right[0] if right else "", out[-1].rstrip()[-1], True, forms, known)):
                found = True
                first, _, rest = line.partition(" ")
                out[-1] = head + first
                if rest:
                    out.append(rest)
                continue
        out.append(line)
    for i, line in enumerate(out):
        if ("- " in line or "¬ " in line) and _AFTER.search(line):

            def close(m: re.Match) -> str:
                nonlocal found
                if judge(break_features(m[1], m[2], m[0][len(m[1])], False, forms, known)):
                    found = True
                    return m[1] + m[2]
                return m[0]

            out[i] = _INSIDE.sub(close, line)
    return out, found


def pair_features(a: str, b: str, forms: Forms) -> list[float]:
    last = a[-1]
    return [float(last in ".!?"), float(last in ":;"), float(last.islower() or last == ","), float(b[0].islower()), float(b[0].isdigit()), float(len(a)), float(len(b)), float(line_key(b) in forms.numbered or b[-1] == ":"), float(person_like(a) or person_like(b))]


def fit_joiner(texts: list[str], forms: Forms) -> Boosted:
    """Trees that tell lines that continue each other from lines that don't. Two lines of the
    sample go together if the words at the break stand side by side within some line, and
    apart if both are known but never do and a capital follows."""
    inside: set[tuple[str, str]] = set()
    words: Counter = Counter()
    for t in texts:
        for line in t.split("\n"):
            ws = _WORD.findall(line.lower())
            words.update(ws)
            inside.update(zip(ws, ws[1:]))
    rows, labels = [], []
    for t in texts:
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        for a, b in zip(lines, lines[1:]):
            x, y = _WORD.findall(a.lower()), _WORD.findall(b.lower())
            if x and y and words[x[-1]] > 3 and words[y[0]] > 3:
                together = (x[-1], y[0]) in inside
                if together or not b[0].islower():
                    rows.append(pair_features(a, b, forms))
                    labels.append(float(together))
    return Boosted(rounds=25).fit(np.array(rows).reshape(len(rows), 9), np.array(labels))


def examine(text: str, forms: Forms, fixes: dict[str, str], known, judges: tuple[Judge, Judge], joiner: Boosted | None = None) -> tuple[set[str], str | None]:
    """(kinds of noise, repaired text; the latter only with a joiner)."""
    lines = [x.strip() for x in text.split("\n")]
    found: set[str] = set()
    cuts: list[str] = []
    nominated = [nominate(x, forms) for x in lines]
    words = forms.words(text.lower())
    for i, x in enumerate(lines):
        if len(x) > 5 and not nominated[i] and (words or _ANY_DIGIT.search(x)):
            lines[i], cut, inside = cut_marks(x, forms, words)
            if inside:
                cuts.append(cut)
                found |= inside
                nominated[i] = nominate(lines[i], forms)
    kinds = furniture(lines, forms, judges[0], nominated)
    found |= {k for k in kinds if k}
    body = [x for x, k in zip(lines, kinds) if not k]
    body, broken = close_words(body, forms, known, judges[1])
    if broken:
        found.add("hyphen")
    # Characters misread in a header count too, so all lines are looked at.
    whole = "\n".join(body) + "\n" + "\n".join([*(x for x, k in zip(lines, kinds) if k), *cuts])
    if not fixes.keys().isdisjoint(_WHOLE.findall(whole.lower())) or odd_tokens(whole):
        found.add("chars")
    if joiner is None:
        return found, None

    def repair(m: re.Match) -> str:
        w = m[0]
        core = w.strip(".,)(")
        meant = fixes.get(core.lower())
        if not meant or not core or len(core) < 4 and re.fullmatch(f"[{_C}]+", core, re.I) and core.lower() not in _WHOLE.findall(m.string[max(0, m.start() - 1) : m.end() + 1].lower()):
            return w
        return w.replace(core, meant.upper() if core.isupper() else meant.capitalize() if core[0].isupper() else meant, 1)

    body = [re.sub(r"[^\s\"«»;:!?№\[\]-]+", repair, x) for x in body]
    filled = [x for x in body if x]
    paragraphs: list[str] = []
    if len(filled) > 1:
        p = joiner.score(np.array([pair_features(a, b, forms) for a, b in zip(filled, filled[1:])]))
    for i, x in enumerate(filled):
        if i and p[i - 1] >= 0.5:
            paragraphs[-1] += " " + x
        else:
            paragraphs.append(x)
    return found, "\n".join(paragraphs)


@lru_cache(maxsize=2)
def _forms(headers: tuple, numbered: tuple, hyphened: tuple) -> Forms:
    return Forms(list(headers), list(numbered), list(hyphened))


_FOUND = pa.schema([("field_name", pa.string()), ("record_key", pa.string()), ("noise_kinds", pa.list_(pa.string())), ("text", pa.string())])


def running_headers(counts: DataFrame, n_texts: int) -> list[str]:
    """Keys of the lines that come in one text of 400 or more, are no running text, and stand
    after all sorts of other lines (first lines, page marks and other such lines before them
    don't count). At most 400 for each line of a text, whatever the number of texts."""
    lines = counts.filter("kind = 'line' AND n >= 5 AND hits <= 0.7 * n").filter(F.size(F.split("key", " ")).between(2, 8)).filter(F.col("n") * 400 >= n_texts).select("key", "n")
    pair = counts.filter("kind = 'before'").select(F.split("key", "\t").alias("k"), "n").select(F.col("k")[0].alias("key"), F.col("k")[1].alias("before"), F.col("n").alias("m"))
    pair = pair.join(lines, "key").filter("before <> '^'").join(lines.select(F.col("key").alias("before")), "before", "left_anti")
    places = pair.groupBy("key", "n").agg(F.count("*").alias("kinds"), F.max("m").alias("top"), F.sum("m").alias("m"))
    return [r.key for r in places.filter("kinds >= 3 AND top <= 0.6 * m AND m >= 0.15 * n").select("key").collect()]


def hyphened_words(counts: DataFrame) -> list[str]:
    """All words truly written with a hyphen; their number is checked as that of the vocabulary."""
    found = counts.filter("kind = 'hyphened' AND n >= 3").select("key").limit(MAX_SENT + 1).toPandas()
    if len(found) > MAX_SENT:
        raise ValueError("the hyphenated words are beyond what may be sent to the workers; split the texts by field")
    return found["key"].tolist()


def clean(texts: DataFrame, repaired: bool = False) -> DataFrame:
    """field_name, record_key, noise_kinds (sorted), text (repaired, or null if not asked for).

    texts: field_name, record_key, text. Null and blank texts have no noise and stay as they are.
    """
    texts = written(texts.select("field_name", "record_key", "text"), "texts")
    counts = written(count_corpus(texts), "counts")
    total = counts.filter("kind = 'line'").agg(F.sum("n")).first()[0] or 0
    headers = running_headers(counts, texts.filter(F.col("text").contains("\n")).count())
    numbered = [r.key for r in counts.filter("kind = 'label' AND n >= 5 AND hits >= 0.5 * n AND key <> ''").filter(F.col("n") * 2_000 >= total).collect() if not person_like(r.key.title())]
    hyphened = hyphened_words(counts)
    words = counts.filter("kind = 'word'").select("key", "n")
    fixes_df, _ = corrections(words)
    fixes_df = written(fixes_df, "fixes")
    common = words.filter(F.col("key").rlike(f"^[{_C}]+$") & (F.col("n") >= 5)).join(fixes_df.select(F.col("word").alias("key")), "key", "left_anti")
    spark = texts.sparkSession
    fixed, usual = fixes_df.limit(MAX_SENT + 1).toPandas(), common.select("key").limit(MAX_SENT + 1).toPandas()  # one run each; both sizes are checked
    if len(fixed) > MAX_SENT or len(usual) > MAX_SENT:
        raise ValueError("the vocabulary is beyond what may be sent to the workers; split the texts by field")
    sent = spark.sparkContext.broadcast((dict(zip(fixed["word"], fixed["meant"])), set(usual["key"])))
    keys = tuple(sorted(headers)), tuple(sorted(numbered)), tuple(sorted(hyphened))
    sample = [r.text for r in texts.filter("text IS NOT NULL").orderBy(F.xxhash64("record_key")).limit(SAMPLE_TEXTS).select("text").collect()]
    forms_ = Forms(*map(list, keys))
    judges = fit_judges(sample, forms_, sent.value[1].__contains__)
    joiner = fit_joiner(sample, forms_) if repaired else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _forms(*keys)
        fixes, common_words = sent.value
        for b in batches:
            kinds, out = [], []
            for text in b.column(2).to_pylist():
                found, fixed = examine(text, forms, fixes, common_words.__contains__, judges, joiner) if text and text.strip() else (set(), text)
                kinds.append(sorted(found))
                out.append(fixed if repaired else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], schema=_FOUND)

    return texts.mapInArrow(run, "field_name string, record_key string, noise_kinds array<string>, text string")
