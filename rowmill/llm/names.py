"""Reading people's names into surname, first name and patronymic.

A name is brought to one script and one coarse spelling (ё as е, й as и, no soft and hard
signs; Latin transliteration is turned back), cut into words, and the words are given
roles by the assignment that is likeliest under a lexicon of first names and
patronymics. The lexicon is learned from the data: words that stand before a patronymic,
and patronymics, each with a share of at least ``1 / SHARE``, so it is bounded by
2 * SHARE words whatever the size of the data.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.canonical import weighted
from rowmill.llm.chars import STRICT_LAT_TO_CYR, deletes, plain
from rowmill.session import spread

SHARE = 2000

# Short forms of first names.
SHORT_FORMS = {
    "зина": "зинаида", "боря": "борис", "настя": "анастасия", "ася": "анастасия", "рома": "роман", "игорек": "игорь", "гоша": "игорь", "женя": "евгений евгения", "митя": "дмитрий", "дима": "дмитрий", "макс": "максим",
    "вадик": "вадим", "катя": "екатерина", "юля": "юлия", "ира": "ирина", "тома": "тамара", "аня": "анна", "нюра": "анна", "таня": "татьяна", "оля": "ольга", "маша": "мария", "маруся": "мария", "поля": "полина",
    "лена": "елена", "алена": "елена", "соня": "софья", "наташа": "наталья", "ната": "наталья", "рая": "раиса", "олежка": "олег", "алик": "олег", "люба": "любовь", "юра": "юрий", "света": "светлана", "даша": "дарья", "лара": "лариса",
    "ксюша": "ксения", "люда": "людмила", "люся": "людмила", "мила": "людмила", "валя": "валентина валентин", "лина": "алина", "аля": "алина алла", "вика": "виктория", "андрюша": "андрей", "коля": "николай", "надя": "надежда",
    "эдик": "эдуард", "леня": "леонид", "кирюша": "кирилл", "кира": "кирилл", "паша": "павел", "гриша": "григорий", "гена": "геннадий", "вова": "владимир", "володя": "владимир", "галя": "галина", "петя": "петр", "тимка": "тимур", "тима": "тимур",
    "саша": "александр александра", "шура": "александр александра", "миша": "михаил", "сережа": "сергей", "сеня": "семен", "сема": "семен", "федя": "федор", "витя": "виктор", "леша": "алексей", "алеша": "алексей", "вася": "василий",
    "толя": "анатолий", "ваня": "иван", "нинуля": "нина", "верочка": "вера", "аллочка": "алла", "жанночка": "жанна", "жаня": "жанна", "ниночка": "нина", "нинка": "нина", "веруня": "вера", "аннушка": "анна", "славик": "вячеслав", "слава": "вячеслав", "костя": "константин", "артем": "артем", "егорка": "егор", "илюша": "илья",
}
# Latin transliteration of Russian, longest first.
_BACK = [("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("iu", "ю"), ("yu", "ю"), ("ia", "я"), ("ya", "я"), ("io", "е"), *zip("abvgdezijklmnoprstufyhcqwx", "абвгдезийклмнопрстуфыхккввк")]
_BACK_AT = re.compile("|".join(k for k, _ in _BACK))
_BACK_MAP = {}
for _k, _v in _BACK:
    _BACK_MAP.setdefault(_k, _v)
_TO_LAT = str.maketrans({v: k for k, v in STRICT_LAT_TO_CYR.items()} | {"і": "i", "І": "I"})
_TO_CYR = str.maketrans(STRICT_LAT_TO_CYR | dict(zip("ΑΒΕΗΙΚΜΝΟΡΤΥΧοαε", "АВЕНИКМНОРТУХоае")) | {"i": "и", "I": "И", "і": "и", "І": "И", "0": "о", "3": "з"})
_COARSE = str.maketrans({"ё": "е", "й": "и", "э": "е", "ь": None, "ъ": None})
PATRONYMIC = re.compile(r".{2,}(?:ович|евич|[^аеиоу]ич|овна|евна|инична|[^аеиоу]ична)$")
_TOKEN = re.compile(r"[а-я]+(?:-[а-я]+)*\.?")


def coarse(word: str) -> str:
    return word.lower().translate(_COARSE)


_SHORT = {coarse(k): [coarse(x) for x in v.split()] for k, v in SHORT_FORMS.items()}


def spelled(text: str) -> list[str]:
    """Coarse Cyrillic words of a name; a word of one letter or with a dot is short for more."""
    text = plain(text)
    text = re.sub(r"(?<=\w)[-¬]\s+(?=[а-яёa-z])", "", text)
    text = re.sub(r"(?<=[а-яёa-z])(?=[А-ЯЁA-Z])", " ", text)
    latin = len(re.findall("[a-zA-Z]", text)) > len(re.findall("[а-яёА-ЯЁ]", text))
    text = (text.translate(_TO_LAT) if latin else text.translate(_TO_CYR)).lower()
    if latin:
        text = _BACK_AT.sub(lambda m: _BACK_MAP[m[0]], text)
    return [w if len(w) > 1 else w + "." for w in _TOKEN.findall(text.translate(_COARSE))]


class Lexicon:
    """First names and patronymics with their counts, and lookups within typing errors."""

    def __init__(self, first: dict[str, int], patronymic: dict[str, int]):
        self.first, self.patronymic = first, patronymic
        self.index: dict[str, dict[str, set[str]]] = {}
        for role, words in (("F", first), ("P", patronymic)):
            at = self.index.setdefault(role, {})
            for w in words:
                for d in deletes(w, 2):
                    at.setdefault(d, set()).add(w)
        self.cache: dict[tuple[str, str], tuple[str, float]] = {}

    def near(self, role: str, word: str) -> tuple[str, float]:
        """(the word of the lexicon most likely meant, its cost); ("", 9) if none: the
        noisy channel over the lexicon, typing costs against the log of the counts."""
        key = (role, word)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            words = self.first if role == "F" else self.patronymic
            most = 1.0 if len(word) < 6 else 2.1
            found = [(weighted(word, w, most), -words[w], w) for w in {w for d in deletes(word, 2) for w in self.index[role].get(d, ())}]
            best = min((x for x in found if x[0] <= most), default=(9.0, 0, ""))
            self.cache[key] = (best[2], best[0])
        return self.cache[key]

    def as_first(self, word: str, female: bool) -> tuple[str, float]:
        if word.endswith("."):
            bare = word[:-1]
            fit = [w for w in self.first if w.startswith(bare)] if len(bare) >= 3 else []
            return (max(fit, key=self.first.get), 2.0) if len(fit) == 1 else (bare[0] + ".", 1.0)
        if word in _SHORT:
            full = [w for w in _SHORT[word] if w.endswith(("а", "я")) == female] or _SHORT[word]
            return "|".join(full), 4.5
        if word in self.first:
            return word, 5.0
        w, c = self.near("F", word)
        return (w, 3.2 - c) if w else ("", -2.0)

    def as_patronymic(self, word: str) -> tuple[str, float]:
        if word.endswith("."):
            bare = word[:-1]
            fit = [w for w in self.patronymic if w.startswith(bare)] if len(bare) >= 3 else []
            return (bare + ".", 2.5 if fit else 0.5) if len(bare) >= 3 else (bare[0] + ".", 1.0)
        if word in self.patronymic:
            return word, 6.0
        w, c = self.near("P", word)
        if w and c <= 1.0:
            return w, 4.0 - c
        cut = [w for w in self.patronymic if w.endswith("ич") and w[:-2] in (word, word[:-1])]  # the ending misread or lost
        if cut:
            return cut[0], 3.0
        if w:
            return w, 4.0 - c
        return (word, 3.5) if PATRONYMIC.match(word) else ("", -3.0)


def _apart(words: list[str], lex: Lexicon) -> list[str]:
    """Words that run together are parted at a first name or a patronymic of the lexicon."""
    if len(words) >= 3:
        return words
    out: list[str] = []
    for w in words:
        cut = 0
        if len(w) >= 10 and w not in lex.patronymic and w not in lex.first and "-" not in w:
            cut = next((len(w) - len(p) for p in sorted(lex.patronymic, key=len, reverse=True) if w.endswith(p) and w[: -len(p)] in lex.first), 0)
            cut = cut or next((len(w) - len(f) for f in lex.first if len(f) >= 4 and w.endswith(f) and len(w) - len(f) >= 6), 0)
            cut = cut or next((len(f) for f in lex.first if len(f) >= 5 and w.startswith(f) and len(w) - len(f) >= 7), 0)
        out += [w[:cut], w[cut:]] if cut else [w]
    return out


def _as_surname(word: str, place: int) -> float:
    return (2.2 if "-" in word else 1.5 if len(word) > 3 and not word.endswith(".") else -1.0) + (0.1 if place == 0 else 0)


def _places(words: list[str], lex: Lexicon, female: bool) -> set[tuple[str, ...]]:
    """The assignments of many words of which one is the likeliest: all words are surnames but
    the one that gains most as first name and the one that gains most as patronymic (the two
    that gain most are enough to look at, as they must differ)."""
    best: dict[tuple[str, str], float] = {}
    gains: dict[str, list[tuple[float, int]]] = {"F": [], "P": []}
    for n, w in enumerate(words):
        own = _as_surname(w, n)
        for role, read in (("F", lambda x: lex.as_first(x, female)), ("P", lex.as_patronymic)):
            if (role, w) not in best:
                best[role, w] = read(w)[1]
            gains[role] = sorted([*gains[role], (best[role, w] - own, -n)], reverse=True)[:2]
    out = set()
    for _, i in gains["F"]:
        for _, j in gains["P"]:
            if i != j:
                out.add(tuple("F" if n == -i else "P" if n == -j else "S" for n in range(len(words))))
    return out


def read_name(text: str | None, lex: Lexicon) -> tuple[str, str, str]:
    """(surname, first name, patronymic); a part not written is "", an initial ends in a dot.
    Names without a known first name keep their words, in alphabetical order, as the surname."""
    if not text:
        return "", "", ""
    words = _apart(spelled(text), lex)
    initials = [w for w in words if w.endswith(".") and len(w) == 2]
    rest = [w for w in words if w not in initials]
    if not rest:
        return "", *(initials + ["", ""])[:2]
    female = rest[0].endswith(("а", "я")) or rest[-1].endswith(("а", "я"))
    best: tuple = (-99.0,)
    if len(rest) > 4:
        options = _places(rest, lex, female)
    else:
        options = set(itertools.permutations(["S", "F", "P"][: len(rest)] if len(rest) <= 3 else ["S", "S", "F", "P"]))
    options |= ({("S", "F"), ("F", "S"), ("F", "P"), ("P", "F"), ("S", "P")} if len(rest) == 2 else {("F",), ("S",)} if len(rest) == 1 else set())
    for option in options:
        score, parts = 0.0, {"S": [], "F": "", "P": ""}
        for n, (w, r) in enumerate(zip(rest, option)):
            if r == "S":
                parts["S"].append(w.rstrip("."))
                score += _as_surname(w, n)
            elif r == "F":
                parts["F"], s = lex.as_first(w, female)
                score += s
            else:
                parts["P"], s = lex.as_patronymic(w)
                score += s
        if initials and parts["F"] and parts["P"]:
            score -= 4
        if (score, option) > best[:2]:
            best = (score, option, parts)
    parts = best[2]
    if not parts["F"] and not initials or best[0] < 1.5:
        return " ".join(sorted(w.rstrip(".") for w in rest)), "", ""
    for i in initials:
        if not parts["F"]:
            parts["F"] = i
        elif not parts["P"]:
            parts["P"] = i
    return " ".join(parts["S"]), parts["F"], parts["P"]


def _part(a: str, b: str, lex: dict[str, int]) -> float | None:
    """Log-likelihood that two first names or two patronymics are one; none: they aren't."""
    if a == b:
        return 0.0 if a else -1.5
    if not a or not b:
        return -1.2
    if a.endswith(".") or b.endswith("."):
        return -0.7 if a.rstrip(".").startswith(b.rstrip(".")) or b.rstrip(".").startswith(a.rstrip(".")) else None
    if "|" in a or "|" in b:  # a short form of several names
        return -0.5 if set(a.split("|")) & set(b.split("|")) else None
    if a in lex and b in lex:
        return None
    c = weighted(a, b, 2.1)
    return -1.5 * c if c <= 2.1 else None


def likelihood(a: tuple[str, str, str], b: tuple[str, str, str], lex: Lexicon) -> float | None:
    """Log-likelihood that spelling ``a`` was meant as ``b``; none: they are different people."""
    if not a[0] or not b[0]:
        surname = -3.0
    elif a[0] == b[0]:
        surname = 0.0
    else:
        if " " in a[0] + b[0] and {a[0].count(" "), b[0].count(" ")} == {0, 1}:  # words without roles against surname and initial
            (one, other) = (a, b) if " " not in a[0] else (b, a)
            left = other[0].split()
            if one[0] in left and one[1] and not other[1]:
                left.remove(one[0])
                return -0.7 if left[0].startswith(one[1].rstrip(".")) else None
            return None
        c = weighted(a[0], b[0], 2.1 if min(len(a[0]), len(b[0])) >= 6 else 1.1)
        if c == float("inf"):
            halves = ("-" in a[0]) != ("-" in b[0]) and (a[0] in b[0].split("-") or b[0] in a[0].split("-"))
            if not halves:
                return None
            c = 1.0
        surname = -1.6 * c
    first, father = _part(a[1], b[1], lex.first), _part(a[2], b[2], lex.patronymic)
    if first is None or father is None:
        return None
    return surname + first + father


_PAIR = pa.schema([("role", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def learn(names: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(first names, patronymics) with counts, learned from the column ``full_name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = spelled(name)
                for i, w in enumerate(words[1:], 1):
                    if PATRONYMIC.match(w) and len(words) == 3 and len(words[i - 1]) > 2 and not words[i - 1].endswith("."):
                        out += [("F", words[i - 1], n), ("P", w, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, _PAIR)], schema=_PAIR)

    counted = names.filter("full_name IS NOT NULL").groupBy("full_name").agg(F.count("*").alias("n"))
    words = counted.select("full_name", "n").mapInArrow(run, "role string, word string, n long").groupBy("role", "word").agg(F.sum("n").alias("n"))
    total = words.groupBy("role").agg(F.sum("n").alias("total"))  # two rows
    kept = words.join(F.broadcast(total), "role").filter(F.col("n") * SHARE >= F.col("total")).filter("n > 1").select("role", "word", "n").collect()  # at most SHARE words a role
    return {r.word: r.n for r in kept if r.role == "F" and r.word not in _SHORT}, {r.word: r.n for r in kept if r.role == "P"}


@lru_cache(maxsize=4)
def _lexicon(first: tuple, patronymic: tuple) -> Lexicon:
    return Lexicon(dict(first), dict(patronymic))


def frozen(learned: tuple[dict[str, int], dict[str, int]]) -> tuple[tuple, tuple]:
    return tuple(sorted(learned[0].items())), tuple(sorted(learned[1].items()))


_READ = pa.schema([("full_name", pa.string()), ("surname", pa.string()), ("first", pa.string()), ("father", pa.string())])


def read_names(names: DataFrame, learned: tuple[tuple, tuple]) -> DataFrame:
    """full_name, surname, first, father of every distinct non-null ``full_name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(*learned)
        for b in batches:
            texts = b.column(0).to_pylist()
            parts = [read_name(t, lex) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (texts, *(zip(*parts) if parts else [[]] * 3))], schema=_READ)

    return spread(names.select("full_name").filter("full_name IS NOT NULL").distinct(), "full_name").mapInArrow(run, "full_name string, surname string, first string, father string")
