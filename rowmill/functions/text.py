"""Scalar text functions as Column expressions; each is null-safe (null in, null out)."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

C = "А-Яа-яЁё"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def ws(x: Column | str) -> Column:
    """White space of any kind squeezed to one space, none outside."""
    return F.trim(F.regexp_replace(_c(x), r"[\s  -  　]+", " "))


def canon(x: Column | str) -> Column:
    """The key for comparisons: small letters, ё as е, dashes as spaces, letters and digits only."""
    v = F.translate(F.lower(_c(x)), "ё", "е")
    v = F.regexp_replace(v, "[-‐-―]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, "[^0-9a-zа-я ]+", " "), " +", " "))


# Latin letters and the Cyrillic letters they stand for in mixed words.
LATIN, CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"


def cyrillic_lookalikes(x: Column | str) -> Column:
    """Latin look-alikes become Cyrillic where both scripts stand in the text."""
    v = _c(x)
    return F.when(v.rlike("[A-Za-z]") & v.rlike(f"[{C}]"), F.translate(v, LATIN, CYRILLIC)).otherwise(v)


# Latin letters of names and the Cyrillic ones they stand for.
NAME_LATIN, NAME_CYRILLIC = "AaBCcEeHIiKMOoPpRrTVvXxYy", "АаВСсЕеНІиКМОоРрРрТВвХхУу"


def name_words(x: Column | str) -> Column:
    """Latin letters of names in Cyrillic: in words of both scripts, and in Latin words of at most four
    letters that begin with a capital; longer Latin words stay."""
    word = lambda w: F.when(w.rlike("[A-Za-z]") & (w.rlike(f"[{C}]") | w.rlike("^[A-Z][A-Za-z-]{0,3}$")), F.translate(w, NAME_LATIN, NAME_CYRILLIC)).otherwise(w)
    return F.array_join(F.transform(F.regexp_extract_all(_c(x), F.lit(f"([A-Za-z{C}-]+|[^A-Za-z{C}-]+)"), F.lit(1)), word), "")


def decimal_text(x: Column | str) -> Column:
    """Comma as point, two digits after it, cut and not rounded; null if it is no number."""
    v = F.translate(F.trim(_c(x)), ",", ".")
    whole, rest = F.substring_index(v, ".", 1), F.when(v.contains("."), F.substring_index(v, ".", -1)).otherwise("")
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), F.concat(whole, F.lit("."), F.rpad(F.substring(rest, 1, 2), 2, "0")))


def phone(x: Column | str) -> Column:
    """+7(XXX)XXX-XX-XX for eleven digits that begin with 7, else the text as it is."""
    d = F.regexp_replace(_c(x), r"\D", "")
    part = lambda a, n: F.substring(d, a, n)
    return F.when(d.rlike(r"^7\d{10}$"), F.concat(F.lit("+7("), part(2, 3), F.lit(")"), part(5, 3), F.lit("-"), part(8, 2), F.lit("-"), part(10, 2))).otherwise(_c(x))


def file_name(x: Column | str) -> Column:
    """Characters that file systems mind become _; a blank name becomes document.pdf."""
    v = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), f"[^0-9A-Za-z{C}._ -]+", "_"))
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("document.pdf"))


def ocr_date(x: Column | str) -> Column:
    """dd.mm.yyyy from eight digits, some read as letters; day to 31, month to 12, years 2000-2099."""
    d = F.regexp_replace(F.translate(F.upper(_c(x)), "OОILZSBЗ", "00117583"), r"\D", "")
    day, month, year = F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 4)
    fits = d.rlike(r"^\d{8}$") & day.between("01", "31") & month.between("01", "12") & year.between("2000", "2099")
    return F.when(fits, F.concat_ws(".", day, month, year))


def partial_date(x: Column | str) -> Column:
    """d.m.yy and its like as dd.mm.yyyy; two-digit years above 30 belong to the last century."""
    v = F.translate(F.trim(_c(x)), "/-", "..")
    d, m, y = (F.regexp_extract(v, r"^(\d{1,2})\.(\d{1,2})\.(\d{2}|\d{4})$", i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 4, y).when(y > "30", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.when(d != "", F.concat_ws(".", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), year))


def real_date(x: Column | str) -> Column:
    return F.try_to_date(_c(x), "dd.MM.yyyy")


def dates_in(x: Column | str) -> Column:
    """All dd.mm.yyyy of a text, in order."""
    return F.regexp_extract_all(_c(x), F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))


def latest_date(x: Column | str) -> Column:
    """The latest date in the text that exists in the calendar."""
    return F.array_max(F.transform(dates_in(x), real_date))


def check_digit(base: Column | str) -> Column:
    """Check digit over the digits of ``base``: weights 1, 2, 1, ... from the left, sums of two
    digits, the complement to ten."""
    b = _c(base)
    digits = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(b, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(digits, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.when(b.rlike(r"^\d+$"), F.pmod(-total, F.lit(10)))


def name_parts(x: Column | str) -> Column:
    """struct(last_name, first_name, middle_name): first, second and the remaining words."""
    w = F.split(ws(x), " ")
    return F.struct(F.nullif(F.get(w, F.lit(0)), F.lit("")).alias("last_name"), F.get(w, F.lit(1)).alias("first_name"), F.nullif(F.array_join(F.slice(w, F.lit(3), F.greatest(F.lit(0), F.size(w))), " "), F.lit("")).alias("middle_name"))


def title_case(x: Column | str) -> Column:
    """Each run of letters begins with a capital, after hyphens too."""
    runs = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([^a-zа-яё]+|[a-zа-яё]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, F.lit(2), F.length(r)))), "")


def merge_hyphens(x: Column | str) -> Column:
    """A word that ends in a hyphen takes the next word, in small letters."""
    words = F.split(ws(x), " ")
    step = lambda acc, w: F.when(
        (F.size(acc) > 0) & F.element_at(acc, -1).endswith("-"),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.regexp_replace(F.element_at(acc, -1), "-$", ""), F.lower(w)))),
    ).otherwise(F.array_append(acc, w))
    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), " ")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


# Rule tables ----------------------------------------------------------------------------


def apply_literals(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in their order."""
    return functools.reduce(lambda v, r: F.replace(v, F.lit(r[0]), F.lit(r[1])), rules, x)


def apply_patterns(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern replacements in their order (Java syntax, $1 for groups)."""
    return functools.reduce(lambda v, r: F.regexp_replace(v, r[0], r[1]), rules, x)


def apply_contains_all(x: Column, rules: list[tuple[list[str], str]], otherwise: Column | None = None) -> Column:
    """The value of the first rule all of whose parts stand in the text."""
    low = F.lower(x)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for parts, value in rules:
        out = out.when(functools.reduce(lambda a, b: a & b, [low.contains(p) for p in parts]), F.lit(value))
    return out.otherwise(otherwise if otherwise is not None else F.lit(None).cast("string"))


# Confidences ----------------------------------------------------------------------------


def _points(*conditions: tuple[Column, float], start: float) -> Column:
    total = functools.reduce(lambda a, c: a + F.when(c[0], c[1]).otherwise(0.0), conditions, F.lit(start))
    return F.round(clamp(total, 0.0, 1.0), 4)


# Words that are no names.
NO_NAMES = ["Российская", "Федерация", "Документ"]
# Places and words that a name column holds beside names.
NAME_STOPS = ["Россия", "Российская", "Федерация", "Узбекистан", "Украина", "Москва", "Ташкент", "Анджелес", "Штат", "Калифорния", "Татарская", "Нурлат", "Ворошиловград", "Алтайского", "Барнаул", "заявитель"]


def name_tokens(x: Column | str) -> Column:
    w = F.transform(F.split(ws(x), " "), lambda t: F.btrim(t, F.lit(" ,.;:()[]{}\"'")))
    return F.filter(w, lambda t: t != "")


def name_confidence(x: Column | str) -> Column:
    """Confidence in a person's name, 0 to 1, by its words."""
    v, t = _c(x), name_tokens(x)
    score = _points(
        (F.size(t) >= 2, 0.15), (F.size(t) >= 3, 0.2), (F.forall(t, lambda a: a.rlike(f"[A-Za-z{C}]")), 0.1), (F.forall(t, lambda a: ~a.rlike(r"\d")), 0.05),
        (F.exists(t, lambda a: a.isin(NO_NAMES)), -0.25), (F.exists(t, lambda a: F.length(a) <= 1), -0.15), (F.rtrim(v).endswith("-"), -0.1), start=0.5,
    )
    return F.when(v.isNull() | (F.size(t) == 0), 0.0).otherwise(score)


def enum_confidence(x: Column | str) -> Column:
    return F.when(F.coalesce(F.trim(_c(x)), F.lit("")) == "", 0.0).otherwise(0.95)


def date_confidence(x: Column | str) -> Column:
    v = F.coalesce(_c(x), F.lit(""))
    return F.when(v == "", 0.0).when((F.length(v) == 10) & (F.substring(v, 3, 1) == ".") & (F.substring(v, 6, 1) == "."), 1.0).otherwise(0.4)


def address_confidence(x: Column | str) -> Column:
    v = F.lower(F.coalesce(_c(x), F.lit("")))
    street = functools.reduce(lambda a, b: a | b, [v.contains(p) for p in ("ул.", "бульвар", "пр-кт", "пер.", "ш.")])
    return F.when(v == "", 0.0).otherwise(_points((v.contains("дом"), 0.2), (v.contains("кв."), 0.15), (street, 0.1), start=0.5))


def text_confidence(x: Column | str) -> Column:
    v = F.coalesce(_c(x), F.lit(""))
    t = F.filter(F.split(ws(v), " "), lambda a: a != "")
    score = _points((F.size(t) >= 3, 0.2), (F.exists(t, lambda a: a.rlike("^[A-ZА-ЯЁ]")), 0.1), (v.rlike(r"\d"), 0.1), (F.exists(t, lambda a: a.isin(NO_NAMES)), -0.2), start=0.5)
    return F.when(F.size(t) == 0, 0.0).otherwise(score)


def document_confidence(kind: Column, series: Column, number: Column, issued_by: Column, issue_date: Column, raw: Column) -> Column:
    """Confidence in an identity document by its fields; a bare word for the document counts against it."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.lower(raw).isin("паспорт", "паспорт рф", "справка", "свидетельство о рождении") & ~(has(series) | has(number) | has(issued_by) | has(issue_date))
    score = _points(*[(has(c), 0.15) for c in (kind, series, number, issued_by, issue_date)], (F.size(F.split(ws(raw), " ")) >= 2, 0.05), (bare, -0.15), start=0.25)
    return F.when(has(kind) | has(series) | has(number) | has(issued_by) | has(issue_date) | (raw != ""), score).otherwise(0.0)
