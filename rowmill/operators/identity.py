"""Identity documents read from the text of a cell, as expressions over one column.

A document is a struct of kind, series, number, issued_by, issue_date and raw (see
``DOCUMENT``). The text is cut to the part around its latest real date; candidates for
series and number are scored; the issuer is what stands after "issued" or, without that
word, what is left before the date."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.text import dates_in, document_confidence, let, real_date, ws
from rowmill.operators.issuers import civil_issuer, registered_issuer

FIELDS = ("document_type", "series", "number", "issued_by", "issue_date", "raw")
DOCUMENT = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
DATE = r"\d{2}\.\d{2}\.\d{4}"
# Words that tell the kind of a document.
PASSPORT, CERTIFICATE, REFERENCE = "паспорт", "свидетельство о рождении", "справка"
MARKS = {PASSPORT: "паспорт", CERTIFICATE: "свидетель", REFERENCE: "справка"}
POLICE, REGISTRY, ABROAD = "(?iu)мвд|уфмс|овд|увд|вопросам\\s+миграции", "(?iu)загс|актов\\s+гражданского\\s+состояния", "(?iu)израил|ashkelon|ашкелон|министерств|населения"
UNKNOWN = "(?iu)неизвес|конвертац"
# Roman numerals of certificates, and Latin letters of their second half.
ROMAN_LETTERS, LATIN_SERIES, CYRILLIC_SERIES = "IVXLCDM", "ABCEHKMOPTXY", "АВСЕНКМОРТХУ"
_SERIES = "[IVXLCМЮАГБВЕЁЖЗИЙКЛНПРСТУФХЦЧШЩЭЮЯA-Z]{1,5}(?:\\s*-\\s*[IVXLCМЮАГБВЕЁЖЗИЙКЛНПРСТУФХЦЧШЩЭЮЯA-Z]{1,4})?"


def has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def document(**parts: Column) -> Column:
    return F.struct(*[parts.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


# Kinds -------------------------------------------------------------------------------------


def looks_like_passport(raw: Column) -> Column:
    return raw.rlike(DATE) & raw.rlike(r"(?<!\d)\d{6}(?!\d)") & raw.rlike(POLICE) & ~raw.rlike(REGISTRY) & ~raw.rlike(ABROAD)


def looks_like_certificate(raw: Column) -> Column:
    return raw.rlike("(?iu)свидетель") | raw.rlike(REGISTRY) | raw.rlike(ABROAD) & raw.rlike(DATE) & raw.rlike(r"№?\s*\d{6,8}") | certificate_number(raw)["series"].isNotNull() & raw.rlike(DATE) & ~raw.rlike(POLICE)


def looks_like_reference(raw: Column) -> Column:
    return raw.rlike("(?iu)справка") | raw.rlike(DATE) & raw.rlike(r"(?<!\d)\d{6}(?!\d)") & raw.rlike(UNKNOWN)


def kind(raw: Column) -> Column:
    """What a text is the text of: by its words, else by what stands in it; null if nothing tells."""
    out = functools.reduce(lambda acc, m: acc.when(F.lower(raw).contains(m[1]), F.lit(m[0])), MARKS.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return out.when(looks_like_certificate(raw), CERTIFICATE).when(looks_like_reference(raw), REFERENCE).when(looks_like_passport(raw), PASSPORT)


def continues_passport(raw: Column) -> Column:
    return raw.rlike(r"№\s*\d{6}\s+\d{2}\s+\d{2}") & raw.rlike(DATE) & raw.rlike("(?iu)выдан|овд|мвд|уфмс") & ~raw.rlike("(?iu)загс")


def continues_certificate(raw: Column) -> Column:
    return raw.rlike(r"№\s*\d{6,8}") & raw.rlike(DATE) & raw.rlike("(?iu)загс|свидетель|актов гражданского состояния")


def continues_reference(raw: Column) -> Column:
    return raw.rlike(r"№?\s*\d{6}") & raw.rlike(DATE) & raw.rlike("(?iu)справк|неизвес|конвертац")


# The part of the text around its date ------------------------------------------------------


def issue_date(raw: Column) -> Column:
    """The latest date that exists in the calendar, else the last one written; null if none."""
    latest = lambda found: F.array_max(F.transform(found, lambda d: F.struct(real_date(d).alias("at"), d.alias("text"))))
    return let(dates_in(raw), lambda found: let(latest(found), lambda m: F.when(m["at"].isNotNull(), m["text"]).otherwise(F.try_element_at(found, F.lit(-1)))))


def segment(raw: Column, date: Column, markers: Column) -> Column:
    """From the last marker before the last place of ``date`` (without one: from the date before
    it) to the next word for a document; the whole text without a date."""

    def cut(tail: Column) -> Column:
        head = F.left(raw, F.length(raw) - F.length(tail) - F.length(date))
        from_marker = F.call_function("regexp_extract", head, F.concat(F.lit("(?isu)^.*((?:"), markers, F.lit(").*)$")), F.lit(1))
        after_date = F.regexp_extract(head, f"(?s)^(?:.*{DATE})?(.*)$", 1)
        rest = F.regexp_extract(tail, "(?isu)^(.+?)(?:паспорт|свидетель|справка|$)", 1)
        return ws(F.concat(let(from_marker, lambda m: F.when(m != "", m).otherwise(after_date)), date, rest))

    return let(F.when(date.isNull(), raw).otherwise(let(F.call_function("substring_index", raw, date, F.lit(-1)), cut)), lambda v: F.when(v == "", raw).otherwise(v))


# Series and numbers ------------------------------------------------------------------------


def series_text(x: Column) -> Column:
    """Four digits as two and two."""
    d = F.regexp_replace(x, r"\s+", "")
    return F.when(d.rlike(r"^\d{4}$"), F.concat_ws(" ", F.left(d, F.lit(2)), F.right(d, F.lit(2)))).otherwise(blank(ws(x)))


def passport_candidates(raw: Column) -> Column:
    """array<struct<series, number, text>>: number and series in any order, whole first, then with a broken series."""
    found = lambda p, s, n: F.transform(
        F.regexp_extract_all(raw, F.lit(p), F.lit(0)),
        lambda m: F.struct(series_text(F.concat(*[F.regexp_extract(m, p, i) for i in s])).alias("series"), F.regexp_extract(m, p, n).alias("number"), m.alias("text")),
    )
    return F.array_distinct(F.concat(
        found(r"№?\s*(\d{6})\s*(\d{2}\s?\d{2})(?!\d)", (2,), 1), found(r"(?<!\d)(\d{2}\s?\d{2})\s*(\d{6})(?!\d)", (1,), 2),
        found(r"№?\s*(\d{6})\s*(\d{2})\D{0,3}(\d{2})(?!\d)", (2, 3), 1), found(r"(?<!\d)(\d{2})\D{0,3}(\d{2})\s*(\d{6})(?!\d)", (1, 2), 3),
    ))


def with_hints(cands: Column, hints: Column) -> Column:
    """Candidates, and for each of them its series with the region digits each hint (map prefix to weight) knows."""
    made = F.flatten(F.transform(cands, lambda c: F.transform(F.map_keys(hints), lambda p: F.struct(F.concat_ws(" ", p, F.right(c["series"], F.lit(2))).alias("series"), c["number"].alias("number"), c["text"].alias("text")))))
    return F.when(hints.isNull(), cands).otherwise(F.concat(cands, F.array_except(made, cands)))


def passport_score(c: Column, raw: Column, date: Column, hints: Column) -> Column:
    """Points of a candidate: the sign and the word before it, what the issuer's region says, and
    how long before the issue its blank was printed (the last two digits of the series)."""
    at = F.position(c["text"], raw)
    sign = F.when(F.substring(raw, F.greatest(F.lit(1), at - 4), F.least(at, F.lit(4)) + F.length(c["text"])).contains("№"), 2).otherwise(0)
    word = F.when(F.lower(F.substring(raw, F.greatest(F.lit(1), at - 20), F.lit(40))).contains("паспорт"), 2).otherwise(0)
    region = F.when(hints.isNull() | (F.size(F.map_keys(hints)) == 0), 0).otherwise(F.coalesce(F.try_element_at(hints, F.left(c["series"], F.lit(2))), F.lit(-3)))
    age = F.pmod(F.right(date, F.lit(2)).try_cast("int") - F.right(c["series"], F.lit(2)).try_cast("int"), F.lit(100))
    printed = F.when(date.isNull() | age.isNull(), 0).when(age <= 20, 3).when(age <= 30, 1).otherwise(-2)
    return F.when(has(c["series"]) & has(c["number"]), sign + word + region + printed).otherwise(-100)


def best_passport(raw: Column, date: Column, hints: Column | None = None) -> Column:
    """struct<series, number>: the candidate with most points, the first of equal ones; without
    candidates a lone series and the six digits after it."""
    hints = F.lit(None).cast("map<string,int>") if hints is None else hints
    ranked = lambda cands: F.array_max(F.transform(cands, lambda c, i: F.struct(passport_score(c, raw, date, hints).alias("score"), (-i).alias("order"), c["series"].alias("series"), c["number"].alias("number"))))
    lone = series_text(blank(F.regexp_extract(raw, r"(?<!\d)(\d{2}\s+\d{2}|\d{4})(?!\d)", 1)))
    after = blank(F.regexp_extract(raw, r"(?<!\d)(?:\d{2}\s+\d{2}|\d{4})(?!\d).*?(?<!\d)(\d{6})(?!\d)", 1))
    number = F.coalesce(after, blank(F.regexp_extract(raw, r"(?<!\d)(\d{6})(?!\d)", 1)))
    best = lambda m: F.when(m.isNotNull(), F.struct(m["series"].alias("series"), m["number"].alias("number"))).otherwise(F.struct(lone.alias("series"), number.alias("number")))
    return let(passport_candidates(raw), lambda c: let(ranked(F.when(date.isNull(), c).otherwise(with_hints(c, hints))), best))


def roman_part(x: Column) -> Column:
    """The Roman half of a certificate's series; as it is if no numeral comes out."""
    up = F.upper(x)
    made = F.regexp_replace(F.translate(up, "ХІУ", "XIV"), f"[^{ROMAN_LETTERS}]", "")
    return F.when(made.rlike(f"^[{ROMAN_LETTERS}]+$"), made).otherwise(up)


def letters_part(x: Column) -> Column:
    return F.left(F.regexp_replace(F.translate(F.upper(x), LATIN_SERIES, CYRILLIC_SERIES), "[^А-ЯЁ]", ""), F.lit(2))


def certificate_series(x: Column) -> Column:
    """Numeral, hyphen, two Cyrillic letters; a series without a hyphen is only tidied."""
    tidy = F.replace(F.regexp_replace(F.upper(ws(x)), r"\s*-\s*", "-"), F.lit(" "), F.lit(""))
    halves = lambda v: F.struct(roman_part(F.substring_index(v, "-", 1)).alias("roman"), letters_part(F.regexp_extract(v, "^[^-]*-(.*)$", 1)).alias("letters"))
    whole = lambda v, h: F.when(~v.contains("-"), blank(v)).when((h["roman"] != "") & (h["letters"] != ""), F.concat_ws("-", h["roman"], h["letters"])).otherwise(v)
    return let(tidy, lambda v: let(halves(v), lambda h: whole(v, h)))


def certificate_score(series: Column, number: Column) -> Column:
    whole = F.when(series.rlike(f"^[{ROMAN_LETTERS}]+(?:-[А-ЯЁ]{{2}})?$"), 4).otherwise(0)
    return F.when(has(series) & has(number), F.when(series.contains("-"), 5).otherwise(0) + whole + F.least(F.length(series), F.lit(8)) + F.when(F.length(number).between(6, 10), 2).otherwise(0)).otherwise(-100)


def certificate_number(raw: Column) -> Column:
    """struct<series, number>: the best pair of a certificate's series and number; nulls if there is none."""
    found = lambda p, s, n: F.transform(
        F.regexp_extract_all(raw, F.lit(p), F.lit(0)), lambda m: F.struct(certificate_series(F.regexp_extract(m, p, s)).alias("series"), F.regexp_extract(m, p, n).alias("number"))
    )
    cands = F.concat(found(rf"(?iu)№?\s*(\d{{6,10}})\s*({_SERIES})", 2, 1), found(rf"(?iu)({_SERIES})(?:\s*№)?\s*(\d{{6,10}})(?!\d)", 1, 2))
    best = F.array_max(F.transform(cands, lambda c, i: F.struct(certificate_score(c["series"], c["number"]).alias("score"), (-i).alias("order"), c["series"].alias("series"), c["number"].alias("number"))))
    return let(best, lambda m: F.struct(m["series"].alias("series"), m["number"].alias("number")))


# Issuers -----------------------------------------------------------------------------------


def issuer_without_mark(raw: Column, date: Column) -> Column:
    """What is left before the date once the kind, the number and the series are taken off; null if
    that is shorter than six letters or no date is known."""
    v = ws(F.call_function("substring_index", raw, date, F.lit(1)))
    for p in (r"^(?:паспорт(?:\s+рф)?|свидетельство\s+о\s+рождении|справка)\s*", r"^№\s*\d{6,10}\s*", r"(?<!\d)\d{2}\s*\d{2}\s*\d{6}(?!\d)", r"№?\s*\d{6}\s*\d{2}\s*\d{2}(?!\d)", rf"(?<!\d)(?:{_SERIES})\s*№?\s*\d{{6,10}}(?!\d)", rf"№?\s*\d{{6,10}}\s*(?:{_SERIES})(?![\dа-яё])"):
        v = F.regexp_replace(v, f"(?iu){p}", "")
    return let(F.btrim(ws(v), F.lit(" ,;:-")), lambda left: F.when(date.isNull() | (F.length(left) < 6) | left.rlike(DATE), F.lit(None).cast("string")).otherwise(left))


def issuer(raw: Column, date: Column) -> Column:
    """Who issued the document: after the last "issued" and before a date, else :func:`issuer_without_mark`."""
    named = F.try_element_at(F.regexp_extract_all(raw, F.lit(rf"(?iu)выдан\s+(.+?)(?=\s+{DATE}|$)"), F.lit(1)), F.lit(-1))
    named = F.regexp_replace(ws(named), r"(?iu)^.*когда\s+выдан\s*", "")
    inner = let(named, lambda n: F.coalesce(blank(F.regexp_extract(n, r"(?iu)^.*выдан\s+(.+)$", 1)), blank(n)))
    return registered_issuer(F.coalesce(inner, issuer_without_mark(raw, date)))


def is_valid(kind_: Column, series: Column, number: Column, issued_by: Column, date: Column) -> Column:
    """Whether enough was read for the kind of document."""
    return (
        F.when(kind_ == PASSPORT, has(series) & has(number) & has(date)).when(kind_ == REFERENCE, has(number) & has(date))
        .when(kind_ == CERTIFICATE, has(date) & has(issued_by) & (has(number) | has(series))).otherwise(has(date) | has(issued_by))
    )


# Whole documents ---------------------------------------------------------------------------


def digits_or_text(x: Column) -> Column:
    return F.coalesce(blank(F.regexp_replace(x, r"\D", "")), blank(ws(x)))


def written_out(word: Column, series: Column, number: Column, issued_by: Column, date: Column, otherwise: Column) -> Column:
    """The document in one line, from its fields; ``otherwise`` if number, series or issuer is missing."""
    full = F.concat(word, F.lit(" № "), number, F.lit(" "), series, F.lit(", выдан "), issued_by, F.coalesce(F.concat(F.lit(" "), date), F.lit("")))
    return F.when(has(number) & has(series) & has(issued_by), full).otherwise(otherwise)


def read_as(raw: Column, kind_: Column, hints: Column | None = None) -> Column:
    """The document of a text as one of ``kind_``; every step is worked out once, whatever the kind."""
    cert = kind_ == CERTIFICATE

    def made(part: Column, pair: Column, by: Column, date: Column) -> Column:
        whole = pair["series"].rlike(f"^[{ROMAN_LETTERS}]+(?:-[А-ЯЁ]{{2}})?$")
        series = F.when(cert & by.rlike(ABROAD) & ~whole, F.lit(None).cast("string")).otherwise(pair["series"])
        number = F.when(kind_ == PASSPORT, pair["number"]).otherwise(digits_or_text(pair["number"]))
        word = F.when(kind_ == PASSPORT, "паспорт РФ").otherwise(kind_)
        alone = F.when(cert & has(number) & has(by), F.concat(word, F.lit(" № "), number, F.lit(", выдан "), by, F.coalesce(F.concat(F.lit(" "), date), F.lit("")))).otherwise(part)
        line = F.when((kind_ == PASSPORT) & ~has(date), part).otherwise(written_out(word, series, number, by, date, alone))
        return document(document_type=kind_, series=series, number=number, issued_by=by, issue_date=date, raw=line)

    named = lambda part, date: let(issuer(part, date), lambda by: F.when(kind_ == PASSPORT, by).otherwise(civil_issuer(by)))
    pairs = lambda part, date: F.when(cert, certificate_number(part)).otherwise(best_passport(part, date, hints))
    facts = lambda part, date: let(F.struct(pairs(part, date).alias("pair"), named(part, date).alias("by")), lambda f: made(part, f["pair"], f["by"], date))
    cut = lambda r, date: segment(r, date, F.when(cert, "свидетель").otherwise("паспорт|справка"))
    return let(ws(raw), lambda r: let(issue_date(r), lambda date: let(cut(r, date), lambda part: facts(part, date))))


def read_cell(raw: Column, wanted: Column | None = None, hints: Column | None = None) -> Column:
    """The document of a cell, read as its kind (``wanted`` if given); null for what is none."""
    def read(r: Column) -> Column:
        what = F.coalesce(wanted, kind(r)) if wanted is not None else kind(r)
        return let(F.when(F.trim(r) != "", what), lambda w: F.when(w.isin(PASSPORT, REFERENCE, CERTIFICATE), read_as(r, w, hints)))

    return let(raw, read)


# Comparing documents -----------------------------------------------------------------------


def completeness(d: Column) -> Column:
    """How many fields a document has, of five; 0 for none."""
    return functools.reduce(lambda a, f: a + has(d[f]).cast("int"), FIELDS[:-1], F.lit(0))


def confidence(d: Column) -> Column:
    return document_confidence(*[d[f] for f in FIELDS])


# Numerals a certificate's series may have.
NUMERALS = "(?:I|II|III|IV|V|VI|VII|VIII|IX|X)"


def series_quality(series: Column) -> Column:
    """3 for a whole series of a certificate, 2 for one that broke off in its letters, 1 for anything else, 0 for nothing."""
    v = ws(series)
    return F.when(~has(v), 0).when(v.rlike(f"^{NUMERALS}-[А-ЯЁ]{{2}}$"), 3).when(v.rlike(f"^{NUMERALS}-[А-ЯЁ]?$"), 2).otherwise(1)


def fragment_of_issuer(x: Column) -> Column:
    """Whether an issuer begins in the middle of a name."""
    return F.lower(x).rlike("^(?:скому|району|города|области|территориаль|агентства|загс)") | ~x.rlike("^[A-ZА-ЯЁ]")


def _fits(value: Column, pattern: str, well: int, badly: int) -> Column:
    return F.when(value.rlike(pattern), well).when(has(value), -badly).otherwise(0)


def merge_points(d: Column) -> Column:
    """How good a reading of a document is, to choose between readings of one document."""
    tidy = F.struct(*[ws(F.coalesce(d[f], F.lit(""))).alias(f) for f in FIELDS])
    return F.when(d.isNull(), 0).otherwise(let(tidy, _points))


def _points(d: Column) -> Column:
    series, number, by, date, raw = (d[f] for f in ("series", "number", "issued_by", "issue_date", "raw"))
    n_words = lambda v: F.when(v == "", 0).otherwise(F.size(F.split(v, " ")))
    named = F.when(
        by != "",
        F.least(n_words(by), F.lit(8)) + F.when(F.upper(by).rlike("МВД|УФМС|ОВД"), 4).otherwise(0) - F.when(by.rlike("[A-Za-z]"), 8).otherwise(0) - F.when(by.rlike("^[a-zа-яё]") | (F.length(by) <= 3), 8).otherwise(0)
        - F.when(by.rlike("p/ne|p-н|RAЙ|гоrо| HC|MVD|Mock|MOCK"), 6).otherwise(0),
    ).otherwise(0)
    as_passport = _fits(series, r"^\d{2}\s\d{2}$", 6, 4) + _fits(number, r"^\d{6}$", 6, 4) + _fits(date, f"^{DATE}$", 6, 4) + named
    registry = F.when(F.upper(by).contains("ЗАГС"), 4).otherwise(0) - F.when(by.rlike("[A-Za-z]"), 6).otherwise(0)
    as_certificate = _fits(series, "^(?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV)-[А-ЯЁ]{2}$", 5, 2) + _fits(number, r"^\d{6}$", 4, 3) + F.when(by != "", registry).otherwise(0)
    own = F.when(d["document_type"] == PASSPORT, as_passport).when(d["document_type"] == CERTIFICATE, as_certificate).otherwise(0)
    return completeness(d) * 10 + F.least(n_words(raw), F.lit(10)) + own


def best_of(points, *documents: Column) -> Column:
    """The document with most points, the first of equal ones."""
    ranked = F.array(*[F.struct(points(d).cast("double").alias("points"), F.lit(-i).alias("order"), d.alias("document")) for i, d in enumerate(documents)])
    return F.array_max(ranked)["document"]


def enrich_passport(before: Column, after: Column, both: Column) -> Column:
    """A passport that broke off at the end of a page, with the longer issuer and the date of its continuation."""
    rest, whole = ws(F.coalesce(after["issued_by"], F.lit(""))), ws(F.coalesce(both["issued_by"], F.lit("")))
    found = F.when(after["document_type"] == PASSPORT, F.coalesce(blank(rest), whole)).otherwise(F.coalesce(blank(whole), rest))
    by = F.when(F.length(found) > F.length(F.coalesce(ws(before["issued_by"]), F.lit(""))), found).otherwise(before["issued_by"])
    date = F.coalesce(*[F.when(d["issue_date"].rlike(f"^{DATE}$"), d["issue_date"]) for d in (both, after)], before["issue_date"])
    line = F.concat_ws(" ", F.lit("паспорт РФ №"), before["number"], before["series"], F.when(has(by), F.concat(F.lit("выдан "), by)), date)
    return document(document_type=before["document_type"], series=before["series"], number=before["number"], issued_by=by, issue_date=date, raw=F.when(has(before["number"]) & has(before["series"]), ws(line)).otherwise(before["raw"]))


def enrich_other(before: Column, both: Column) -> Column:
    """A certificate or reference that broke off, with what its continuation adds."""
    old, new = ws(before["issued_by"]), ws(both["issued_by"])
    by = F.when(has(old) & has(new) & fragment_of_issuer(new), civil_issuer(F.concat_ws(" ", old, new))).when(has(new) & ~has(old), civil_issuer(new)).otherwise(before["issued_by"])
    series = F.when(series_quality(both["series"]) > series_quality(before["series"]), both["series"]).otherwise(before["series"])
    number, date = F.coalesce(blank(before["number"]), both["number"]), F.coalesce(blank(before["issue_date"]), both["issue_date"])
    return document(document_type=before["document_type"], series=series, number=number, issued_by=by, issue_date=date, raw=written_out(before["document_type"], series, number, by, date, before["raw"]))


def continued(before: Column, rest: Column, after: Column) -> Column:
    """A document and what the next page adds (``rest``: its text, ``after``: that text read alone):
    the best of the readings apart, together, and enriched."""

    def chosen(both: Column) -> Column:
        dated = document(**{f: before[f] for f in FIELDS[:4]}, issue_date=rest, raw=written_out(F.lit("паспорт РФ"), before["series"], before["number"], before["issued_by"], rest, before["raw"]))
        as_passport = best_of(merge_points, before, after, both, F.when(ws(rest).rlike(f"^{DATE}$"), dated).otherwise(enrich_passport(before, after, both)))
        same = lambda d: F.when(d["document_type"] == before["document_type"], d)
        as_other = best_of(merge_points, before, same(after), same(F.when(both.isNotNull(), enrich_other(before, both))))
        return F.when(before["document_type"] == PASSPORT, as_passport).when(before["document_type"].isNotNull(), as_other).otherwise(best_of(merge_points, before, after, both))

    together = read_cell(ws(F.concat_ws(" ", before["raw"], rest)), before["document_type"])
    return F.when(~has(rest) & after.isNull(), before).when(before.isNull(), after).otherwise(let(together, chosen))
