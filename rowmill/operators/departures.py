"""Departures read from the text of a cell, as expressions over one column."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.text import check_digit, let, real_date, ws
from rowmill.operators.identity import blank, has

FIELDS = ("status", "reason", "raw", "death_date", "departure_date", "act_record_number", "act_record_date", "issued_by", "destination_address", "scheme", "applicable", "passed")
DEPARTURE = "struct<" + ",".join(f"{f}:{'boolean' if f in ('applicable', 'passed') else 'string'}" for f in FIELDS) + ">"
# Words of a death, of the stub of form 6, and of any other departure.
DEATH = ["дата смерти", "умер(ла)", "умерла", "умер", "по смерти"]
STUB = "(?iu)форм[ыа] 6|по отрывному талону"
OTHER = "(?iu)выбы|снят"
_DATE = r"(?<!\d)(\d{2}\.\d{2}\.\d{2,4}|\d{4}\.\d{2}\.\d{2}|\d{4,8}\.\d{4})(?!\d)"
_ACT = "(?iu)[аa]/?[з3z]\\.?\\s*"
_STREETS = "(?iu)(?:[А-ЯЁа-яёA-Za-z0-9.-]+\\s+)*(?:ул\\.|улица|пр-т|проспект|б-р|бульвар|пер\\.|переулок|д\\.|дом|к\\.|корп\\.|кв\\.|квартира)\\s*.+$"
_ABROAD = "(?iu)(?<![\\wа-яё])(регистратор\\s+актов\\s+гражданского\\s+состояния.+|глава\\s+канцелярии.+|registrar.+|county\\s+clerk.+)$"
STARTS = "2018-11-04"


def departure(**parts: Column) -> Column:
    typed = lambda f: parts.get(f, F.lit(None)).cast("boolean" if f in ("applicable", "passed") else "string").alias(f)
    return F.struct(*[typed(f) for f in FIELDS])


def whole_date(x: Column) -> Column:
    """dd.mm.yyyy of the ways a date is written here: two-digit years are of this century, eight digits before the year lost their points; null for others."""
    return F.when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), x).when(x.rlike(r"^\d{2}\.\d{2}\.\d{2}$"), F.concat(F.left(x, F.lit(6)), F.lit("20"), F.right(x, F.lit(2)))).when(
        x.rlike(r"^\d{8}\.\d{4}$"), F.concat_ws(".", F.left(x, F.lit(2)), F.substring(x, 3, 2), F.right(x, F.lit(4)))
    )


def dates(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(_DATE), F.lit(1)), whole_date), lambda d: d.isNotNull())


def first_date(x: Column) -> Column:
    return F.get(dates(x), F.lit(0))


def last_date(x: Column) -> Column:
    return F.try_element_at(dates(x), F.lit(-1))


def tidied(x: Column) -> Column:
    """White space squeezed, the misread signs of act records, "from" and "office" put right, groups of an act's digits together."""
    v = ws(x)
    for p, r in ((r"(?iu)(?<![\wа-яё])[aа]/[3зz](?![\wа-яё])", "а/з"), (r"(?iu)(?<![\wа-яё])[oо0][тt](?![\wа-яё])", "от"), (r"(?iu)(?<![\wа-яё])[oо0][фf](?![\wа-яё])\.?", "оф."), (r"(?iu)(\d)\s*[oо0][тt](?![\wа-яё])", "$1 от"), (r"(?iu)(\d)\s*[oо0][фf](?![\wа-яё])\.?", "$1 оф.")):
        v = F.regexp_replace(v, p, r)
    # Up to five groups are put together, each pass joins one more: 21 digits have no more groups of four.
    for _ in range(5):
        v = F.regexp_replace(v, r"(?iu)(а/з\s+\d{4,20})\s+(\d{1,10})(?!\d)", "$1$2")
    return ws(v)


def act_number(x: Column) -> Column:
    """The number of an act record: the groups of digits after its sign and before "from" or "office", at
    most 21 digits; else the digits right after the sign, else any 21 digits."""
    part = F.regexp_extract(x, f"{_ACT}\\s*(.+?)(?:(?<![\\wа-яё])от(?![\\wа-яё])|(?<![\\wа-яё])оф|$)", 1)
    words = F.transform(F.split(part, r"\s+"), lambda w: F.btrim(w, F.lit(" ,.;:()[]{}")))
    joined = F.array_join(F.filter(words, lambda w: w.rlike(r"^\d{3,21}$")), "")
    lone = F.try_element_at(F.filter(words, lambda w: w.rlike(r"^\d$")), F.lit(-1))
    full = F.when(F.length(joined).isin(10, 20) & lone.isNotNull(), F.concat(joined, lone)).otherwise(joined)
    right_after = blank(F.regexp_extract(x, f"{_ACT}(\\d{{1,21}})", 1))
    return let(full, lambda n: F.coalesce(F.when(F.length(n) >= 13, F.left(n, F.lit(21))), right_after, blank(F.regexp_extract(x, r"(?<!\d)(\d{21})(?!\d)", 1))))


def named_date(x: Column, marks: list[str] = DEATH) -> Column:
    """The last date within 140 signs of the first mark that has one, before the act record."""
    low = F.translate(F.lower(x), "ё", "е")
    near = lambda m: last_date(F.regexp_extract(F.when(low.contains(m), F.substring(x, F.position(F.lit(m), low), F.lit(140))), "(?isu)^(.*?)(?:а/з|a/3|от |oт |$)", 1))
    return F.coalesce(*[near(m) for m in marks])


def office(x: Column) -> Column:
    """The office after its sign, or a foreign one by its title; dates and addresses behind it are cut off."""
    v = F.coalesce(blank(F.regexp_extract(x, r"(?iu)(?<![\wа-яё])оф\.?\s+(.+)$", 1)), blank(F.regexp_extract(x, _ABROAD, 1)))
    v = F.regexp_replace(F.regexp_replace(ws(v), r"\s+\d{2}\.\d{2}\.\d{2,4}\s*$", ""), _STREETS, "")
    return blank(F.btrim(v, F.lit(" ,")))


def without_address(x: Column) -> Column:
    """The text of a death without the address behind it (behind the office, where one is named)."""
    head, tail = F.regexp_extract(x, r"(?iu)^(.*?)(?<![\wа-яё])оф\.?\s+", 1), F.regexp_extract(x, r"(?iu)(?<![\wа-яё])оф\.?\s+(.*)$", 1)
    cut = lambda t: F.btrim(F.regexp_replace(t, _STREETS, ""), F.lit(" ,"))
    return F.when(F.lower(x).contains("оф."), ws(F.concat(head, F.lit(" оф. "), cut(F.regexp_replace(tail, r"\s+\d{2}\.\d{2}\.\d{2,4}\s*$", ""))))).otherwise(cut(ws(x)))


def from_mark(x: Column, date: Column) -> Column:
    """The text from the first mark of a death that the date stands behind."""
    low = F.translate(F.lower(x), "ё", "е")
    out = F.when(~has(date), x)
    for m in DEATH:
        out = out.when(low.contains(m) & (F.position(date, x) >= F.position(F.lit(m), low)), ws(F.substring(x, F.position(F.lit(m), low), F.length(x))))
    return out.otherwise(x)


def stub_address(x: Column) -> Column:
    """The address on a stub: what stands behind its form's name, without the date at its end."""
    v = F.regexp_extract(ws(x), "(?isu)форм[ыа] 6[, ]*(.*)$", 1)
    for p in (r",?\s*\d{2}\.?\d{2}\.\d{4}\s*$", r",?\s*\d{8}\.\d{4}\s*$", r"(?iu)(?<![\wа-яё])свидетель(?:ство)?(?![\wа-яё]).*$"):
        v = F.regexp_replace(v, p, "")
    return blank(F.btrim(v, F.lit(" ,")))


def act_check(number: Column, date: Column) -> Column:
    """struct<scheme, applicable, passed>: from the law's first day on, numbers of 21 digits have 7 as their second and a check digit as their last."""
    known = (F.length(number) == 21) & F.coalesce(real_date(whole_date(date)) >= F.lit(STARTS).cast("date"), F.lit(False))
    holds = number.rlike(r"^\d7\d{19}$") & (check_digit(F.left(number, F.lit(20))) == F.right(number, F.lit(1)).try_cast("int"))
    scheme = F.when(~has(number), "unknown").when(known, "egr_zags_2018").otherwise("pre_egr_local_record")
    return F.struct(scheme.alias("scheme"), F.coalesce(has(number) & known, F.lit(False)).alias("applicable"), F.when(has(number) & known, holds).alias("passed"))


def _death(t: Column) -> Column:
    facts = F.struct(F.coalesce(named_date(t), first_date(t)).alias("died"), act_number(t).alias("number"), whole_date(blank(F.regexp_extract(t, r"(?iu)(?<![\wа-яё])от\s+(\d{2}\.\d{2}\.\d{2,4})", 1))).alias("at"))
    made = lambda f: let(act_check(f["number"], F.coalesce(f["at"], f["died"])), lambda c: departure(
        status=F.lit("departed"), reason=F.lit("death"), raw=from_mark(without_address(t), f["died"]), death_date=f["died"], act_record_number=f["number"], act_record_date=f["at"], issued_by=office(t),
        scheme=c["scheme"], applicable=c["applicable"], passed=c["passed"],
    ))
    return let(facts, made)


def read(x: Column) -> Column:
    """The departure of a cell; null for a text that tells of none."""

    def told(t: Column) -> Column:
        low = F.translate(F.lower(t), "ё", "е")
        died = functools.reduce(lambda a, b: a | b, [low.contains(m) for m in DEATH])
        cut = F.btrim(F.regexp_replace(t, r"(?iu)(?<![\wа-яё])свидетель(?:ство)?(?![\wа-яё]).*$", ""), F.lit(" ,"))
        stub = departure(status=F.lit("departed"), reason=F.lit("form_6_stub"), raw=cut, departure_date=last_date(t), destination_address=stub_address(t))
        other = departure(status=F.lit("departed"), reason=F.lit("other"), raw=t)
        return F.when(died, _death(t)).when(low.rlike(STUB), stub).when(low.rlike(OTHER) | t.rlike(f"{_ACT}\\d"), other)

    return let(blank(tidied(x)), told)


# Comparing departures ----------------------------------------------------------------------


def completeness(d: Column) -> Column:
    """Reason, a date, a number, an office or address: how many of the four a departure has."""
    have = (has(d["reason"]), has(d["death_date"]) | has(d["departure_date"]), has(d["act_record_number"]), has(d["issued_by"]) | has(d["destination_address"]))
    return functools.reduce(lambda a, b: a + F.coalesce(b, F.lit(False)).cast("int"), have, F.lit(0))


def candidate_points(d: Column) -> Column:
    """Completeness, more for a whole number, its date and an office: to choose between readings over a page break."""
    return completeness(d) + F.when(F.length(d["act_record_number"]) >= 21, 2).otherwise(0) + F.coalesce(has(d["act_record_date"]), F.lit(False)).cast("int") + F.coalesce(has(d["issued_by"]), F.lit(False)).cast("int")


def quality(d: Column) -> Column:
    """Points of a departure read anew from a crop of its row."""
    point = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    number = d["act_record_number"]
    return F.round(point(has(d["reason"]), 0.5) + point(has(d["death_date"]) | has(d["departure_date"]), 0.5) + point(has(number), 0.9) + point(F.length(number) >= 21, 0.4) + point(has(d["act_record_date"]), 0.4) + point(has(d["issued_by"]) | has(d["destination_address"]), 0.5) + point(d["passed"], 0.5), 4)


def better(new: Column, old: Column) -> Column:
    """Whether another reading is to be preferred: more complete, a longer number, or a date or office the old one lacks."""
    n = lambda d: F.coalesce(F.length(d["act_record_number"]), F.lit(0))
    gains = lambda f: F.coalesce(has(new[f]) & ~has(old[f]), F.lit(False))
    return (completeness(new) > completeness(old)) | new.isNotNull() & ((n(new) > n(old)) | gains("act_record_date") | gains("issued_by"))


def may_go_on(d: Column) -> Column:
    """A death whose act number is missing or broke off: look further down for it."""
    number, raw = F.coalesce(d["act_record_number"], F.lit("")), F.lower(F.coalesce(d["raw"], F.lit("")))
    return F.coalesce((d["reason"] == "death") & ((number == "") | (F.length(number) < 21) & (raw.contains("а/") | has(d["act_record_date"]))), F.lit(False))


def read_again(d: Column) -> Column:
    """Whether a crop of the row should be read again: a death without a whole number or its date, a stub without an address."""
    number, raw = F.coalesce(d["act_record_number"], F.lit("")), F.lower(F.coalesce(d["raw"], F.lit("")))
    death = (number == "") | (F.length(number) < 21) & raw.contains("а/з") | ~has(d["act_record_date"]) & raw.rlike("(?: от)|от$|оф\\.|а/$")
    return F.coalesce(F.when(d["reason"] == "death", death).when(d["reason"] == "form_6_stub", ~has(d["destination_address"])), F.lit(False))


def continued(before: Column, rest: Column, after: Column) -> Column:
    """A departure and what the next page adds: the most complete of the readings apart and together, the first of equal ones."""
    ranked = lambda both: F.array_max(F.array(*[F.struct(F.coalesce(candidate_points(d), F.lit(0)).alias("points"), F.lit(-i).alias("order"), d.alias("d")) for i, d in enumerate((before, after, both))]))["d"]
    return F.when(~has(rest) & after.isNull(), before).when(before.isNull(), after).otherwise(let(read(ws(F.concat_ws(" ", before["raw"], rest))), ranked))
