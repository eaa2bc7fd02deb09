"""Issuers of documents as they were scanned: repaired, told apart by family, and written in
one canonical form. Everything is an expression over one column; null stays null."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.text import CYRILLIC, LATIN, apply_patterns, let, title_case, ws

# Codes of the administrative okrugs, in the order they are looked for.
OKRUG_CODES = ["ЮВАО", "ВАО", "ЦАО", "САО", "СВАО", "ЮАО", "ЮЗАО", "ЗАО", "СЗАО", "ТИНАО"]
# What scanning makes of words of issuers, and the words (any case).
REPAIRS = [
    ("РОС[ -]+С?ИИ", "РОССИИ"), ("МОСК[ -]+В([ЕЫ])", "МОСКВ$1"), ("ТПУФМС", "ТП УФМС"), ("T[PР]I|ТРI", "ТП"), ("N ?([0-9]+)", "№$1"), ("О УФМС", "ОУФМС"), ("ЮО?В?BAО", "ЮВАО"), ("3АГС", "ЗАГС"), ("ЗА ГС", "ЗАГС"),
    ("ГОР[:.]? ?МОСКВ([ЕЫ])", "Г. МОСКВ$1"), ("Г\\. ?МОСК?КВ[АЕ]", "Г. МОСКВЕ"), ("ВЫХИНОЖУЛЕБИНО", "ВЫХИНО-ЖУЛЕБИНО"), ("МФЦПГУ", "МФЦ ПГУ"), ("ЛЮБЛИ НСКИЙ", "ЛЮБЛИНСКИЙ"), ("Р-NЕ|Р-NE", "Р-НЕ"), ("Р-NА|Р-NA", "Р-НА"),
    ("Одел", "Отдел"), ("Гласное", "Главное"), ("конверт ация", "конвертация"), ("СО КОЛЬНИКИ", "СОКОЛЬНИКИ"), ("НАРОФОМИНСК(\\w*)", "НАРО-ФОМИНСК$1"),
]
# Parts that tell a family of issuers, and parts that must be missing.
GU_MVD, UFMS, OVD = "GU_MVD", "UFMS", "OVD"
# Canonical names by parts of the text (all of them, small letters).
GU_MVD_NAMES = [(["москв"], "ГУ МВД России по г. Москве"), (["воронежск"], "ГУ МВД России по Воронежской области"), (["ульяновск"], "УМВД РОССИИ ПО УЛЬЯНОВСКОЙ ОБЛАСТИ")]
UFMS_NAMES = [
    (["наро-фоминск", "тп №3", "московск"], "ТП №3 ОУФМС России по Московской обл. в Наро-Фоминском р-не"), (["смоленск", "рославл"], "МО УФМС РОССИИ ПО СМОЛЕНСКОЙ ОБЛ. В Г. РОСЛАВЛЬ"),
    (["волгоградск", "краснослободск"], "ТП УФМС ПО ВОЛГОГРАДСКОЙ ОБЛ. В Г. КРАСНОСЛОБОДСКЕ СРЕДНЕАХТУБИНСКОГО Р-НА"), (["коркино", "челябинск"], "Отделением УФМС России по Челябинской обл. в гор. Коркино"),
    (["аэропорт", "москв"], "Отделением УФМС России по гор. Москве по р-ну Аэропорт"),
]
OVD_NAMES = [(["азнакаев"], "Азнакаевским ГРОВД респ.Татарстан"), (["орехово-зуев"], "3 ГОМ Орехово-Зуевским УВД Московской обл.")]
OVD_DISTRICTS = {"Марьино": 'ОВД "Марьино" г. Москвы', "Сокольники": 'ОВД "Сокольники" города Москвы', "Выхино": "ОВД Выхино города Москвы", "Лефортово": "ОВД Лефортово гор. Москвы"}
ZAGS_NAMES = [
    (["межрайон", "химки", "долгопруд"], "Отдел № 1 Межрайонного УЗАГС по городским округам Химки и Долгопрудный ГУ ЗАГС Московской области"), (["чертановск", "загс", "москв"], "Чертановский отдел ЗАГС Управления ЗАГС Москвы"),
    (["люблинский", "управления загс москв"], "Люблинский отдел ЗАГС Управления ЗАГС Москвы"), (["орган загс москвы", "выхино", "жулебино"], "Орган ЗАГС Москвы №37 МФЦ ПГУ р-на Выхино-Жулебино"),
    (["заволж", "ульяновск", "загс"], "Отдел ЗАГС по Заволжскому району города Ульяновска Агентства ЗАГС Ульяновской области"),
]
ZAGS_SPELLINGS = ["Управления ЗАГС Москвы", "Люблинский отдел ЗАГС", "Главное управление ЗАГС Рязанской области", "Территориальный отдел по Клепиковскому району", "района Выхино-Жулебино", "р-на Выхино-Жулебино"]
FOREIGN = "Отдел ведения населения г. Ашкелон, Израиль"


def _says(low: Column, *parts: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [low.contains(p) for p in parts])


def _by_parts(low: Column, names: list[tuple[list[str], str]], otherwise: Column) -> Column:
    out = functools.reduce(lambda acc, r: acc.when(_says(low, *r[0]), F.lit(r[1])), names, F.when(F.lit(False), F.lit(None).cast("string")))
    return out.otherwise(otherwise)


def repaired(x: Column) -> Column:
    """Broken words closed, words of look-alike Latin letters in Cyrillic, known misreadings undone."""
    v = F.btrim(ws(x), F.lit(" ,;:"))
    v = F.regexp_replace(v, "(?<=[А-ЯЁа-яё])-\\s+(?=[А-ЯЁа-яё])", "")
    alike = f"^[{LATIN}{CYRILLIC}.-]*[A-Za-z][{LATIN}{CYRILLIC}.-]*$"
    mixed = "[А-Яа-яЁё]"
    word = lambda w: F.when(w.rlike(mixed) | w.rlike(alike) & w.rlike(".{2,}"), F.translate(w, LATIN, CYRILLIC)).otherwise(w)
    v = F.array_join(F.transform(F.split(v, " "), word), " ")
    v = F.regexp_replace(v, "(?<=[А-ЯЁа-яё])-\\s+(?=[А-ЯЁа-яё])", "")
    return ws(apply_patterns(v, [(f"(?iuU)(?<![\\w-])(?:{p})(?![\\wа-яё])", r) for p, r in REPAIRS]))


def family(x: Column) -> Column:
    """GU_MVD, UFMS or OVD; null if the text names none of them."""
    low = F.lower(x)
    ovd = low.contains("овд") | low.contains("увд")
    return F.when(low.contains("гу мвд") | low.contains("мвд россии") & ~low.contains("уфмс") & ~low.contains("овд"), GU_MVD).when(low.contains("уфмс"), UFMS).when(ovd, OVD)


def okrug_code(x: Column) -> Column:
    up = F.upper(x)
    return functools.reduce(lambda acc, c: acc.when(up.contains(c), F.lit(c)), OKRUG_CODES, F.when(F.lit(False), F.lit(None).cast("string")))


def district_name(x: Column) -> Column:
    """A district's name alone: quotes and single letters off, each word with a capital; null for what is no name."""
    bare = F.btrim(ws(x), F.lit(" ,;:-\"'«»"))
    bare = F.btrim(F.regexp_replace(bare, "(?<![А-ЯЁа-яё])[А-ЯЁа-яё]$", ""), F.lit(" ,;:-"))
    return let(bare, lambda v: F.when((v == "") | F.upper(v).isin("ОУ", "ОУФМС", "УФМС"), F.lit(None).cast("string")).when(F.upper(v).startswith("ОУ ") & F.upper(v).contains("МАРЬИНО"), "Марьино").otherwise(title_case(v)))


def district(x: Column) -> Column:
    """The district an issuer is named after: in quotes, or after the words for a district or police office."""
    quoted = F.regexp_extract(x, "[\"«]([А-ЯЁа-яё -]{3,})[\"»]", 1)
    stop = "(?iuU)\\b(?:ОУФМС|УФМС|ГОР\\.?|ГОРОДА|Г\\.|В\\s+[А-ЯЁ]{2,5}|РФ|РОССИИ)(?![а-яё]).*$"
    after = lambda p: district_name(F.regexp_replace(F.regexp_extract(x, f"(?iuU){p}\\s+([А-ЯЁа-яё -]{{3,}})", 1), stop, ""))
    return let(quoted, lambda q: F.when(q != "", district_name(q)).otherwise(F.coalesce(*[after(p) for p in ("ПО\\s+РАЙОНУ", "ПО\\s+Р-НУ", "РАЙОНА", "РАЙОНУ", "ОВД")])))


def _gu_mvd(v: Column) -> Column:
    low = F.lower(v)
    region = F.btrim(ws(F.regexp_extract(v, "(?iuU)(?:ГУ|УМВД|МВД)\\s+.*?\\bПО\\s+(.+)", 1)), F.lit(" ,;:"))
    prefix = F.when(low.startswith("умвд"), "УМВД РОССИИ").otherwise("ГУ МВД России")
    return _by_parts(low, GU_MVD_NAMES, F.when(region != "", F.concat(prefix, F.lit(" по "), region)))


def _ufms(v: Column) -> Column:
    return let(F.struct(F.lower(v).alias("low"), district(v).alias("place"), okrug_code(v).alias("code")), lambda x: _ufms_name(x["low"], x["place"], x["code"]))


def _ufms_name(low: Column, place: Column, code: Column) -> Column:
    section = low.contains("отделением") | low.contains("оуфмс")
    own = F.when(low.rlike("(?U)(?:^| )уфмс ") & ~low.contains("оуфмс"), " УФМС РОССИИ").otherwise(" ОУФМС РОССИИ")
    in_code = F.coalesce(F.concat(F.lit(" В "), code), F.lit(""))
    moscow = low.contains("москв")
    maryino = F.when(section, F.concat(F.lit("ОТДЕЛЕНИЕМ ПО РАЙОНУ МАРЬИНО"), own, F.lit(" ПО ГОР. МОСКВЕ"), in_code)).otherwise("ОТДЕЛОМ УФМС РОССИИ ПО ГОР. МОСКВЕ ПО РАЙОНУ МАРЬИНО")
    vykhino = F.when(section, F.concat(F.lit("Отделением по р-ну Выхино ОУФМС России по г. Москве"), F.coalesce(F.concat(F.lit(" в "), code), F.lit("")))).otherwise("Отделом УФМС России по гор. Москве по району Выхино-Жулебино")
    other = F.when(section, F.concat(F.lit("ОТДЕЛЕНИЕМ ПО РАЙОНУ "), F.upper(place), F.lit(" ОУФМС РОССИИ ПО ГОР. МОСКВЕ"), in_code)).otherwise(F.concat(F.lit("ОТДЕЛОМ УФМС РОССИИ ПО ГОР. МОСКВЕ ПО РАЙОНУ "), F.upper(place)))
    made = F.when(moscow & low.contains("марьино"), maryino).when(moscow & low.contains("выхино"), vykhino).when(moscow & place.isNotNull(), other)
    return _by_parts(low, UFMS_NAMES, made)


def _ovd(v: Column) -> Column:
    return let(F.struct(F.lower(v).alias("low"), district(v).alias("place")), lambda x: _ovd_name(x["low"], x["place"]))


def _ovd_name(low: Column, place: Column) -> Column:
    named = functools.reduce(lambda acc, r: acc.when(place == r[0], F.lit(r[1])), OVD_DISTRICTS.items(), F.when(F.lit(False), F.lit(None).cast("string"))).otherwise(F.concat(F.lit('ОВД "'), place, F.lit('" г. Москвы')))
    return F.when(low.contains("москв") & place.isNotNull(), named).otherwise(_by_parts(low, OVD_NAMES, F.lit(None).cast("string")))


def passport_issuer(x: Column) -> Column:
    """The canonical issuer of a passport; what fits no rule is only repaired."""
    named = lambda v, kind: F.coalesce(F.when(kind == GU_MVD, _gu_mvd(v)).when(kind == UFMS, _ufms(v)).when(kind == OVD, _ovd(v)), v)
    return let(repaired(x), lambda v: let(family(v), lambda kind: named(v, kind)))


def registered_issuer(x: Column) -> Column:
    """The issuer of a resident's passport: as :func:`passport_issuer`, in the case Moscow's names have there."""
    moved = F.replace(passport_issuer(x), F.lit("г. Москвы"), F.lit("г. Москве"))
    return let(moved, lambda v: F.when(F.lower(v).startswith("по г. москве"), "ГУ МВД России по г. Москве").otherwise(v))


def civil_issuer(x: Column) -> Column:
    """The canonical issuer of a certificate or reference: registry offices, foreign ones, unknown ones."""
    return let(repaired(x), lambda v: let(F.lower(v), lambda low: _civil_name(v, low)))


def _civil_name(v: Column, low: Column) -> Column:
    spelled = apply_patterns(v, [(f"(?iuU)\\b{s.replace(' ', chr(92) + 's+')}\\b", s) for s in ZAGS_SPELLINGS])
    spelled = F.regexp_replace(spelled, "(?iuU)\\bотдел\\s+загс\\s+по\\s+заволж(?:скому)?(?:-|\\s+району)?(?!\\w)", "Отдел ЗАГС по Заволжскому району")
    zags = _by_parts(low, ZAGS_NAMES, ws(spelled))
    unknown = F.regexp_replace(v, "(?iuU)\\bнеизвестен\\.?\\s*конвертация\\b", "неизвестен. конвертация")
    return (
        F.when(low.contains("загс") | low.contains("актов гражданского состояния"), zags)
        .when(low.contains("ашкелон") | low.contains("израил"), FOREIGN)
        .when(low.contains("неизвест") | low.contains("конвертац"), unknown)
        .otherwise(v)
    )
