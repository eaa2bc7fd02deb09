from __future__ import annotations

import random

import pytest

from rowmill.llm.canonical import FIELDS, Lookup, match_values, weighted
from rowmill.llm.chars import osa

NAMES = {
    "district": ["Терновый Лог", "Терновый Бор", "Глиняный Кут", "Ивовый Яр", "Дубравный Стан"],
    "administrative_okrug": ["Старогорский административный округ", "Северодольный административный округ", "Речной административный округ"],
    "issued_by": ["Отдел внутренних дел района Терновый Лог города Вербограда", "Отделение миграционного учёта по району Терновый Лог города Вербограда", "Паспортный стол, город Мирск", "Отдел внутренних дел, город Мирск"],
}


def lookup(f):
    return Lookup([(i, n, 0) for i, n in enumerate(NAMES[f])], FIELDS[f])


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        ("district", "р-н Терновый Лог", 0), ("district", "ЛОГ ТЕРНОВЫЙ", 0), ("district", "ТерновыйБор", 1), ("district", "Глинян. Кут", 2), ("district", "Глняный-Кут", 2), ("district", "Район: ивовый яр,", 3), ("district", "Терновый", -1), ("district", "мкр. Полевой", -1), ("district", "----", -1), ("district", "", -1),
        ("administrative_okrug", "СГАО", 0), ("administrative_okrug", "с.д.а.о.", 1), ("administrative_okrug", "РАО", 2), ("administrative_okrug", "АО", -1), ("administrative_okrug", "округ Ренчой", 2), ("administrative_okrug", "Морской административный округ", -1),
        ("issued_by", "О.В.Д. р-на Терновый Лог", 0), ("issued_by", "ОМУ по рйпону Терновй Лог, г.Вербоград", 1), ("issued_by", "г. Вербоград, Отд. миграц. учета Терновый Лог", 1), ("issued_by", "П/С, г.Мирск код 000", 2), ("issued_by", "Отд. внутр. дел гор. Мисрк", 3), ("issued_by", "Сельский отдел записи № 5, п. Мирово", -1),
    ],
)
def test_entries(f, value, want):
    assert lookup(f).find(value)[0] == want


def test_weighted_cost_is_bounded_by_edits():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choices("абвгде", k=r.randrange(1, 7))) for _ in "ab")
        assert weighted(a, b, 99) <= osa(a, b) + 1e-9
    assert weighted("слово", "слово", 0) == 0 and weighted("а", "ббббб", 2) == float("inf")


def test_symmetric_delete_finds_what_brute_force_finds():
    look = lookup("district")
    words = [w for _, keys, _, _ in look.entries for w in keys]
    r = random.Random(5)
    for _ in range(200):
        w = list(r.choice([x for x in words if len(x) > 5]))
        for _ in range(2):
            i = r.randrange(1, len(w))
            w[i : i + 1] = r.choice([[], ["ж"], [w[i], "ж"]])
        typed = "".join(w)
        brute = {x for x in words if osa(typed, x) <= 2 and weighted(typed, x, 2.1) <= 2.1}
        assert brute <= set(look.near(typed))


def test_match_values(spark):
    rows = [("district", "Терновый Лог", 1), ("district", "терновый лог", 2), ("district", "терновый лог", 2), ("district", None, 3), ("district", " ", 4), ("other", "x", 5), ("district", "ж" * 50000, 6)]
    ref = spark.createDataFrame([("district", i, n, 7) for i, n in enumerate(NAMES["district"])], "field_name string, ref_id int, canonical_name string, n int")
    df = spark.createDataFrame(rows, "field_name string, value string, ref_id int")
    got = {(r.field_name, r.value[:15]): (r.n, r.ref_id) for r in match_values(df, ref).collect()}
    assert got == {("district", "Терновый Лог"): (1, 0), ("district", "терновый лог"): (2, 0), ("district", " "): (1, -1), ("other", "x"): (1, -1), ("district", "ж" * 15): (1, -1)}
    assert match_values(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in match_values(df, ref.limit(0)).collect()} == {-1}
