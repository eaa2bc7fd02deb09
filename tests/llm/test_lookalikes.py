from __future__ import annotations

import unicodedata

from rowmill.llm.lookalikes import canonical_forms

SCHEMA = "field_name string, record_id long, kind string, value string, form string"
CASES = [
    ("full_name", None, "Иванов Пётр", "Иванов Пётр"), ("full_name", None, "Ивaнов Пётр", "Иванов Пётр"), ("full_name", None, unicodedata.normalize("NFD", "Андрей Ёлкин"), "Андрей Ёлкин"),
    ("full_name", None, "Zеmlak Emil", "Zemlak Emil"), ("full_name", None, "Αлла​ Зорина ", "Алла Зорина"), ("full_name", None, "Зорина－Ким Алла", "Зорина-Ким Алла"), ("full_name", None, "Ｚorin Ivan", "Zorin Ivan"),
    ("series", "passport", "0З 1О", "03 10"), ("series", "passport", "45 10 ", "45 10"), ("series", "passport", "１2 34", "12 34"),
    ("series", "birth_certificate", "ѴІІ‑АB", "VII-АВ"), ("series", "birth_certificate", "IX-ТЛ", "IX-ТЛ"), ("series", "birth_certificate", "ix-тл", "ix-тл"),
    ("series", "foreign_passport", "МВ", "MB"), ("series", "foreign_passport", "JA", "JA"),
    ("house", None, "З0", "30"), ("house", None, "12A", "12А"), ("house", None, "7／2", "7/2"), ("house", None, "5Б", "5Б"), ("house", None, "1⁠0", "10"),
    ("other", None, " x ", "x"), ("full_name", None, " ", ""), ("full_name", None, "", ""),
]


def test_forms(spark):
    rows = [(f, i, k, v, "clash") for i, (f, k, v, _) in enumerate(CASES)] + [("full_name", 900, None, None, "x"), ("full_name", 901, None, "Иванов Пётр", "x"), ("full_name", 901, None, "Иванов Пётр", "x"), ("full_name", 902, None, "Ж" * 60000 + "a", "x")]
    got = canonical_forms(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.record_id: r for r in got}
    for i, (f, _, v, want) in enumerate(CASES):
        assert (by[i].form.lower() if "ix" in v else by[i].form) == want, (f, v)
        assert by[i].changed == (v != want), (f, v)
    assert 900 not in by and len(got) == len(CASES) + 3
    assert by[902].form == "Ж" * 60000 + "а" and by[902].changed


def test_one_member_per_class(spark):
    looks = ["Тома Охова", "Tома Охова", "Томa Охова", "Тома Охова"]
    got = canonical_forms(spark.createDataFrame([("full_name", i, None, v, None) for i, v in enumerate(looks)], SCHEMA)).collect()
    assert {r.form for r in got} == {"Тома Охова"} and sorted(r.record_id for r in got if r.changed) == [1, 2]


def test_the_class_decides_against_the_rules(spark):
    # Letters that are in both scripts: the rules would make the name Cyrillic, its class knows it as Latin.
    rows = [("full_name", i, None, "Cox Poxa", None) for i in range(20)] + [("full_name", 50, None, "Сох Роха", None), ("full_name", 51, None, "Cох Рoха", None)]
    got = {r.record_id: r for r in canonical_forms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.form for r in got.values()} == {"Cox Poxa"} and sorted(k for k, r in got.items() if r.changed) == [50, 51]
    # Where spellings of both scripts are about as frequent, the one the rules leave alone counts more.
    rows = [("full_name", 0, None, "Cox Poxa", None), ("full_name", 1, None, "Сох Роха", None)]
    assert {r.form for r in canonical_forms(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Сох Роха"}


def test_accents_keep_apart(spark):
    got = canonical_forms(spark.createDataFrame([("full_name", 0, None, "Елкин", None), ("full_name", 1, None, "Ёлкин", None)], SCHEMA)).collect()
    assert {r.form for r in got} == {"Елкин", "Ёлкин"}


def test_empty(spark):
    assert canonical_forms(spark.createDataFrame([], SCHEMA)).count() == 0
