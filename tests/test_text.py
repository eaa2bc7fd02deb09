from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowmill.functions import text as T


def one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (T.ws, "  a  b\n c ", "a b c"), (T.ws, None, None), (T.ws, "", ""), (T.canon, "Ёлка — «Дом», 5-Б!", "елка дом 5 б"), (T.canon, None, None),
        (T.cyrillic_lookalikes, "Иванoв", "Иванов"), (T.cyrillic_lookalikes, "Ivanov", "Ivanov"), (T.cyrillic_lookalikes, None, None),
        (T.decimal_text, "51,678", "51.67"), (T.decimal_text, "51", "51.00"), (T.decimal_text, "5,6", "5.60"), (T.decimal_text, "x", None), (T.decimal_text, None, None),
        (T.phone, "+7 (123) 456-78-90", "+7(123)456-78-90"), (T.phone, "12", "12"), (T.phone, None, None), (T.file_name, "а/б?.pdf", "а_б_.pdf"), (T.file_name, None, "document.pdf"), (T.file_name, "  ", "document.pdf"),
        (T.ocr_date, "O1.I2.2O3l", "01.12.2031"), (T.ocr_date, "99.12.2031", None), (T.ocr_date, "1.2.3", None), (T.partial_date, "1/2/31", "01.02.1931"), (T.partial_date, "1.2.05", "01.02.2005"), (T.partial_date, "нет", None),
        (T.title_case, "северный-яр", "Северный-Яр"), (T.title_case, "а" * 3000, "А" + "а" * 2999), (T.merge_hyphens, "Зор- Ин Пётр", "Зорин Пётр"), (T.merge_hyphens, "", ""),
        (T.name_confidence, "Зорин Пётр Ильич", 1.0), (T.name_confidence, "Зорин 5", 0.5), (T.name_confidence, None, 0.0), (T.name_confidence, " ,. ", 0.0), (T.date_confidence, "01.02.2003", 1.0), (T.date_confidence, "2003", 0.4), (T.address_confidence, "ул. А, дом 1, кв. 2", 0.95), (T.enum_confidence, " ", 0.0), (T.text_confidence, "ООО Дом 5", 0.9),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_check_digit(spark):
    digits = "97842753459860287821"
    total = sum(v - 9 if v > 9 else v for v in (int(d) * (1 if i % 2 == 0 else 2) for i, d in enumerate(digits)))
    assert one(spark, T.check_digit, digits) == -total % 10 and one(spark, T.check_digit, "x") is None


def test_rules_keep_their_order(spark):
    assert one(spark, lambda c: T.apply_literals(c, [("a", "b"), ("b", "c")]), "ab") == "cc"
    assert one(spark, lambda c: T.apply_patterns(c, [("(a)(b)", "$2$1"), ("^b", "x")]), "ab") == "xa"
    rules = [(["x", "y"], "both"), (["x"], "one")]
    assert [one(spark, lambda c: T.apply_contains_all(c, rules), v) for v in ("Y X", "x", "z", None)] == ["both", "one", None, None]


def test_name_parts(spark):
    r = one(spark, T.name_parts, "Зорин  Пётр Ильич Младший")
    assert (r.last_name, r.first_name, r.middle_name) == ("Зорин", "Пётр", "Ильич Младший")
    r = one(spark, T.name_parts, "")
    assert (r.last_name, r.first_name, r.middle_name) == (None, None, None)


def test_latest_date(spark):
    assert str(one(spark, T.latest_date, "31.02.2030 01.01.2020 05.05.2019")) == "2020-01-01" and one(spark, T.latest_date, "") is None
