"""Visually equal texts in one consistent form, in SQL.

Values are mapped to a skeleton (one letter for all letters that look alike, ordinary
widths, hyphens and spaces, nothing invisible). Skeletons are grouped under the
accent-sensitive Unicode collation, under which composed and decomposed letters are
equal and other accents are not. Each class gets one canonical member, chosen
deterministically among its members by form and frequency (see :func:`canonical_forms`);
only a class without a member in a consistent form gets the one the rules of its field
make. The member is joined back to the values of its class.

All of it is built-in expressions; only distinct values are grouped, so a value that
fills a third of the table is handled once.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of the three scripts that look alike.
_CYR = "АВЕКМНОРСТУХІЈЅѴаеорсухіјѕкмтиьг"
_LAT = "ABEKMHOPCTYXIJSVaeopcyxijskmtubr"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχ"
_GREEK_LAT = "ABEZHIKMNOPTYXaeikvoptux"
_GREEK_CYR = "АВЕЗНІКМНОРТУХаеікворгух"
# Latin letters that stand for a Cyrillic one in a Cyrillic word.
_LAT_FOR_CYR = "ABCEHKMOPTXYacekmnopruxytbgdivsjhlzfqwDFGIJLNQRSUVWZ03"
_CYR_FOR_LAT = "АВСЕНКМОРТХУасектпоргихутьгдивзјнлзфквДФГІЈЛНКРСИВШЗОЗ"
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF\\u00AD\\u034F\\u061C\\u180E\\uFE00-\\uFE0F\\u115F\\u1160\\u3164\\u0000-\\u0008]"
BLANK = "[\\u0009-\\u000D\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
DASH = "[\\u2010-\\u2015\\u2212\\uFE58\\uFE63\\uFF0D]"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "⁄∕"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + "//"
_MARKS = "̧̀́̂̃̈̆̌̊̇"
_PAIRS = [(b + m, c) for b in "иеИЕуУaeiouyncszgrtdlAEIOUYNCSZGRTDL" for m in _MARKS if len(c := unicodedata.normalize("NFC", b + m)) == 1]
_ROMAN = [(chr(0x2160 + i), r) for i, r in enumerate("I II III IV V VI VII VIII IX X XI XII".split())]


def ordinary(value: Column) -> Column:
    """Composed, ordinary width, ordinary hyphens and spaces, nothing invisible, no outer blanks."""
    v = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, INVISIBLE, ""), BLANK, " "), DASH, "-"), _WIDE, _NARROW)
    composed = v
    for apart, one in _PAIRS:
        composed = F.replace(composed, F.lit(apart), F.lit(one))
    return F.trim(F.when(v.rlike("\\p{M}"), composed).otherwise(v))


def skeleton(value: Column, field: Column) -> Column:
    """One sign for all that look alike: letters of three scripts, digits that pass for
    letters, and in series the strokes that pass for I. ``value`` is in capitals."""
    one = F.translate(F.translate(value, _CYR, _LAT), _GREEK + "ЗО03", _GREEK_LAT + "3OO3")
    for sign, letters in _ROMAN:
        one = F.replace(one, F.lit(sign), F.lit(letters))
    return F.when(field == "series", F.translate(one, "1L|", "III")).otherwise(one)


def _count(value: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{letters}]", ""))


_ONLY_CYR = "БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁбвгджзийклмнптфцчшщъыьэюяё"
_ONLY_LAT = "DFGIJLNQRSUVWZbdfghijklmnqrstuvwz"


def of_name(v: Column) -> Column:
    """A name keeps to the script of most of its unmistakable letters; Cyrillic if they are equal."""
    v = F.translate(v, "ⅠⅤⅩ", "IVX")
    latin = F.translate(F.translate(v, _CYR, _LAT), _GREEK, _GREEK_LAT)
    cyr = F.translate(F.translate(v, _GREEK, _GREEK_CYR), _LAT_FOR_CYR, _CYR_FOR_LAT)
    return F.when(_count(v, _ONLY_LAT) > _count(v, _ONLY_CYR), latin).otherwise(cyr)


_ROMAN_LOOK = ("ІіХхѴѵУСМ1lLivxΙΧ|", "IIXXVVVCMIIIIVXIXI")
_DIGIT_LOOK = ("ОоOoОΟοЗзЭІIlі|", "0000000333" + "11111")


def of_series(v: Column, kind: Column) -> Column:
    """The series of a document by its kind; series of other kinds are only made ordinary."""
    digits = F.translate(v, "ОоOoΟοЗзIlІіΙ|", "00000033111111")
    roman = v
    for sign, letters in _ROMAN:
        roman = F.replace(roman, F.lit(sign), F.lit(letters))
    head = F.translate(F.regexp_extract(roman, "^([^-]*)", 1), *_ROMAN_LOOK)
    tail = F.translate(F.translate(F.regexp_extract(roman, "^[^-]*(.*)$", 1), _GREEK, _GREEK_CYR), _LAT_FOR_CYR, _CYR_FOR_LAT)
    latin = F.translate(F.translate(v, _CYR + "0", _LAT + "O"), _GREEK, _GREEK_LAT)
    return F.when(kind == "passport", digits).when(kind == "birth_certificate", F.concat(head, tail)).when(kind == "foreign_passport", latin).otherwise(v)


def of_house(v: Column) -> Column:
    """Digits, a fraction, and a Cyrillic letter; what passes for a digit is one."""
    letters = F.translate(F.translate(v, _GREEK, _GREEK_CYR), _LAT_FOR_CYR.replace("0", "").replace("3", ""), _CYR_FOR_LAT[:-2])
    return F.translate(letters, "ОоЗзІі", "003311")


#: How many times as frequent another member of a class must be to be preferred to the member the rules of the field would make.
PRIOR = 8


def _consistent(field: Column, value: Column, made: Column) -> Column:
    """Whether a value may stand as the form of its class: it is as the rules of its field
    make it, or, for a name, it keeps to plain Latin letters throughout."""
    return (made == value) | ((field == "full_name") & value.rlike("^[A-Za-z][A-Za-z .,'-]*$") & (F.trim(value) == value))


def canonical_forms(values: DataFrame) -> DataFrame:
    """field_name, record_id, kind, value, form, changed of every row of ``values``.

    values: field_name (full_name, series, house; others are only made ordinary), record_id, kind
    (document type, may be null), value. Null values are left out; a value of nothing but
    blanks gets the empty form. changed: the value isn't in its consistent form; case
    doesn't count. Repeated rows come out repeated.

    A class (field, kind, skeleton under UNICODE collation) takes one of its consistent
    members: the most frequent, where a member that its field's rules wouldn't touch
    counts ``PRIOR`` times; equal ones by their order. The rules make a form only for
    classes that have no consistent member.
    """
    clean = ordinary(F.col("value"))
    rows = values.filter(F.col("value").isNotNull()).withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("_v", clean)
    made = F.when(F.col("field_name") == "full_name", of_name(F.col("_v"))).when(F.col("field_name") == "series", of_series(F.col("_v"), F.col("kind"))).when(F.col("field_name") == "house", of_house(F.col("_v"))).otherwise(F.col("_v"))
    distinct = rows.groupBy("field_name", "kind", "value").agg(F.count("*").alias("n"), F.first("_v").alias("_v")).withColumn("made", made)
    distinct = distinct.withColumn("skeleton", skeleton(F.upper("_v"), F.col("field_name"))).withColumn("consistent", _consistent(F.col("field_name"), F.col("value"), F.col("made")))
    weighted = distinct.withColumn("weight", F.col("n") * F.when(F.col("made") == F.col("value"), PRIOR).otherwise(1))
    classes = values.sparkSession.sql(
        """
        SELECT field_name, kind, skeleton COLLATE UNICODE AS class,
               max_by(value, struct(weight, -ascii(value), value)) FILTER (WHERE consistent) AS member, max_by(made, struct(n, made)) AS fallback
        FROM {spellings}
        GROUP BY field_name, kind, skeleton COLLATE UNICODE
        """,
        spellings=weighted,
    )
    joined = distinct.alias("d").join(classes.alias("c"), (F.col("d.field_name") == F.col("c.field_name")) & (F.col("d.kind") == F.col("c.kind")) & (F.expr("d.skeleton COLLATE UNICODE") == F.col("c.class")))
    member = F.coalesce("c.member", "c.fallback")
    cased = F.when(F.lower(member) == F.lower("d.value"), F.col("d.value")).when(F.lower(member) == F.lower("d.made"), F.col("d.made")).when(F.upper("d._v") == F.col("d._v"), F.upper(member)).otherwise(member)
    forms = joined.select("d.field_name", "d.kind", "d.value", cased.cast("string").alias("form"))
    return rows.select("field_name", "record_id", "kind", "value").join(forms, ["field_name", "kind", "value"]).select(
        "field_name", "record_id", "kind", "value", "form", (F.lower("form") != F.lower("value")).alias("changed")
    )
