"""Page 1 of a housing form: fields from its lines, between the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import decimal_text, ws
from rowmill.operators.lines import clean_lines, slice_between

# Labels of the form.
LABELS = {
    "address": ("^по адр", "^(Прежнее|Вид засел|Организация)"), "owners": ("^Ф\\. ?И\\. ?О\\.", "^(Организация|на осно|Вид засел)"), "company": ("^Организация", "^(на осно|Вид засел|адрес)"), "documents": ("^на осно", "^(Характ|Площадь|Вид засел)"),
}
FULL_NAME = "^[А-ЯЁ][А-ЯЁа-яё-]+ [А-ЯЁ][А-ЯЁа-яё]+( [А-ЯЁ][А-ЯЁа-яё]+)?$"
SHARE = r"^(\d+/\d+|\d{1,3}([.,]\d+)?|(?i:без опред.*))$"


def block(lines: Column, name: str) -> Column:
    return slice_between(lines, *LABELS[name])


def owner_pairs(lines: Column) -> Column:
    """array<struct<full_name, share>>: names of the owners' block, each with the share of its place."""
    own = block(lines, "owners")
    names = F.filter(own, lambda x: x.rlike(FULL_NAME))
    shares = F.filter(own, lambda x: x.rlike(SHARE))
    return F.transform(names, lambda n, i: F.struct(n.alias("full_name"), F.get(shares, i).alias("share")))


def ownership_documents(lines: Column) -> Column:
    """The documents of the block after the label: a line that begins like one opens it, the others continue it."""
    own = F.filter(block(lines, "documents"), lambda x: ~x.startswith("("))
    opens = "^(Договор|Свидетельство|Решение|Справка|Выписка|Акт|Ордер)"
    step = lambda acc, x: F.when(x.rlike(opens) | (F.size(acc) == 0), F.array_append(acc, x)).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.when(F.element_at(acc, -1).endswith("-"), F.concat(F.regexp_replace(F.element_at(acc, -1), "-$", ""), x)).otherwise(F.concat_ws(" ", F.element_at(acc, -1), x))))
    )
    return F.filter(F.aggregate(own, F.array().cast("array<string>"), step), lambda x: x.rlike(opens))


def read_page1(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the fields of page 1: document_date, okrug_line, address_line, company,
    settlement_type, n_owners, owners, n_documents, first_document, area. Null texts: null fields."""
    lines = pages.select(key, clean_lines(F.col(text)).alias("l"), F.col(text).alias("_t"))
    found = lambda p, g: F.nullif(F.regexp_extract("_t", p, g), F.lit(""))
    owners = owner_pairs(F.col("l"))
    docs = ownership_documents(F.col("l"))
    first = lambda name: F.get(block(F.col("l"), name), F.lit(0))
    return lines.select(
        key, found(r"по состоянию на (\d{2}\.\d{2}\.\d{4})", 1).alias("document_date"), F.get(F.filter("l", lambda x: x.rlike("(?iu)административн.. округ")), F.lit(0)).alias("okrug_line"), first("address").alias("address_line"), first("company").alias("company"),
        F.nullif(ws(found(r"Вид заселения:[ \t]*([^\n]+)", 1)), F.lit("")).alias("settlement_type"), F.coalesce(F.size(owners), F.lit(0)).cast("long").alias("n_owners"),
        F.array_join(F.transform(owners, lambda o: F.concat_ws("=", o["full_name"], o["share"])), "|").alias("owners"), F.coalesce(F.size(docs), F.lit(0)).cast("long").alias("n_documents"), F.get(docs, F.lit(0)).alias("first_document"),
        decimal_text(found(r"Площадь [^\n]*?(\d+[,.]\d+)", 1)).alias("area"),
    )
