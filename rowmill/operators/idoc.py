"""Identity documents and departures read from scanned cells.

A cell's text gives candidates (series and number in every form that is found), each
candidate a score, and the best one is kept; the first of equal ones wins. All of it is
expressions over arrays of one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import check_digit, real_date, ws

# How the kinds of documents are called.
KIND_WORDS = [("foreign_passport", "(?iu)иностран|загран"), ("birth_certificate", "(?iu)свидет|рожден"), ("reference", "(?iu)справк"), ("passport", "(?iu)паспорт")]
_BREAK = r"\s?[-¬]\s?\n\s*"


def one_line(raw: Column | str) -> Column:
    """Broken words closed, white space squeezed."""
    return ws(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, _BREAK, ""))


def kind_of(raw: Column) -> Column:
    """The kind of document a text names; null if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in KIND_WORDS:
        out = out.when(raw.rlike(pattern), F.lit(kind))
    return out


def segments(raw: Column, marker: str) -> Column:
    """The parts of a text, each beginning at a match of ``marker``; what stands before the first is its own part."""
    return F.filter(F.split(raw, f"(?={marker})"), lambda x: F.trim(x) != "")


def candidates(raw: Column) -> Column:
    """array<struct<series, number, strength>> of all readings of series and number, in order of strength and place."""
    found = lambda p, strength: F.transform(
        F.regexp_extract_all(raw, F.lit(p), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, p, 1).alias("series"), F.regexp_extract(m, p, 2).alias("number"), F.lit(strength).alias("strength")),
    )
    gap = r"(?: номер | № ?|№ ?| )"
    return F.concat(
        found(rf"(\d\d \d\d){gap}(\d{{6}})(?!\d)", 3), found(rf"([IVX]+-[А-Я]{{2}}){gap}(\d{{6}})(?!\d)", 3), found(rf"(?<![A-Z])([A-Z]{{2}}){gap}(\d{{7}})(?!\d)", 3), found(r"(?:номер|№) ?()(\d{6,7})(?!\d)", 1),
    )


def best_candidate(cands: Column) -> Column:
    """The candidate with the highest strength, the first of equal ones."""
    scored = F.transform(cands, lambda c, i: F.struct(c["strength"].alias("score"), (-i).alias("order"), c["series"].alias("series"), c["number"].alias("number")))
    return F.array_max(scored)


def read_documents(cells: DataFrame, key: str, raw: str) -> DataFrame:
    """``key``, document_type, series, number, issue_date, issued_by, n_candidates of scanned document cells."""
    flat = cells.select(key, one_line(raw).alias("_raw")).filter("_raw IS NOT NULL")
    read = flat.withColumn("_c", candidates(F.col("_raw"))).withColumn("_b", best_candidate(F.col("_c")))
    dates = F.regexp_extract_all("_raw", F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))
    issuer = F.coalesce(
        F.nullif(F.regexp_extract("_raw", r"кем выдан: (.*?),? дата выдачи", 1), F.lit("")),
        F.nullif(F.regexp_extract("_raw", r"выдан \d{2}\.\d{2}\.\d{4}, (.*)$", 1), F.lit("")),
        F.nullif(F.regexp_extract("_raw", r"выдан (.*?)(?: \d{2}\.\d{2}\.\d{4})?$", 1), F.lit("")),
    )
    valid = F.filter(dates, lambda x: real_date(x).isNotNull())
    return read.select(
        key, kind_of(F.col("_raw")).alias("document_type"), F.nullif("_b.series", F.lit("")).alias("series"), F.nullif("_b.number", F.lit("")).alias("number"),
        F.element_at(F.array_sort(valid, lambda a, b: F.when(real_date(a) < real_date(b), 1).when(real_date(a) > real_date(b), -1).otherwise(0)), F.when(F.size(valid) > 0, 1)).alias("issue_date"),
        issuer.alias("issued_by"), F.size("_c").cast("long").alias("n_candidates"),
    )


def hinted_candidates(rows: DataFrame, key: str, hints: DataFrame) -> DataFrame:
    """``key``, series, number: for each row its series with the region digits replaced by each hint, without those it has.
    rows: key, series, number; hints: key, prefix."""
    made = rows.join(hints, key).select(key, F.concat("prefix", F.substring("series", 3, 3)).alias("series"), "number")
    return made.join(rows.select(key, "series", "number"), [key, "series", "number"], "left_anti").distinct()


def glue_digits(text: Column) -> Column:
    """Groups of digits of an act number written apart are put together, twice, which is enough for 21 digits."""
    join = lambda t: F.regexp_replace(t, r"(\d{5,}) (?=\d{4,})", "$1")
    return join(join(text))


def read_departures(cells: DataFrame, key: str, raw: str) -> DataFrame:
    """``key``, reason, act_record_number, act_digits, death_date, departure_date, scheme, applicable, passed."""
    flat = cells.select(key, one_line(raw).alias("_raw")).filter("_raw IS NOT NULL").withColumn("_t", glue_digits(F.col("_raw")))
    t = F.col("_t")
    reason = F.when(t.rlike("(?iu)умер|смерт"), "death").when(t.rlike("(?iu)форм[аы] ?6|отрывн"), "form_6_stub").otherwise("other")
    act = F.nullif(F.regexp_extract(t, r"(?:а/з|акта)(?: №)? (\d{1,21})(?!\d)", 1), F.lit(""))
    dates = F.regexp_extract_all(t, F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))
    out = flat.select(key, reason.alias("reason"), F.when(reason == "death", act).alias("act_record_number"), F.when(reason == "death", F.get(dates, F.lit(0))).alias("death_date"), F.when(reason != "death", F.try_element_at(dates, F.lit(-1))).alias("departure_date"))
    return with_act_validation(out)


def with_act_validation(rows: DataFrame) -> DataFrame:
    """Adds scheme, applicable, passed of a death record: 21 digits and a date from
    2018-11-04 on make the check digit applicable."""
    n = F.col("act_record_number")
    applies = (F.length(n) == 21) & (real_date("death_date") >= F.lit("2018-11-04").cast("date"))
    passed = n.rlike(r"^\d7\d{19}$") & (check_digit(F.substring(n, 1, 20)) == F.substring(n, 21, 1).cast("int"))
    scheme = F.when(n.isNull(), "unknown").when(F.coalesce(applies, F.lit(False)), "egr_zags_2018").otherwise("pre_egr_local_record")
    return rows.withColumn("scheme", scheme).withColumn("applicable", scheme == "egr_zags_2018").withColumn("passed", F.when(scheme == "egr_zags_2018", passed))


def merge_continuation(rows: DataFrame, key: str) -> DataFrame:
    """A document and its continuation on the next page: of the first, the second, and the two
    together the reading with the most fields wins, the first of equal ones.
    rows: key, first_raw, next_raw."""
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("first_raw").alias("raw")), F.struct(F.lit(1).alias("form"), F.col("next_raw").alias("raw")), F.struct(F.lit(2).alias("form"), F.concat_ws(" ", "first_raw", "next_raw").alias("raw")))
    each = rows.select(F.col(key), F.explode(forms).alias("f")).select(F.struct(F.col(key), F.col("f")).alias("id"), F.col("f.raw").alias("raw"))
    read = read_documents(each, "id", "raw")
    filled = sum(((F.col(c).isNotNull()).cast("int") for c in ("document_type", "series", "number", "issue_date", "issued_by")), F.lit(0))
    best = F.max_by(F.struct("document_type", "series", "number", "issue_date", "issued_by"), F.struct(filled.alias("filled"), (-F.col("id.f.form")).alias("order")))
    return read.groupBy(F.col(f"id.{key}").alias(key)).agg(best.alias("b"), F.max(filled).cast("long").alias("n_fields")).select(key, "b.*", "n_fields")
