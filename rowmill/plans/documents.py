"""Queries of the document and departure grammars over the scanned cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import idoc as D
from rowmill.plans.sql import current
from rowmill.tables import current as cur
from rowmill.tables import table


def cells(s, d):
    return cur(s, d, "identity_documents", "document_id", "raw").filter("raw IS NOT NULL")


def gone(s, d):
    return cur(s, d, "departures", "departure_id", "raw").filter("raw IS NOT NULL")


def q_documents(s, d):
    return D.read_documents(cells(s, d), "document_id", "raw")


def q_kinds(s, d):
    return cells(s, d).select(D.kind_of(D.one_line("raw")).alias("document_type")).groupBy("document_type").agg(F.count("*").alias("n"))


def q_candidates(s, d):
    c = cells(s, d).select("document_id", F.explode(D.candidates(D.one_line("raw"))).alias("c"))
    return c.groupBy("document_id").agg(F.count("*").alias("n_candidates"), F.max("c.strength").cast("long").alias("best_strength"))


def q_segments(s, d):
    parts = F.posexplode(D.segments(D.one_line("raw"), "(?:номер|выдан|кем выдан|дата выдачи)"))
    return cells(s, d).select("document_id", parts.alias("place", "segment")).select("document_id", F.col("place").cast("long").alias("place"), F.trim("segment").alias("segment"))


def hints(s, d):
    """Region digits seen with an issuing body in at least two documents."""
    x = cur(s, d, "identity_documents", "document_id", "document_type", "series", "issued_by").filter("document_type = 'passport' AND series RLIKE '^[0-9]{2} [0-9]{2}$' AND issued_by IS NOT NULL")
    return x.groupBy("issued_by", F.substring("series", 1, 2).alias("prefix")).agg(F.count("*").alias("n")).filter("n >= 2")


def q_hinted(s, d):
    x = cur(s, d, "identity_documents", "document_id", "document_type", "series", "number", "issued_by").filter("document_type = 'passport' AND series RLIKE '^[0-9]{2} [0-9]{2}$' AND issued_by IS NOT NULL AND number IS NOT NULL")
    h = x.select("document_id", "issued_by").join(hints(s, d), "issued_by").select("document_id", "prefix")
    return D.hinted_candidates(x.select("document_id", "series", "number"), "document_id", h)


def q_departures(s, d):
    return D.read_departures(gone(s, d), "departure_id", "raw")


def q_departure_reasons(s, d):
    return q_departures(s, d).groupBy("reason", "scheme").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def q_act_validation(s, d):
    rows = cur(s, d, "departures", "departure_id", "act_record_number", "death_date").filter("act_record_number IS NOT NULL")
    return D.with_act_validation(rows).select("departure_id", "scheme", "applicable", "passed")


def q_validation_agrees(s, d):
    rows = D.with_act_validation(cur(s, d, "departures", "departure_id", "act_record_number", "death_date", "validation").filter("act_record_number IS NOT NULL"))
    same = F.col("scheme").eqNullSafe(F.col("validation.scheme")) & F.col("passed").eqNullSafe(F.col("validation.passed"))
    return rows.groupBy(same.alias("agrees")).agg(F.count("*").alias("n"))


def q_continuation(s, d):
    cut = F.instr("raw", ",")
    rows = cells(s, d).filter(cut > 0).select("document_id", F.expr("substring(raw, 1, instr(raw, ',') - 1)").alias("first_raw"), F.expr("substring(raw, instr(raw, ',') + 1)").alias("next_raw"))
    return D.merge_continuation(rows, "document_id")


_ONE = "trim(regexp_replace(regexp_replace(raw, '\\s?[-¬]\\s?\\n\\s*', '', 'g'), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g'))"
_KIND = "CASE WHEN regexp_matches(t, '(?i)иностран|загран') THEN 'foreign_passport' WHEN regexp_matches(t, '(?i)свидет|рожден') THEN 'birth_certificate' WHEN regexp_matches(t, '(?i)справк') THEN 'reference' WHEN regexp_matches(t, '(?i)паспорт') THEN 'passport' END"
_CELLS = f"c AS (SELECT document_id, {_ONE} AS t FROM {current('identity_documents')} WHERE raw IS NOT NULL)"
_GONE = f"g AS (SELECT departure_id, regexp_replace(regexp_replace({_ONE}, '(\\d{{5,}}) (\\d{{4,}})', '\\1\\2', 'g'), '(\\d{{5,}}) (\\d{{4,}})', '\\1\\2', 'g') AS t FROM {current('departures')} WHERE raw IS NOT NULL)"
_PASS = "document_type = 'passport' AND regexp_full_match(series, '[0-9]{2} [0-9]{2}') AND issued_by IS NOT NULL"


def _digit(n: str) -> str:
    d = lambda i: f"CAST(substr({n},{i},1) AS INTEGER)*{2 - i % 2}"
    return "((10 - (" + " + ".join(f"(CASE WHEN {d(i)} > 9 THEN {d(i)} - 9 ELSE {d(i)} END)" for i in range(1, 21)) + ") % 10) % 10)"


_APPLIES = "length(act_record_number) = 21 AND CAST(try_strptime(death_date, '%d.%m.%Y') AS DATE) >= DATE '2018-11-04'"
_VALID = f"""SELECT *, CASE WHEN act_record_number IS NULL THEN 'unknown' WHEN coalesce({_APPLIES}, false) THEN 'egr_zags_2018' ELSE 'pre_egr_local_record' END AS scheme,
  CASE WHEN act_record_number IS NOT NULL AND coalesce({_APPLIES}, false) THEN CASE WHEN regexp_full_match(act_record_number, '\\d7\\d{{19}}') THEN {_digit('act_record_number')} = CAST(substr(act_record_number, 21, 1) AS INTEGER) ELSE false END END AS passed"""
_READ_GONE = f"""r AS (SELECT departure_id, CASE WHEN regexp_matches(t, '(?i)умер|смерт') THEN 'death' WHEN regexp_matches(t, '(?i)форм[аы] ?6|отрывн') THEN 'form_6_stub' ELSE 'other' END AS reason, t FROM g),
  q AS (SELECT departure_id, reason, CASE WHEN reason = 'death' THEN nullif(regexp_extract(t, '(?:а/з|акта)(?: №)? (\\d{{1,21}})(?:\\D|$)', 1), '') END AS act_record_number,
    CASE WHEN reason = 'death' THEN regexp_extract_all(t, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}')[1] END AS death_date, CASE WHEN reason <> 'death' THEN regexp_extract_all(t, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}')[-1] END AS departure_date FROM r),
  v AS ({_VALID} FROM q)"""
QUERIES = {
    "document_cells": q_documents, "document_kinds": q_kinds, "document_candidates": q_candidates, "document_segments": q_segments, "hinted_candidates": q_hinted, "departure_cells": q_departures,
    "departure_reasons": q_departure_reasons, "act_validation": q_act_validation, "validation_agrees": q_validation_agrees, "document_continuation": q_continuation,
}
ORACLE = {
    "document_kinds": f"WITH {_CELLS} SELECT {_KIND} AS document_type, count(*) AS n FROM c GROUP BY ALL",
    "hinted_candidates": f"""WITH x AS (SELECT * FROM {current('identity_documents')} WHERE {_PASS}), h AS (SELECT issued_by, substr(series, 1, 2) AS prefix FROM x GROUP BY ALL HAVING count(*) >= 2)
      SELECT DISTINCT document_id, prefix || substr(series, 3, 3) AS series, number FROM x JOIN h USING (issued_by) WHERE number IS NOT NULL AND prefix <> substr(series, 1, 2)""",
    "departure_cells": f"WITH {_GONE}, {_READ_GONE} SELECT departure_id, reason, act_record_number, death_date, departure_date, scheme, scheme = 'egr_zags_2018' AS applicable, passed FROM v",
    "departure_reasons": f"WITH {_GONE}, {_READ_GONE} SELECT reason, scheme, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM v GROUP BY ALL",
    "act_validation": f"SELECT departure_id, scheme, scheme = 'egr_zags_2018' AS applicable, passed FROM ({_VALID} FROM {current('departures')} WHERE act_record_number IS NOT NULL)",
    "validation_agrees": f"SELECT scheme IS NOT DISTINCT FROM validation.scheme AND passed IS NOT DISTINCT FROM validation.passed AS agrees, count(*) AS n FROM ({_VALID} FROM {current('departures')} WHERE act_record_number IS NOT NULL) GROUP BY ALL",
}
