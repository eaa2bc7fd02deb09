"""Queries of the issuer grammar, the document grammar and the departures over the scanned cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import departures as P
from rowmill.operators import identity as D
from rowmill.operators import issuers as I
from rowmill.operators.idoc import one_line
from rowmill.plans.documents import cells, gone, hints
from rowmill.plans.sql import current
from rowmill.tables import current as cur


def issuers(s, d):
    return cur(s, d, "identity_documents", "document_id", "issued_by").filter("issued_by IS NOT NULL")


def texts(s, d):
    return cells(s, d).select("document_id", one_line("raw").alias("raw"))


def q_issuer_forms(s, d):
    """Every issuer repaired, with its family, okrug and district."""
    x = F.col("issued_by")
    return issuers(s, d).select("document_id", I.repaired(x).alias("repaired"), I.family(x).alias("family"), I.okrug_code(x).alias("okrug"), I.district(x).alias("district"))


def q_issuer_families(s, d):
    return issuers(s, d).select(I.family(F.col("issued_by")).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


def q_passport_issuers(s, d):
    return issuers(s, d).select("document_id", I.registered_issuer(F.col("issued_by")).alias("issued_by"))


def q_civil_issuers(s, d):
    return issuers(s, d).select("document_id", I.civil_issuer(F.col("issued_by")).alias("issued_by"))


def q_kinds(s, d):
    """What the words of a cell make it, and what stands in it."""
    r = F.col("raw")
    return texts(s, d).select("document_id", D.kind(r).alias("document_type"), D.continues_passport(r).alias("as_passport"), D.continues_certificate(r).alias("as_certificate"), D.continues_reference(r).alias("as_reference"))


def q_marks(s, d):
    r = F.col("raw")
    return texts(s, d).select("document_id", D.continues_passport(r).alias("as_passport"), D.continues_certificate(r).alias("as_certificate"), D.continues_reference(r).alias("as_reference"))


def q_cells(s, d):
    return texts(s, d).withColumn("d", D.read_cell(F.col("raw"))).select("document_id", "d.*", D.completeness(F.col("d")).cast("long").alias("n_fields"), D.merge_points(F.col("d")).cast("long").alias("points"))


def q_cell_segments(s, d):
    date = D.issue_date(F.col("raw"))
    return texts(s, d).select("document_id", date.alias("issue_date"), D.segment(F.col("raw"), date, F.lit("паспорт|справка")).alias("segment"), D.issuer_without_mark(F.col("raw"), date).alias("issuer"))


def q_issue_dates(s, d):
    return texts(s, d).select("document_id", D.issue_date(F.col("raw")).alias("issue_date"))


def q_certificate_series(s, d):
    x = cur(s, d, "identity_documents", "document_id", "document_type", "series").filter("document_type = 'birth_certificate' AND series IS NOT NULL")
    made = D.certificate_series(F.col("series"))
    return x.select("document_id", made.alias("series"), D.series_quality(made).cast("long").alias("quality"))


def q_series_text(s, d):
    x = cur(s, d, "identity_documents", "document_id", "series", "number").filter("series IS NOT NULL")
    return x.select("document_id", D.series_text(F.col("series")).alias("series"), D.digits_or_text(F.col("number")).alias("number"))


def q_hinted_best(s, d):
    """Series and number of passports, with what is known of the regions of their issuers."""
    known = hints(s, d).groupBy("issued_by").agg(F.map_from_entries(F.collect_list(F.struct("prefix", F.least(F.col("n"), F.lit(3)).cast("int").alias("w")))).alias("hints"))
    x = cur(s, d, "identity_documents", "document_id", "raw", "issued_by").filter("raw IS NOT NULL").join(known, "issued_by", "left").withColumn("raw", one_line("raw"))
    best = D.best_passport(F.col("raw"), D.issue_date(F.col("raw")), F.col("hints"))
    return x.select("document_id", best.alias("b")).select("document_id", "b.series", "b.number")


def q_continued(s, d):
    """Every document with its own text as the rest of a page before: read apart and together."""
    x = texts(s, d).withColumn("d", D.read_cell(F.col("raw"))).withColumn("m", D.continued(F.col("d"), F.col("raw"), F.col("d")))
    return x.select("document_id", "m.document_type", "m.series", "m.number", "m.issued_by", "m.issue_date")


def told(s, d):
    return gone(s, d).select("departure_id", P.read(one_line("raw")).alias("d"))


def q_departures(s, d):
    return told(s, d).select("departure_id", "d.*")


def q_departure_points(s, d):
    x = F.col("d")
    return told(s, d).select("departure_id", P.completeness(x).cast("long").alias("n_parts"), P.candidate_points(x).cast("long").alias("points"), P.quality(x).alias("quality"), P.may_go_on(x).alias("goes_on"), P.read_again(x).alias("again"), P.better(x, F.lit(None).cast(P.DEPARTURE)).alias("better_than_none"))


def q_departure_facts(s, d):
    t = P.tidied(one_line("raw"))
    return gone(s, d).withColumn("t", t).select("departure_id", P.first_date(F.col("t")).alias("first_date"), P.last_date(F.col("t")).alias("last_date"), P.named_date(F.col("t")).alias("named_date"), P.act_number(F.col("t")).alias("act_number"), P.office(F.col("t")).alias("office"), P.stub_address(F.col("t")).alias("address"))


def q_departure_dates(s, d):
    return gone(s, d).select("departure_id", P.first_date(one_line("raw")).alias("first_date"), P.last_date(one_line("raw")).alias("last_date"))


def q_continued_departures(s, d):
    x = told(s, d).join(gone(s, d).select("departure_id", one_line("raw").alias("raw")), "departure_id")
    return x.select("departure_id", P.continued(F.col("d"), F.col("raw"), F.col("d")).alias("m")).select("departure_id", "m.reason", "m.act_record_number", "m.death_date", "m.departure_date")


_RAW = f"(SELECT document_id, trim(regexp_replace(regexp_replace(raw, '\\s?[-¬]\\s?\\n\\s*', '', 'g'), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')) AS raw FROM {current('identity_documents')} WHERE raw IS NOT NULL)"
_GONE = _RAW.replace("document_id", "departure_id").replace("identity_documents", "departures").replace("PARTITION BY document_id", "PARTITION BY departure_id")
_ISS = f"(SELECT document_id, issued_by, lower(issued_by) AS low FROM {current('identity_documents')} WHERE issued_by IS NOT NULL)"
_FAMILY = "CASE WHEN contains(low, 'гу мвд') OR contains(low, 'мвд россии') AND NOT contains(low, 'уфмс') AND NOT contains(low, 'овд') THEN 'GU_MVD' WHEN contains(low, 'уфмс') THEN 'UFMS' WHEN contains(low, 'овд') OR contains(low, 'увд') THEN 'OVD' END"
_DATES = "regexp_extract_all(raw, '\\d{2}\\.\\d{2}\\.\\d{4}')"
_WHOLE = "CASE WHEN regexp_full_match(x, '\\d{2}\\.\\d{2}\\.\\d{4}') THEN x WHEN regexp_full_match(x, '\\d{2}\\.\\d{2}\\.\\d{2}') THEN substr(x, 1, 6) || '20' || right(x, 2) WHEN regexp_full_match(x, '\\d{8}\\.\\d{4}') THEN substr(x, 1, 2) || '.' || substr(x, 3, 2) || '.' || right(x, 4) END"
_ALL = f"list_filter(list_transform(regexp_extract_all(raw, '(^|[^\\d])(\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}|\\d{{2}}\\.\\d{{2}}\\.\\d{{3}}|\\d{{2}}\\.\\d{{2}}\\.\\d{{2}}|\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}|\\d{{4,8}}\\.\\d{{4}})', 2), lambda x: {_WHOLE}), lambda x: x IS NOT NULL)"
QUERIES = {
    "issuer_forms": q_issuer_forms, "issuer_families": q_issuer_families, "passport_issuers": q_passport_issuers, "civil_issuers": q_civil_issuers, "cell_kinds": q_kinds, "continuation_marks": q_marks, "cell_documents": q_cells, "cell_segments": q_cell_segments, "issue_dates": q_issue_dates,
    "certificate_series": q_certificate_series, "series_text": q_series_text, "hinted_best": q_hinted_best, "continued_documents": q_continued, "departures_read": q_departures, "departure_points": q_departure_points, "departure_facts": q_departure_facts, "departure_dates": q_departure_dates, "continued_departures": q_continued_departures,
}
ORACLE = {
    "issuer_families": f"SELECT {_FAMILY} AS family, count(*) AS n FROM {_ISS} GROUP BY ALL",
    "continuation_marks": f"SELECT document_id, regexp_matches(raw, '№\\s*\\d{{6}}\\s+\\d{{2}}\\s+\\d{{2}}') AND len({_DATES}) > 0 AND regexp_matches(raw, '(?i)выдан|овд|мвд|уфмс') AND NOT regexp_matches(raw, '(?i)загс') AS as_passport, regexp_matches(raw, '№\\s*\\d{{6,8}}') AND len({_DATES}) > 0 AND regexp_matches(raw, '(?i)загс|свидетель|актов гражданского состояния') AS as_certificate, regexp_matches(raw, '№?\\s*\\d{{6}}') AND len({_DATES}) > 0 AND regexp_matches(raw, '(?i)справк|неизвес|конвертац') AS as_reference FROM {_RAW}",
    "issue_dates": f"SELECT document_id, coalesce(list_max(list_transform(list_filter(x, lambda v: try_strptime(v, '%d.%m.%Y') IS NOT NULL), lambda v: {{'at': try_strptime(v, '%d.%m.%Y'), 'v': v}})).v, x[-1]) AS issue_date FROM (SELECT document_id, {_DATES} AS x FROM {_RAW})",
    "series_text": f"SELECT document_id, CASE WHEN regexp_full_match(regexp_replace(series, '\\s+', '', 'g'), '\\d{{4}}') THEN substr(regexp_replace(series, '\\s+', '', 'g'), 1, 2) || ' ' || right(regexp_replace(series, '\\s+', '', 'g'), 2) ELSE nullif(trim(regexp_replace(series, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')), '') END AS series, coalesce(nullif(regexp_replace(number, '\\D', '', 'g'), ''), nullif(trim(regexp_replace(number, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')), '')) AS number FROM {current('identity_documents')} WHERE series IS NOT NULL",
}
