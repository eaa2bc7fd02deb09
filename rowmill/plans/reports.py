"""Data-quality and throughput reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators.persons import PATRONYMIC
from rowmill.plans.scalars import _DOC, _HAS, ORACLE as SCALAR
from rowmill.plans.sql import current, ws
from rowmill.tables import current as cur
from rowmill.tables import table


def names(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").filter("trim(full_name) <> ''").withColumn("t", T.name_tokens("full_name"))


def q_quality(s, d):
    """Counters of what looks wrong in names, over all persons."""
    n, t = F.size("t"), F.col("t")
    bad = lambda c: F.count_if(c)
    last = F.element_at("t", F.when(n >= 3, 3))
    return names(s, d).agg(
        F.count("*").alias("persons_total"), bad(~n.isin(2, 3)).alias("bad_token_count"), bad(F.exists(t, lambda a: a.rlike("[A-Za-z]"))).alias("latin_in_name"), bad(F.exists(t, lambda a: a.rlike("[0-9]"))).alias("digits_in_name"),
        bad(n == 2).alias("missing_patronymic"), bad((n == 3) & ~last.rlike(PATRONYMIC)).alias("non_patronymic_third_token"), bad(F.exists(t, lambda a: ~a.rlike("^[A-ZА-ЯЁ]"))).alias("bad_caps"),
    )


def q_low_confidence(s, d):
    """Page-1 fields below 0.75, one row per field (an unpivot)."""
    x = cur(s, d, "page1_records", "page1_id", "document_date", "settlement_type", "administrative_okrug", "district")
    f = lambda name, conf: F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), conf.alias("confidence"))
    fields = F.array(f("document_date", T.date_confidence("document_date")), f("settlement_type", T.enum_confidence("settlement_type")), f("administrative_okrug", T.enum_confidence("administrative_okrug")), f("district", T.enum_confidence("district")))
    return x.select("page1_id", F.explode(fields).alias("f")).select("page1_id", "f.*").filter("confidence < 0.75")


def q_low_residents(s, d):
    r = cur(s, d, "residents", "resident_id", "full_name", "document_id")
    doc = cur(s, d, "identity_documents", "document_id", "document_type", "series", "number", "issued_by", "issue_date", "raw")
    conf = T.document_confidence(*[F.col(c) for c in ("document_type", "series", "number", "issued_by", "issue_date", "raw")])
    x = r.join(doc, "document_id", "left").select("resident_id", T.name_confidence("full_name").alias("name_confidence"), conf.alias("document_confidence"))
    return x.filter("name_confidence < 0.75 OR (document_confidence NOT IN (0.0, 1.0) AND document_confidence < 0.7)")


def q_missing(s, d):
    """How often each required field is missing."""
    x = cur(s, d, "page1_records", "page1_id", "document_date", "administrative_okrug", "district", "settlement_type", "management_company")
    cols = [c for c in x.columns if c != "page1_id"]
    return x.select(*[F.col(c).cast("string") for c in cols]).unpivot([], cols, "field", "value").groupBy("field").agg(F.count_if(F.coalesce(F.trim("value"), F.lit("")) == "").alias("n_missing"), F.count("*").alias("n"))


def q_completeness(s, d):
    x = cur(s, d, "identity_documents", "document_id", "document_type", "series", "number", "issued_by", "issue_date")
    n = sum((F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in ("document_type", "series", "number", "issued_by", "issue_date"))
    return x.withColumn("n_fields", n.cast("long")).groupBy("document_type", "n_fields").agg(F.count("*").alias("n"))


def q_pages(s, d):
    p = cur(s, d, "ocr_pages", "page_id", "job_id", "file_index", "page_number", "text")
    have = p.groupBy("job_id", "file_index").agg(F.count("*").alias("n_pages"), F.max("page_number").cast("long").alias("last_page"), F.sum(F.length("text")).alias("n_chars"))
    want = cur(s, d, "job_files", "job_id", "file_index", "pages")
    return want.join(have, ["job_id", "file_index"], "left").select("job_id", "file_index", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), (F.coalesce("pages", F.lit(0)) - F.coalesce("n_pages", F.lit(0))).cast("long").alias("missing"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def q_numbers(s, d):
    """File names with the number in them (null without one), which sorts them."""
    f = cur(s, d, "job_files", "job_id", "file_index", "filename")
    number = F.nullif(F.regexp_extract("filename", r"(\d+)", 1), F.lit("")).cast("int")
    return f.groupBy("filename").agg(F.count("*").alias("n"), F.first(number).alias("number")).withColumn("number", F.col("number").cast("long"))


def q_selected(s, d):
    """Files picked by number ranges 1-3 and 7-8."""
    f = cur(s, d, "job_files", "job_id", "file_index", "filename").withColumn("number", F.nullif(F.regexp_extract("filename", r"(\d+)", 1), F.lit("")).cast("int"))
    ranges = s.createDataFrame([(1, 3), (8, 7)], "a int, b int").select(F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))).alias("number"))
    return f.join(F.broadcast(ranges), "number", "left_semi").select("job_id", "file_index")


def q_late(s, d):
    """Rows by whole days between creation and arrival of documents."""
    days = F.floor((F.col("ingested_at").cast("long") - F.col("created_at").cast("long")) / 86400).cast("long")
    return table(s, d, "documents").select(days.alias("days")).groupBy("days").agg(F.count("*").alias("n"))


_I, _P1, _R = current("identity_documents"), current("page1_records"), current("residents")
_T = f"list_filter(list_transform(string_split({ws('full_name')}, ' '), lambda t: trim(t, ' ,.;:()[]{{}}\"''')), lambda t: t <> '')"
_B = lambda c: f"count(*) FILTER (WHERE {c})"
_E = lambda c: f"len(list_filter(t, lambda a: {c})) > 0"
QUERIES = {
    "quality_counters": q_quality, "low_confidence_fields": q_low_confidence, "low_confidence_residents": q_low_residents, "missing_fields": q_missing, "document_completeness": q_completeness, "page_inventory": q_pages, "file_numbers": q_numbers, "selected_files": q_selected, "late_arrivals": q_late,
}
ORACLE = {
    "quality_counters": f"""SELECT count(*) AS persons_total, {_B('len(t) NOT IN (2, 3)')} AS bad_token_count, {_B(_E("regexp_matches(a, '[A-Za-z]')"))} AS latin_in_name, {_B(_E("regexp_matches(a, '[0-9]')"))} AS digits_in_name, {_B('len(t) = 2')} AS missing_patronymic,
      {_B("len(t) = 3 AND NOT regexp_matches(t[3], '(?i)(ич|вич|ович|евич|ична|овна|евна|кызы)$')")} AS non_patronymic_third_token, {_B(_E("NOT regexp_matches(a, '^[A-ZА-ЯЁ]')"))} AS bad_caps FROM (SELECT {_T} AS t FROM {_R} WHERE trim(full_name) <> '')""",
    "low_confidence_fields": f"""SELECT * FROM (SELECT page1_id, unnest(['document_date', 'settlement_type', 'administrative_okrug', 'district']) AS field, unnest([document_date, settlement_type, administrative_okrug, district]) AS value,
      unnest([CASE WHEN coalesce(document_date, '') = '' THEN 0.0::DOUBLE WHEN length(document_date) = 10 AND substr(document_date, 3, 1) = '.' AND substr(document_date, 6, 1) = '.' THEN 1.0 ELSE 0.4 END, {', '.join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 0.0::DOUBLE ELSE 0.95 END" for c in ('settlement_type', 'administrative_okrug', 'district'))}]) AS confidence FROM {_P1}) WHERE confidence < 0.75""",
    "low_confidence_residents": f"WITH n AS ({SCALAR['confidence_names']}), c AS ({SCALAR['confidence_documents']}) SELECT r.resident_id, n.confidence AS name_confidence, coalesce(c.confidence, 0.0) AS document_confidence FROM {_R} r JOIN n USING (resident_id) LEFT JOIN c USING (document_id) WHERE n.confidence < 0.75 OR (coalesce(c.confidence, 0.0) NOT IN (0.0, 1.0) AND coalesce(c.confidence, 0.0) < 0.7)",
    "missing_fields": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE coalesce(trim({c}), '') = '') AS n_missing, count(*) AS n FROM {_P1}" for c in ("document_date", "administrative_okrug", "district", "settlement_type", "management_company")),
    "document_completeness": "SELECT document_type, CAST(" + " + ".join(f"CASE WHEN {_HAS(c)} THEN 1 ELSE 0 END" for c in _DOC) + f" AS BIGINT) AS n_fields, count(*) AS n FROM {_I} GROUP BY ALL",
    "page_inventory": f"SELECT job_id, file_index, coalesce(n, 0) AS n_pages, CAST(coalesce(pages, 0) - coalesce(n, 0) AS BIGINT) AS missing, CAST(coalesce(c, 0) AS BIGINT) AS n_chars FROM {current('job_files')} LEFT JOIN (SELECT job_id, file_index, count(*) AS n, sum(length(text)) AS c FROM {current('ocr_pages')} GROUP BY ALL) USING (job_id, file_index)",
    "file_numbers": f"SELECT filename, count(*) AS n, CAST(nullif(regexp_extract(filename, '(\\d+)', 1), '') AS BIGINT) AS number FROM {current('job_files')} GROUP BY filename",
    "selected_files": f"SELECT job_id, file_index FROM {current('job_files')} WHERE CAST(nullif(regexp_extract(filename, '(\\d+)', 1), '') AS INTEGER) IN (1, 2, 3, 7, 8)",
    "late_arrivals": "SELECT CAST(floor((epoch_us(ingested_at) // 1000000 - epoch_us(created_at) // 1000000) / 86400.0) AS BIGINT) AS days, count(*) AS n FROM documents GROUP BY 1",
}
