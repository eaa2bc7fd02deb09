"""Queries over whole documents and jobs: the run from pages to records, messages, responses, the unified format."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators import identity as D
from rowmill.operators import pipeline as L
from rowmill.operators import rows as W
from rowmill.operators.jobs import file_counts
from rowmill.operators.nested import node_table
from rowmill.plans.forms import form_pages
from rowmill.plans.p1 import KEYS, nodes
from rowmill.plans.sql import current
from rowmill.plans.table_rows import form_rows
from rowmill.tables import current as cur

BY = ["job_id", "file_index"]


def texts(s, d):
    """The text of each file, its pages in order."""
    p = cur(s, d, "ocr_pages", "page_id", "job_id", "file_index", "page_number", "text").filter("text IS NOT NULL")
    parts = F.sort_array(F.collect_list(F.struct("page_number", "page_id", "text")))
    return p.groupBy(*BY).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def q_parsed(s, d):
    """The whole run over the pages of all files; the leaves of the records come out flat."""
    r = L.parse(form_pages(s, d))
    p = F.col("page_2.registered_persons_constantly")
    return r.select("doc_id", "pages", "page_1.document_date", "page_1.settlement_type", F.size("page_1.owners").cast("long").alias("n_owners"), "page_1.property_address.full", F.col("page_1.management_company.name").alias("company"), p["count"].cast("long").alias("n_persons"), F.array_join(F.transform(p["persons"], lambda x: x["full_name"]), "|").alias("names"), "page_2.benefits", F.size("warnings").cast("long").alias("n_warnings"), F.size("metadata.ocr_preview").cast("long").alias("n_previews"))


def q_benefits(s, d):
    return texts(s, d).select(*BY, L.benefits(F.col("text")).alias("benefits"))


def q_table_pages(s, d):
    p = cur(s, d, "ocr_pages", "page_id", "text").filter("text IS NOT NULL")
    return p.select("page_id", L.continues_table(F.col("text")).alias("continues"))


def q_between(s, d):
    return texts(s, d).select(*BY, F.length(L.between(F.col("text"), *L.TEMPORARY)).cast("long").alias("n_chars"))


def q_temporary(s, d):
    return texts(s, d).select(*BY, F.posexplode(L.temporary_people(F.col("text"))).alias("place", "p")).select(*BY, F.col("place").cast("long").alias("place"), "p.full_name", "p.birthday_date")


def q_chunks(s, d):
    """People in the running text of whole files."""
    return texts(s, d).select(*BY, F.explode(L.chunk_people(F.col("text"))).alias("p")).select(*BY, "p.full_name", "p.birthday_date")


def q_headers(s, d):
    p = cur(s, d, "ocr_pages", "page_id", "job_id", "file_index")
    return p.groupBy(*BY).agg(F.count("*").alias("ocr_pages")).withColumn("document_type", F.lit("housing_form"))


def q_callbacks(s, d):
    jobs = cur(s, d, "jobs", "job_id", "status", "callback_url", "error")
    return L.callbacks(jobs, cur(s, d, "job_files", "job_id", "file_index", "filename", "status", "extracted_data_json", "error"))


def q_job_responses(s, d):
    """Every job as its status is answered: its row with the counts of its files."""
    j = cur(s, d, "jobs", "job_id", "status", "created_at", "started_at", "finished_at", "error")
    n = file_counts(cur(s, d, "job_files", "job_id", "file_index", "status", "pages")).drop("pages")
    text = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("created_at", "started_at", "finished_at")}
    return j.withColumns(text).join(n, "job_id", "left").fillna(0, ["total_files", "completed_files", "failed_files"])


def q_uploaded(s, d):
    """The stored files of every job, in their order, with the place each is stored at."""
    f = cur(s, d, "job_files", "job_id", "file_index", "filename")
    saved = F.format_string("%03d_%s", "file_index", T.file_name("filename"))
    return f.select("job_id", F.col("file_index").cast("long").alias("file_index"), T.file_name("filename").alias("filename"), F.concat_ws("/", "job_id", saved).alias("path"))


def q_inspected(s, d):
    return L.inspect(cur(s, d, "job_files", "job_id", "file_index", "filename")).groupBy("page_count").agg(F.count("*").alias("n"))


def q_unified(s, d):
    """Persons of the parsed records in the unified format: roles, name parts, document and departure (null if empty)."""
    n = nodes(s, d)
    person = node_table(n, KEYS, "person", {"full_name": "$.full_name", "birthday_date": "$.birthday_date"}, "page_2")
    doc = node_table(n, KEYS, "passport", {f: f"$.{f}" for f in D.FIELDS}, "person").select(*KEYS, F.col("parent_pre").alias("pre"), F.struct(*D.FIELDS).alias("d"))
    gone = node_table(n, KEYS, "departure", {f: f"$.{f}" for f in ("status", "reason", "death_date", "departure_date")}, "person").select(*KEYS, F.col("parent_pre").alias("pre"), F.struct("status", "reason", "death_date", "departure_date").alias("g"))
    role = F.when(F.col("node_path").contains("constantly"), "registered_permanent").otherwise("registered_temporary")
    x = person.join(doc, [*KEYS, "pre"], "left").join(gone, [*KEYS, "pre"], "left").withColumn("n", T.name_parts("full_name"))
    return x.select(*KEYS, "place", role.alias("role"), "full_name", "n.last_name", "n.first_name", "n.middle_name", "birthday_date", L.identity_or_none(F.col("d"))["number"].alias("number"), L.departure_or_none(F.col("g"))["reason"].alias("reason"))


def q_left_names(s, d):
    """Names by the words left of each row's birthday."""
    w = F.col("words")
    b = W.primary_date(w, F.col("anchor_top"), 0, 100000)
    return form_rows(s, d).withColumn("b", b).select("doc_id", "page_number", F.col("anchor_top").cast("long").alias("anchor_top"), F.array_join(F.slice(L.left_name_tokens(w, F.col("b")), 1, 3), " ").alias("full_name"))


_T = f"(SELECT job_id, file_index, string_agg(text, chr(10) ORDER BY page_number, page_id) AS text FROM {current('ocr_pages')} WHERE text IS NOT NULL GROUP BY ALL)"
_LOW = "replace(lower(text), 'ё', 'е')"
_TEMP = L.TEMPORARY[0]
_F = current("job_files")
QUERIES = {
    "parsed_documents": q_parsed, "benefits": q_benefits, "table_pages": q_table_pages, "between_marks": q_between, "temporary_people": q_temporary, "chunk_people": q_chunks, "page1_headers": q_headers, "callback_messages": q_callbacks, "job_responses": q_job_responses, "uploaded_files": q_uploaded,
    "inspected_files": q_inspected, "unified_persons": q_unified, "left_names": q_left_names,
}
ORACLE = {
    "benefits": f"SELECT job_id, file_index, CASE WHEN w <> '' THEN w WHEN contains(l, '{L.SUPPORT}') AND contains(l, 'кроме того') OR contains(l, '{_TEMP.lower()}') THEN 'нет' END AS benefits FROM (SELECT job_id, file_index, {_LOW} AS l, lower(regexp_extract(text, '(?i)Субсидия\\s*:?\\s*(нет|имеется|есть)', 1)) AS w FROM {_T})",
    "table_pages": f"SELECT page_id, contains({_LOW}, 'фамилия') AND regexp_matches({_LOW}, 'паспорт|дата ро|отчество') AS continues FROM {current('ocr_pages')} WHERE text IS NOT NULL",
    "between_marks": f"SELECT job_id, file_index, CASE WHEN p = 0 THEN 0 ELSE length(trim(CASE WHEN strpos(lower(r), '{L.TEMPORARY[1].lower()}') > 0 THEN substr(r, 1, strpos(lower(r), '{L.TEMPORARY[1].lower()}') - 1) ELSE r END)) END AS n_chars FROM (SELECT job_id, file_index, strpos(lower(text), '{_TEMP.lower()}') AS p, substr(text, strpos(lower(text), '{_TEMP.lower()}') + {len(_TEMP)}) AS r FROM {_T})",
    "page1_headers": f"SELECT job_id, file_index, count(*) AS ocr_pages, 'housing_form' AS document_type FROM {current('ocr_pages')} GROUP BY ALL",
    "callback_messages": f"WITH o AS (SELECT job_id, arg_min(filename, file_index) FILTER (WHERE status = 'completed' AND coalesce(extracted_data_json, '') <> '') AS g, arg_min(error, file_index) FILTER (WHERE coalesce(error, '') <> '') AS b, count(*) FILTER (WHERE status = 'completed' AND coalesce(extracted_data_json, '') <> '') AS n FROM {_F} GROUP BY job_id), x AS (SELECT j.job_id, callback_url, status IN ('completed', 'completed_with_errors') AND coalesce(n, 0) > 0 AS ok, g, b, error FROM {current('jobs')} j LEFT JOIN o USING (job_id) WHERE coalesce(callback_url, '') <> '' AND status IN ('completed', 'completed_with_errors', 'failed')) SELECT job_id, callback_url, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, CASE WHEN ok THEN g END AS filename, CASE WHEN NOT ok THEN coalesce(nullif(error, ''), b, 'No data extracted') END AS error FROM x",
    "job_responses": f"SELECT job_id, j.status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%dT%H:%M:%S') AS finished_at, error, coalesce(total_files_, 0) AS total_files, coalesce(c, 0) AS completed_files, coalesce(f, 0) AS failed_files FROM {current('jobs')} j LEFT JOIN (SELECT job_id, count(*) AS total_files_, count(*) FILTER (WHERE status = 'completed') AS c, count(*) FILTER (WHERE status = 'failed') AS f FROM {_F} GROUP BY job_id) USING (job_id)",
    "uploaded_files": f"SELECT job_id, CAST(file_index AS BIGINT) AS file_index, n AS filename, job_id || '/' || printf('%03d_%s', file_index, n) AS path FROM (SELECT *, coalesce(nullif(trim(regexp_replace(coalesce(filename, ''), '[^0-9A-Za-zА-Яа-яЁё._ -]+', '_', 'g')), ''), 'document.pdf') AS n FROM {_F})",
    "inspected_files": f"SELECT 0 AS page_count, count(*) AS n FROM {_F}",
}
