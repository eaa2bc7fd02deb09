"""Queries over whole forms: page 1, residents' tables, the second reading, the end-to-end run."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import layout as L
from rowmill.operators.page1 import read_page1
from rowmill.plans.sql import clean_lines, current
from rowmill.sources.ports import recognize, render, second_pass
from rowmill.tables import current as cur
from rowmill.tables import table

BIRTH = "^\\d{2}\\.\\d{2}\\.\\d{4}$"


def q_page1(s, d):
    return read_page1(cur(s, d, "ocr_pages", "page_id", "page_number", "text").filter("page_number = 1"), "page_id", "text")


def form_pages(s, d):
    p = cur(s, d, "ocr_pages", "page_id", "job_id", "file_index", "page_number", "text").filter("text IS NOT NULL")
    return p.select(F.xxhash64("job_id", "file_index").alias("doc_id"), "page_number", "page_id", F.lit(2480).alias("width"), F.lit(3508).alias("height"), F.lit(None).cast("string").alias("image_path"), F.encode("text", "UTF-8").alias("image"))


def q_recognize(s, d):
    w = recognize(form_pages(s, d), "mock")
    return w.groupBy("page_number").agg(F.count("*").alias("n_words"), F.sum("left").alias("sum_left"), F.sum("width").alias("sum_width"), F.countDistinct("doc_id").alias("n_docs"))


def q_residents(s, d):
    """Rows of the residents' tables: the birthday of each line anchors it, the words left of it are the name."""
    w = recognize(form_pages(s, d), "mock").filter("page_number > 1")
    rows = L.row_bands(w, L.anchors(w, BIRTH, 12))
    line = rows.filter("top = anchor_top").groupBy("doc_id", "page_number", "anchor_top").agg(
        F.min(F.when(F.col("text").rlike(BIRTH), F.struct("left", "text"))).alias("b"), F.sort_array(F.collect_list(F.struct("left", "ord", "text"))).alias("ws")
    )
    name = F.array_join(F.transform(F.filter("ws", lambda x: x["left"] < F.col("b.left")), lambda x: x["text"]), " ")
    return line.select("doc_id", "page_number", name.alias("full_name"), F.col("b.text").alias("birthday_date")).filter("full_name RLIKE '^[^ ]+ [^ ]+'")


NOISY = "[А-Яа-яЁё][0-9A-Za-z][А-Яа-яЁё]"


def q_second_pass(s, d):
    """Pages whose text has a foreign sign inside a word are read again; the second reading stays if it has more words."""
    pages = form_pages(s, d)
    rows = pages.select("doc_id", "page_number", "page_id", F.decode("image", "UTF-8").alias("text"))
    done = second_pass(rows, pages, "mock", F.col("text").rlike(NOISY), "page_id", "text")
    return done.groupBy("page_number", "replaced").agg(F.count("*").alias("n"))


def q_render(s, d):
    docs = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    w = recognize(render(docs, "one_page"), "mock")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


def q_published(s, d):
    """Page 1, residents and job of each file as one record; the leaves come out flat."""
    p = cur(s, d, "ocr_pages", "page_id", "job_id", "file_index", "page_number", "text").filter("page_number = 1").withColumn("doc_id", F.xxhash64("job_id", "file_index"))
    one = read_page1(p, "doc_id", "text").select("doc_id", "document_date", "company", "n_owners")
    two = q_residents(s, d).groupBy("doc_id").agg(F.count("*").alias("n_residents"))
    job = cur(s, d, "job_files", "job_id", "file_index", "status", "pages").withColumn("doc_id", F.xxhash64("job_id", "file_index"))
    record = F.struct("job_id", "file_index", "status", F.struct("document_date", "company", "n_owners").alias("page_1"), F.struct(F.coalesce("n_residents", F.lit(0)).alias("count")).alias("page_2"))
    out = job.join(one, "doc_id", "left").join(two, "doc_id", "left").select(record.alias("r"))
    return out.select("r.job_id", "r.file_index", "r.status", "r.page_1.document_date", "r.page_1.company", F.coalesce("r.page_1.n_owners", F.lit(0)).alias("n_owners"), F.col("r.page_2.count").alias("n_residents"))


_P = f"(SELECT * FROM {current('ocr_pages')} WHERE text IS NOT NULL)"
_TOK = f"t AS (SELECT page_id, job_id, file_index, page_number, li, unnest(range(len(a))) AS wi, unnest(a) AS tok FROM (SELECT page_id, job_id, file_index, page_number, li, string_split(l, ' ') AS a FROM (SELECT *, unnest(range(len(b))) AS li, unnest(b) AS l FROM (SELECT page_id, job_id, file_index, page_number, string_split(text, chr(10)) AS b FROM {_P})))), w AS (SELECT *, 12 * (sum(length(tok) + 1) OVER (PARTITION BY page_id, li ORDER BY wi) - length(tok) - 1) AS lft FROM t)"
QUERIES = {"page1_fields": q_page1, "recognized_words": q_recognize, "resident_rows": q_residents, "second_pass": q_second_pass, "rendered_words": q_render, "published_records": q_published}
ORACLE = {
    "recognized_words": f"WITH {_TOK} SELECT page_number, count(*) AS n_words, CAST(sum(lft) AS BIGINT) AS sum_left, CAST(sum(12 * length(trim(tok))) AS BIGINT) AS sum_width, count(DISTINCT job_id || '#' || file_index) AS n_docs FROM w WHERE trim(tok) <> '' GROUP BY page_number",
    "rendered_words": "SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY doc_id",
    "second_pass": f"SELECT page_number, regexp_matches(text, '{NOISY}') AND len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) > len(string_split(text, ' ')) AS replaced, count(*) AS n FROM {_P} GROUP BY ALL",
}
