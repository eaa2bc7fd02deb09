"""Queries over the rows of the residents' table: words of the corpus and of the forms' pages, in bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import identity as D
from rowmill.operators import layout as L
from rowmill.operators import rows as W
from rowmill.plans.forms import form_pages
from rowmill.plans.pages import words
from rowmill.plans.sql import DATE, WORDS
from rowmill.sources.ports import recognize

PAGE = ["doc_id", "page_number"]
ROW = [*PAGE, "anchor_top"]


def banded(s, d):
    """The words of the corpus, in the bands of the dates on their pages."""
    w = words(s, d)
    return L.row_bands(w, L.anchors(w, DATE))


def form_rows(s, d):
    """The words of the forms' pages after the first, in the bands of their birthdays, one row an array."""
    w = recognize(form_pages(s, d), "mock").filter("page_number > 1")
    return W.row_words(L.row_bands(w, L.anchors(w, DATE)), ROW)


def q_row_bounds(s, d):
    return W.row_words(banded(s, d), ROW).select(*ROW, W.row_bounds(F.col("words"), F.col("anchor_top")).alias("b")).select(*PAGE, F.col("anchor_top").cast("long").alias("anchor_top"), "b.*")


def q_adaptive_columns(s, d):
    return W.adaptive_columns(W.row_words(banded(s, d), ROW), ["doc_id"])


def q_row_boxes(s, d):
    x = W.row_words(banded(s, d), ROW).select(*ROW, W.box(F.col("words")).alias("x"))
    return x.select(*PAGE, *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("anchor_top", "x.left", "x.top", "x.width", "x.height")])


def q_row_texts(s, d):
    return W.row_words(banded(s, d), ROW).select(*PAGE, F.col("anchor_top").cast("long").alias("anchor_top"), W.raw_text(F.col("words")).alias("row_text"))


def q_row_cells(s, d):
    """What the cells of a row hold, by the bounds of that row."""
    w, b = F.col("words"), F.col("b")
    x = W.row_words(banded(s, d), ROW).withColumn("b", W.row_bounds(w, F.col("anchor_top")))
    return x.select(*ROW, W.raw_text(W.name_words(w, b)).alias("name"), W.raw_text(W.birth_words(w, b)).alias("birth"), W.raw_text(W.document_words(w, b)).alias("document"), W.raw_text(W.document_cluster(w, b)).alias("document_cluster"), W.raw_text(W.departure_cluster(w, b)).alias("departure_cluster"), W.begins_departure(w).alias("departs"))


def q_row_clusters(s, d):
    """Clusters of each row, the one that is its document, and the leftmost."""
    w = F.col("words")
    return W.row_words(banded(s, d), ROW).select(*ROW, F.size(W.clusters(w)).cast("long").alias("n_clusters"), F.size(W.primary_cluster(w)).cast("long").alias("n_primary"), F.size(W.leftmost_cluster(w)).cast("long").alias("n_leftmost"), F.size(W.rightmost(w)).cast("long").alias("n_rightmost"))


def q_anchor_points(s, d):
    return words(s, d).select(W.anchor_points(F.col("text")).cast("long").alias("document"), W.departure_points(F.col("text")).cast("long").alias("departure")).groupBy("document", "departure").agg(F.count("*").alias("n"))


def q_table_ends(s, d):
    return W.table_end(words(s, d), PAGE).withColumn("end_top", F.col("end_top").cast("long"))


def q_header_bottoms(s, d):
    return W.header_bottom(words(s, d), PAGE, 430).withColumn("bottom", F.col("bottom").cast("long"))


def q_deep_words(s, d):
    """Words within 180 pixels under a row's end, right of the usual departure column's edge."""
    x = W.row_words(banded(s, d), ROW)
    page = W.row_words(words(s, d), PAGE).withColumnRenamed("words", "page_words")
    own = F.array_max(F.transform("words", lambda w: w["top"])) + 24
    deep = W.deep_words(F.col("page_words"), F.col("anchor_top") - 18, own, F.lit(None).cast("int"), F.lit(None), 180, 90, F.lit(400))
    return x.join(page, PAGE).select(*ROW, F.size(deep).cast("long").alias("n_words"))


def q_read_rows(s, d):
    """Name, birthday, document and departure of every row of the forms' tables."""
    r = W.read_rows(form_rows(s, d))
    return r.select(*ROW, "full_name", "birthday_date", "document.document_type", "document.series", "document.number", "departure.reason", W.strong(F.col("document")).alias("strong"), W.read_again(F.col("document")).alias("again"), W.quality(F.col("document")).alias("quality"))


def q_row_names(s, d):
    return W.row_words(banded(s, d), ROW).select(*ROW, W.full_name(F.col("words")).alias("full_name"), F.size(W.name_cluster(F.col("words"))).cast("long").alias("n_words"))


def q_row_crops(s, d):
    x = W.row_words(banded(s, d), ROW).withColumn("box", W.box(F.col("words")))
    modes = [F.struct(F.lit(m).alias("mode"), W.crop(m, F.col("box"), F.col("box"), 2480, 3508).alias("c")) for m in W.CROPS]
    return x.select(*PAGE, F.col("anchor_top").cast("long").alias("anchor_top"), F.explode(F.array(*modes)).alias("m")).select(*PAGE, "anchor_top", "m.mode", *[F.col(f"m.c.{c}").cast("long").alias(f"crop_{c}") for c in ("left", "top", "right", "bottom")])


def q_tails(s, d):
    x = W.row_words(banded(s, d), ROW)
    return x.select(W.tail_of_page_before(W.full_name(F.col("words")), F.col("words")).alias("is_tail")).groupBy("is_tail").agg(F.count("*").alias("n"))


def q_heads(s, d):
    x = W.row_words(banded(s, d), ROW)
    return x.select(W.has_head(F.col("words")).alias("has_head"), W.cluster_points(W.raw_text(F.col("words"))).cast("long").alias("points")).groupBy("has_head", "points").agg(F.count("*").alias("n"))


_BAND = f"""anchor AS (SELECT doc_id, page_number, tp AS anchor_top FROM words WHERE regexp_matches(text, '{DATE}') GROUP BY ALL),
 banded AS (SELECT w.*, a.anchor_top FROM words w ASOF JOIN anchor a ON w.doc_id = a.doc_id AND w.page_number = a.page_number AND w.tp >= a.anchor_top - 18)"""
_BOX = f"WITH {WORDS}, {_BAND}, b AS (SELECT doc_id, page_number, anchor_top, min(lft) AS l, min(tp) AS t, max(lft + wd) - min(lft) AS w, max(tp + 24) - min(tp) AS h FROM banded GROUP BY ALL)"
_TEXT = f"WITH {WORDS}, {_BAND}, r AS (SELECT doc_id, page_number, anchor_top, trim(regexp_replace(string_agg(text, ' ' ORDER BY tp, lft, ord), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')) AS row_text FROM banded GROUP BY ALL)"
_HAS = lambda p, n: f"CASE WHEN regexp_matches(row_text, '(?i){p}') THEN {n} ELSE 0 END"
_POINTS = " + ".join([_HAS("паспорт", 4), _HAS("свидетель", 4), _HAS("справка", 4), _HAS("выдан", 2), "CASE WHEN regexp_matches(row_text, '№\\s*\\d{6,10}') THEN 3 WHEN regexp_matches(row_text, '\\d{6}') THEN 2 ELSE 0 END", _HAS("\\d{2}\\.\\d{2}\\.\\d{4}", 1), _HAS("мвд|уфмс|овд|загс", 1)])
_CROP = "SELECT doc_id, page_number, anchor_top, '{m}' AS mode, greatest(0, l{skip} - {x}) AS crop_left, greatest(0, t - {a}) AS crop_top, least(2480, l + w + {x}) AS crop_right, least(3508, t + h + {b}) AS crop_bottom FROM b"
QUERIES = {
    "row_bounds": q_row_bounds, "adaptive_columns": q_adaptive_columns, "row_boxes": q_row_boxes, "row_texts": q_row_texts, "row_cells": q_row_cells, "row_clusters": q_row_clusters, "anchor_points": q_anchor_points, "table_ends": q_table_ends, "header_bottoms": q_header_bottoms,
    "deep_words": q_deep_words, "read_rows": q_read_rows, "row_names": q_row_names, "row_crops": q_row_crops, "row_tails": q_tails, "row_heads": q_heads,
}
ORACLE = {
    "row_boxes": f"{_BOX} SELECT doc_id, page_number, anchor_top, l AS \"left\", t AS top, w AS width, h AS height FROM b",
    "row_texts": f"{_TEXT} SELECT * FROM r",
    "row_heads": f"{_TEXT} SELECT regexp_matches(row_text, '(?i)паспорт|свидетель|справка|№\\s*\\d{{6}}') AS has_head, CAST({_POINTS} AS BIGINT) AS points, count(*) AS n FROM r GROUP BY ALL",
    "anchor_points": f"WITH {WORDS} SELECT CAST(CASE WHEN regexp_matches(text, '(?i)паспорт|свидетель|справка') THEN 5 WHEN regexp_matches(text, '№\\s*\\d{{6,8}}') THEN 4 WHEN regexp_matches(text, '\\d{{6}}') THEN 3 WHEN regexp_matches(text, '(?i)выдан') THEN 2 WHEN regexp_matches(text, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN 1 ELSE 0 END AS BIGINT) AS document, CAST(CASE WHEN regexp_matches(low, 'смерт|умер|форм[ыа] 6|отрывному талону') THEN 6 WHEN contains(low, 'а/з') OR low = 'аз' OR regexp_matches(text, '(^|[^0-9])[0-9]{{21}}($|[^0-9])') THEN 5 WHEN regexp_matches(low, 'оф\\.|загс') THEN 4 ELSE 0 END AS BIGINT) AS departure, count(*) AS n FROM (SELECT *, replace(lower(text), 'ё', 'е') AS low FROM words) GROUP BY ALL",
    "table_ends": f"WITH {WORDS} SELECT doc_id, page_number, min(tp) AS end_top FROM words WHERE " + " OR ".join(f"contains(text, '{e}')" for e in W.ENDS) + " GROUP BY ALL",
    "header_bottoms": f"WITH {WORDS} SELECT doc_id, page_number, coalesce(max(CASE WHEN tp < 430 AND regexp_matches(text, '(?i){W.HEADER[5:]}') THEN tp END) + 24, 430) AS bottom FROM words GROUP BY ALL",
    "row_crops": f"{_BOX} " + " UNION ALL ".join(_CROP.format(m=m, x=x, a=a, b=b, skip=" + CAST(floor(w * 0.45) AS BIGINT)" if m.startswith("row") else "") for m, (x, a, b) in W.CROPS.items()),
}
