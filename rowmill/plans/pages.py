"""Queries over words on pages (the words of the corpus laid out as boxes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import layout as L
from rowmill.plans.sql import DATE, WORDS
from rowmill.plans.sql import current as once
from rowmill.tables import current, table

COLUMNS = [("name", 0, 560), ("birth", 560, 930), ("document", 1180, 2050), ("departure", 2050, 100000)]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.words_of_texts(table(spark, sf_dir, "documents"))


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def q_words(s, d):
    return long(words(s, d), "left", "top", "width").groupBy("doc_id", "page_number").agg(F.count("*").alias("n_words"), F.sum("left").alias("sum_left"), F.sum("top").alias("sum_top"), F.sum("width").alias("sum_width"))


def q_reading_order_text(s, d):
    return L.page_text(words(s, d))


def q_greedy_lines(s, d):
    return long(L.greedy_lines(words(s, d), 90), "line_top", "n_words")


def q_gap_clusters(s, d):
    found = L.gap_clusters(words(s, d), 12)
    return long(L.bounding_boxes(found, "doc_id", "page_number", "top", "cluster"), "top", "cluster", "box_left", "box_right").select("doc_id", "page_number", "top", "cluster", "box_left", "box_right", "n_words")


def q_leftmost_part(s, d):
    return long(L.leftmost_part(words(s, d)).groupBy("doc_id", "page_number", "top").agg(F.count("*").alias("n_words"), F.max("left").alias("last_left")), "top", "last_left")


def q_anchors(s, d):
    return long(L.anchors(words(s, d), DATE), "anchor_top")


def banded(s, d):
    w = words(s, d)
    return L.row_bands(w, L.anchors(w, DATE))


def q_row_bands(s, d):
    return long(banded(s, d).groupBy("doc_id", "page_number", "anchor_top").agg(F.count("*").alias("n_words"), F.min("top").alias("first_top"), F.max("top").alias("last_top")), "anchor_top", "first_top", "last_top")


def q_assign_columns(s, d):
    return L.assign_columns(words(s, d), COLUMNS).filter("column_name IS NOT NULL").groupBy("doc_id", "page_number", "column_name").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


def q_cells(s, d):
    return long(L.cells(L.assign_columns(banded(s, d), COLUMNS)), "anchor_top")


def q_adaptive_column(s, d):
    return L.adaptive_column(words(s, d), DATE)


def q_mean_first(s, d):
    return L.mean_of_first(words(s, d), DATE)


def q_page_boxes(s, d):
    return long(L.bounding_boxes(words(s, d), "doc_id", "page_number"), "box_left", "box_top", "box_right", "box_bottom").drop("n_words")


def q_nearest_word(s, d):
    return long(L.nearest_word(words(s, d), DATE, 400), "word_top", "word_left")


def q_crop_bounds(s, d):
    boxes = L.bounding_boxes(words(s, d).filter(F.col("text").rlike(DATE)), "doc_id", "page_number")
    return long(L.crop_bounds(boxes, 80, 24, 50, 2480, 3508), "crop_left", "crop_top", "crop_right", "crop_bottom").select("doc_id", "page_number", "crop_left", "crop_top", "crop_right", "crop_bottom")


def q_cluster_choice(s, d):
    found = L.gap_clusters(words(s, d), 12)
    scored = found.groupBy("doc_id", "page_number", "top", "cluster").agg(F.min("left").alias("box_left"), F.count_if(F.col("text").rlike("[0-9]")).alias("digits"), F.count("*").alias("n"))
    return long(L.cluster_choice(scored, F.least(F.lit(3), F.col("digits")) + F.when(F.col("n") >= 2, 1).otherwise(0)), "top", "cluster", "best_score")


# What the pages of a form say about its layout.
SIGNALS = {"temporary_registration_block": "кроме того, на данной площади зарегистрированы по месту пребывания", "benefits_block": "наличие мер социальной поддержки|субсидия"}


def q_layout_variant(s, d):
    p = current(s, d, "ocr_pages", "page_id", "job_id", "file_index", "page_number", "text")
    return L.layout_variant(p, ["job_id", "file_index"], SIGNALS)


_BAND = f"""anchor AS (SELECT doc_id, page_number, tp AS anchor_top FROM words WHERE regexp_matches(text, '{DATE}') GROUP BY ALL),
 banded AS (SELECT w.*, a.anchor_top FROM words w ASOF JOIN anchor a ON w.doc_id = a.doc_id AND w.page_number = a.page_number AND w.tp >= a.anchor_top - 18)"""
_COLUMN = "CASE " + " ".join(f"WHEN lft + wd / 2.0 >= {a} AND lft + wd / 2.0 < {b} THEN '{n}'" for n, a, b in COLUMNS) + " END"
_GAPS = "gaps AS (SELECT *, CASE WHEN lft - max(lft + wd) OVER (PARTITION BY doc_id, page_number, tp ORDER BY lft, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 12 THEN 1 ELSE 0 END AS o FROM words), clustered AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id, page_number, tp ORDER BY lft, ord) AS BIGINT) AS cluster FROM gaps)"
_FIRST = f"hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, tp, lft, ord) AS r FROM words WHERE regexp_matches(text, '{DATE}'))"
QUERIES = {
    "words": q_words, "reading_order_text": q_reading_order_text, "greedy_lines": q_greedy_lines, "gap_clusters": q_gap_clusters, "leftmost_part": q_leftmost_part, "date_anchors": q_anchors, "row_bands": q_row_bands, "assign_columns": q_assign_columns,
    "table_cells": q_cells, "adaptive_column": q_adaptive_column, "mean_of_first": q_mean_first, "page_boxes": q_page_boxes, "nearest_word": q_nearest_word, "crop_bounds": q_crop_bounds, "cluster_choice": q_cluster_choice, "layout_variant": q_layout_variant,
}
# Tops are multiples of 40 and every line of a page has one, so groups of at most 90 pixels begin at every third used top.
ORACLE = {
    "words": f"WITH {WORDS} SELECT doc_id, page_number, count(*) AS n_words, CAST(sum(lft) AS BIGINT) AS sum_left, CAST(sum(tp) AS BIGINT) AS sum_top, CAST(sum(wd) AS BIGINT) AS sum_width FROM words GROUP BY ALL",
    "reading_order_text": f"WITH {WORDS} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY tp, lft, ord) AS page_text FROM words GROUP BY ALL",
    "greedy_lines": f"""WITH RECURSIVE {WORDS}, tops AS (SELECT DISTINCT doc_id, page_number, tp FROM words),
      starts AS (SELECT doc_id, page_number, min(tp) AS st FROM tops GROUP BY ALL UNION ALL
        SELECT s.doc_id, s.page_number, (SELECT min(t.tp) FROM tops t WHERE t.doc_id = s.doc_id AND t.page_number = s.page_number AND t.tp > s.st + 90) FROM starts s
        WHERE EXISTS (SELECT 1 FROM tops t WHERE t.doc_id = s.doc_id AND t.page_number = s.page_number AND t.tp > s.st + 90))
      SELECT w.doc_id, w.page_number, s.st AS line_top, string_agg(w.text, ' ' ORDER BY w.lft, w.tp, w.ord) AS line_text, count(*) AS n_words
      FROM words w JOIN starts s ON w.doc_id = s.doc_id AND w.page_number = s.page_number AND w.tp BETWEEN s.st AND s.st + 90 GROUP BY ALL""",
    "gap_clusters": f"WITH {WORDS}, {_GAPS} SELECT doc_id, page_number, tp AS top, cluster, min(lft) AS box_left, max(lft + wd) AS box_right, count(*) AS n_words FROM clustered GROUP BY ALL",
    "leftmost_part": f"WITH {WORDS}, j AS (SELECT *, CASE WHEN lft - lag(lft) OVER (PARTITION BY doc_id, page_number, tp ORDER BY lft, ord) >= 160 THEN 1 ELSE 0 END AS o FROM words), k AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, page_number, tp ORDER BY lft, ord) AS g FROM j) SELECT doc_id, page_number, tp AS top, count(*) AS n_words, max(lft) AS last_left FROM k WHERE g = 0 GROUP BY ALL",
    "date_anchors": f"WITH {WORDS} SELECT DISTINCT doc_id, page_number, tp AS anchor_top FROM words WHERE regexp_matches(text, '{DATE}')",
    "row_bands": f"WITH {WORDS}, {_BAND} SELECT doc_id, page_number, anchor_top, count(*) AS n_words, min(tp) AS first_top, max(tp) AS last_top FROM banded GROUP BY ALL",
    "assign_columns": f"WITH {WORDS} SELECT doc_id, page_number, {_COLUMN} AS column_name, count(*) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM words WHERE {_COLUMN} IS NOT NULL GROUP BY ALL",
    "table_cells": f"WITH {WORDS}, {_BAND} SELECT doc_id, page_number, anchor_top, {_COLUMN} AS column_name, string_agg(text, ' ' ORDER BY tp, lft, ord) AS cell_text FROM banded WHERE {_COLUMN} IS NOT NULL GROUP BY ALL",
    "adaptive_column": f"WITH {WORDS}, {_FIRST} SELECT doc_id, greatest(420.0::DOUBLE, least(760.0::DOUBLE, median(lft)::DOUBLE - 35)) AS edge FROM hits WHERE r <= 6 GROUP BY doc_id",
    "mean_of_first": f"WITH {WORDS}, {_FIRST} SELECT doc_id, round(avg(lft), 4) AS mean_left FROM hits WHERE r <= 12 GROUP BY doc_id",
    "page_boxes": f"WITH {WORDS} SELECT doc_id, page_number, min(lft) AS box_left, min(tp) AS box_top, max(lft + wd) AS box_right, max(tp + 24) AS box_bottom FROM words GROUP BY ALL",
    "nearest_word": f"WITH {WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY abs(tp - 400), lft, tp, ord) AS k FROM words WHERE regexp_matches(text, '{DATE}')) SELECT doc_id, page_number, text AS word, tp AS word_top, lft AS word_left FROM r WHERE k = 1",
    "crop_bounds": f"""WITH {WORDS}, b AS (SELECT doc_id, page_number, min(lft) AS l, min(tp) AS t, max(lft + wd) AS r, max(tp + 24) AS m FROM words WHERE regexp_matches(text, '{DATE}') GROUP BY ALL),
      c AS (SELECT *, greatest(0, least(2479, l - 80)) AS crop_left, greatest(0, least(3507, t - 24)) AS crop_top FROM b)
      SELECT doc_id, page_number, crop_left, crop_top, greatest(crop_left + 1, least(2480, r + 80)) AS crop_right, greatest(crop_top + 1, least(3508, m + 50)) AS crop_bottom FROM c""",
    "cluster_choice": f"""WITH {WORDS}, {_GAPS}, c AS (SELECT doc_id, page_number, tp, cluster, min(lft) AS bl, least(3, count(*) FILTER (WHERE regexp_matches(text, '[0-9]'))) + CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS sc FROM clustered GROUP BY ALL),
      b AS (SELECT *, max(sc) OVER (PARTITION BY doc_id, page_number, tp) AS best FROM c), a AS (SELECT *, min(CASE WHEN sc = best THEN bl END) OVER (PARTITION BY doc_id, page_number, tp) AS near_ FROM b)
      SELECT doc_id, page_number, tp AS top, arg_min(cluster, bl) AS cluster, CAST(max(best) AS BIGINT) AS best_score FROM a WHERE sc >= greatest(2, best - 1) AND bl <= near_ + 120 GROUP BY ALL""",
    "layout_variant": "WITH f AS (SELECT job_id, file_index, list_filter([" + ", ".join(f"CASE WHEN bool_or(regexp_matches(replace(lower(coalesce(text, '')), 'ё', 'е'), '{p}')) THEN '{n}' END" for n, p in SIGNALS.items()) + f", CASE WHEN max(page_number) >= 3 THEN 'continuation_page' END], lambda x: x IS NOT NULL) AS s FROM {once('ocr_pages')} GROUP BY ALL) SELECT job_id, file_index, array_to_string(s, ',') AS variant_signals, round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.2::DOUBLE * len(s)), 4) AS confidence FROM f",
}
