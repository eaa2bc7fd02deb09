"""Blocks of text lines: cleaning, slices between markers, records, continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.text import ws


def clean_lines(text: Column | str) -> Column:
    """Lines with squeezed blanks, without empty ones and ones of dashes only."""
    lines = F.transform(F.split(text, "\n"), ws)
    return F.filter(lines, lambda x: ~x.rlike("^[_ -]*$"))


def slice_between(lines: Column, start: str, end: str) -> Column:
    """The lines after the last that matches ``start`` (all if none) and before the first after it that matches ``end``."""
    hits = lambda p: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_max(hits(start)), F.lit(-1))
    last = F.coalesce(F.array_min(F.filter(hits(end), lambda i: i > first)), F.size(lines))
    return F.slice(lines, first + 2, F.greatest(F.lit(0), last - first - 1))


def records(lines: DataFrame, start: str, text: str = "line") -> DataFrame:
    """doc_id, record_no, record_text, n_lines: a line that matches ``start`` opens a record, the
    others continue it; lines before the first record are left out."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    n = F.sum(F.when(F.col(text).rlike(start), 1).otherwise(0)).over(w)
    parts = F.sort_array(F.collect_list(F.struct("line_no", text)))
    numbered = lines.withColumn("record_no", n.cast("int")).filter("record_no > 0")
    return numbered.groupBy("doc_id", "record_no").agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("record_text"), F.count("*").alias("n_lines"))


def join_continuations(rows: DataFrame, keys: list[str], order: str, text: str, is_head: Column) -> DataFrame:
    """Rows that are no head are appended to the last head before them (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    group = F.sum(is_head.cast("int")).over(w)
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.withColumn("_g", group).groupBy(*keys, "_g").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text), F.count("*").alias("n_parts")).drop("_g")


def keep_first(rows: DataFrame, keys: list[str], by: Column, order: str) -> DataFrame:
    """The first row, by ``order``, of each value of ``by`` within ``keys``."""
    w = Window.partitionBy(*keys, "_k").orderBy(order)
    return rows.withColumn("_k", by).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_k", "_r")
