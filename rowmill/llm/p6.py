"""Queries of problem 6: text of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.scans import clean
from rowmill.operators.nested import METADATA, label_nodes
from rowmill.tables import current


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, record_key, text of every non-null scanned text."""
    one = lambda name, key, column, field: current(spark, sf_dir, name, key, column).select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("record_key"), F.col(column).alias("text"))
    nodes = label_nodes(current(spark, sf_dir, "job_files", "metadata_json"), ["job_id", "file_index"], {"metadata_json": METADATA}).filter("node_type = 'ocr_preview'")
    previews = nodes.select(F.lit("metadata.ocr_preview").alias("field_name"), F.concat_ws("#", "job_id", "file_index", F.regexp_extract("node_path", r"ocr_preview\.(.*)$", 1)).alias("record_key"), F.get_json_object("fields", "$.value").alias("text"))
    pages = one("ocr_pages", "page_id", "text", "ocr_pages.text")
    both = one("identity_documents", "document_id", "raw", "identity_documents.raw").unionByName(one("departures", "departure_id", "raw", "departures.raw"))
    return pages.unionByName(previews).unionByName(both).filter("text IS NOT NULL")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise in every text."""
    return clean(texts(spark, sf_dir)).select("field_name", "record_key", F.explode("noise_kinds").alias("noise_kind"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text repaired into continuous paragraphs."""
    return clean(texts(spark, sf_dir), repaired=True).select("field_name", "record_key", F.concat_ws(",", "noise_kinds").alias("noise_kinds"), "text")


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
