"""Queries of problem 2: typed issuers, districts and okrugs mapped to the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.canonical import match_values
from rowmill.tables import current, table


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, record_id, value of every non-null typed value."""
    issued = current(spark, sf_dir, "identity_documents", "document_id", "issued_by").select(F.lit("issued_by").alias("field_name"), F.col("document_id").alias("record_id"), F.col("issued_by").alias("value"))
    page1 = current(spark, sf_dir, "page1_records", "page1_id", "district", "administrative_okrug")
    both = page1.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col("page1_id").alias("record_id"), F.col(c).alias("value")) for c in ("district", "administrative_okrug")])).alias("x")).select("x.*")
    return issued.unionByName(both).filter(F.col("value").isNotNull())


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value with its entry, or -1, and the cost of the match."""
    return match_values(typed(spark, sf_dir), table(spark, sf_dir, "ref_entries"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every value that isn't verbatim an entry of its field; -1 if none."""
    rows = typed(spark, sf_dir)
    verbatim = table(spark, sf_dir, "ref_entries").select("field_name", F.col("canonical_name").alias("value"))
    open_rows = rows.join(verbatim, ["field_name", "value"], "left_anti")
    matched = p2_values(spark, sf_dir).select("field_name", "value", "ref_id")
    return open_rows.join(matched, ["field_name", "value"]).select("field_name", "record_id", "ref_id")


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry, with the number of records that hold them."""
    return p2_values(spark, sf_dir).filter("ref_id = -1").select("field_name", "value", "n")


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p2_misses": p2_misses}
