"""Queries of problem 4: names, series and house numbers in one consistent form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.lookalikes import canonical_forms
from rowmill.tables import current


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    names = current(spark, sf_dir, "residents", "resident_id", "full_name").select(F.lit("full_name").alias("field_name"), F.col("resident_id").alias("record_id"), none.alias("kind"), F.col("full_name").alias("value"))
    series = current(spark, sf_dir, "identity_documents", "document_id", "document_type", "series").select(F.lit("series").alias("field_name"), F.col("document_id").alias("record_id"), F.col("document_type").alias("kind"), F.col("series").alias("value"))
    houses = current(spark, sf_dir, "property_addresses", "address_record_id", "house").select(F.lit("house").alias("field_name"), F.col("address_record_id").alias("record_id"), none.alias("kind"), F.col("house").alias("value"))
    return names.unionByName(series).unionByName(houses)


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null value with its consistent form."""
    return canonical_forms(values(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_forms(spark, sf_dir).filter("changed").select("field_name", "record_id")


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
