"""Queries of problem 9: benchmark items inside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.leakage import leaks
from rowmill.tables import table


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked pair with its best passage."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that hold a passage of it."""
    counts = p9_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))
    items = table(spark, sf_dir, "benchmark_items").select("item_id", "split_name")
    return items.join(counts, "item_id", "left").select("item_id", "split_name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items}
