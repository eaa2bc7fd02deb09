"""Queries of problem 10: personal information in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.p3 import town_names
from rowmill.llm.pii import disclosure, mentions, redact, scan_corpus
from rowmill.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its type and place."""
    return mentions(table(spark, sf_dir, "documents"), town_names(spark, sf_dir))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its mentions replaced by placeholders."""
    return redact(table(spark, sf_dir, "documents"), p10_found(spark, sf_dir))


def p10_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each capitalised term discloses a protected entity, in bits."""
    return disclosure(scan_corpus(table(spark, sf_dir, "documents"), town_names(spark, sf_dir))).select("term", "total", F.round("p", 4).alias("p"), F.round("bits", 3).alias("bits"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted, "p10_terms": p10_terms}
