"""Queries of problem 8: texts packed into containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.packing import fill, pack
from rowmill.tables import table


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text for every target."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill(p8_containers(spark, sf_dir), table(spark, sf_dir, "pack_targets"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
