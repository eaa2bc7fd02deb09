"""Reading the project's tables and removing redelivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key and delivery-time column of the tables that are delivered more than once.
KEYS: dict[str, tuple[list[str], str]] = {
    "jobs": (["job_id"], "finished_at"),
    "job_files": (["job_id", "file_index"], "updated_at"),
    "page1_records": (["page1_id"], "received_at"),
    "property_addresses": (["address_record_id"], "received_at"),
    "residents": (["resident_id"], "received_at"),
    "identity_documents": (["document_id"], "received_at"),
    "departures": (["departure_id"], "received_at"),
    "ocr_pages": (["page_id"], "received_at"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table as delivered."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """One row per key, the last delivered; equal times are broken by the values.

    Only ``columns`` travel. A hash aggregate with partial aggregation: a key that
    holds a third of all rows is reduced before the shuffle.
    """
    rest = [c for c in columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order: list[Column] = [F.col(at), *[F.xxhash64(c) for c in rest]]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def current(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of a table with redelivered rows counted once."""
    keys, at = KEYS[name]
    return latest(table(spark, sf_dir, name), keys, at, list(columns))
