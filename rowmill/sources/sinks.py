"""Where results go: Parquet tables, JSON files, upserts by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """A Parquet table; ``sort_by`` within the files makes min-max pruning work."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upsert(df: DataFrame, path: str, keys: list[str], at: str) -> str:
    """A new version of the table at ``path`` in which the last row of each key by ``at``
    counts, written beside the old one; returns the new version's path. Readers of the old
    version aren't disturbed, and a lost executor leaves no half-written table."""
    spark = df.sparkSession
    old = spark.read.parquet(path).unionByName(df, allowMissingColumns=True)
    rest = [c for c in old.columns if c not in keys]
    merged = old.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    merged.write.parquet(new)
    return new


def save_attempts(records: DataFrame, path: str, stamp: str) -> None:
    """Records (filename and more) as JSON, a folder for each document: the time and the file's name without its ending."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    records.withColumn("attempt", F.concat_ws("_", F.lit(stamp), stem)).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("attempt").json(path)
