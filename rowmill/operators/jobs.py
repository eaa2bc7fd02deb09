"""The job tables: states, counts, listings, retention, merges of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(jobs: DataFrame) -> DataFrame:
    """status, n: jobs by status and a row ``total`` (one rollup)."""
    return jobs.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("_g")).select(F.when(F.col("_g") == 1, "total").otherwise(F.col("status")).alias("status"), "n")


def file_counts(files: DataFrame) -> DataFrame:
    """job_id, total_files, completed_files, failed_files, pages from the files themselves."""
    return files.groupBy("job_id").agg(F.count("*").alias("total_files"), F.count_if(F.col("status") == "completed").alias("completed_files"), F.count_if(F.col("status") == "failed").alias("failed_files"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages"))


def final_status(total: Column, completed: Column, failed: Column) -> Column:
    """The state a job has by its files: running until all are done, then completed, or
    completed_with_errors if any failed (``failed`` is the state of a job that broke off itself)."""
    return F.when(completed + failed < total, "running").when(failed == 0, "completed").otherwise("completed_with_errors")


def newest(jobs: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest jobs with their files in order, in one join; ties by job_id."""
    top = jobs.orderBy(F.col("created_at").desc(), "job_id").limit(k)
    parts = F.sort_array(F.collect_list(F.struct("file_index", "filename")))  # the files of one job
    listed = files.join(F.broadcast(top.select("job_id")), "job_id", "left_semi") if k <= 100_000 else files.join(top.select("job_id"), "job_id", "left_semi")
    own = listed.groupBy("job_id").agg(F.array_join(F.transform(parts, lambda p: p["filename"]), "|").alias("file_names"), F.count("*").alias("n_files"))
    return top.join(own, "job_id", "left")


def expired(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    return jobs.filter(F.col("created_at") < now - F.make_dt_interval(F.lit(days)))


def retained(jobs: DataFrame, files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files whose job is not older than ``days``."""
    return files.join(expired(jobs, now, days).select("job_id"), "job_id", "left_anti")


def merge_results(files: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Files with the columns of ``results`` (same names) where a result of the same key has
    come; the last of several results wins."""
    updates = [c for c in results.columns if c not in keys and c != "at"]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*updates), "at").alias("_u"))
    joined = files.join(last, keys, "left")
    return joined.select(*[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in files.columns])


def latest_state(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """``key``, ``state``, n_events: the last state of each key; equal times by ``tie``."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.count("*").alias("n_events"))


def durations(jobs: DataFrame) -> DataFrame:
    """status, n, mean and longest seconds from start to end of the jobs that ended."""
    s = F.col("finished_at").cast("double") - F.col("started_at").cast("double")
    return jobs.filter("started_at IS NOT NULL AND finished_at IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean_s"), F.round(F.max(s), 3).alias("longest_s"))
