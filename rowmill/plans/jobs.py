"""Queries over jobs, files and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import jobs as J
from rowmill.plans.sql import current
from rowmill.streaming.jobs import replay_states
from rowmill.tables import current as cur
from rowmill.tables import table

NOW = "2033-06-01"


def jobs(s, d):
    return cur(s, d, "jobs", "job_id", "status", "created_at", "started_at", "finished_at", "total_files", "completed_files", "failed_files", "error")


def files(s, d):
    return cur(s, d, "job_files", "job_id", "file_index", "filename", "status", "pages", "error")


def q_status(s, d):
    return J.status_counts(jobs(s, d))


def q_file_counts(s, d):
    return J.file_counts(files(s, d))


def q_final(s, d):
    c = q_file_counts(s, d)
    return c.select("job_id", J.final_status(F.col("total_files"), F.col("completed_files"), F.col("failed_files")).alias("state"))


def q_lagging(s, d):
    state = q_final(s, d)
    return jobs(s, d).select("job_id", "status").join(state, "job_id").filter("status <> state")


def q_newest(s, d):
    return J.newest(jobs(s, d).select("job_id", "status", "created_at"), files(s, d), 50).select("job_id", "status", "file_names", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def q_retained(s, d):
    return J.retained(jobs(s, d), files(s, d), F.lit(NOW).cast("timestamp"), 400).groupBy("job_id").agg(F.count("*").alias("n_files"))


def q_expired(s, d):
    return J.expired(jobs(s, d), F.lit(NOW).cast("timestamp"), 400).select("job_id")


def q_latest_state(s, d):
    return J.latest_state(table(s, d, "events"), "user_id", "event_type", "ts", "event_id")


def q_merge(s, d):
    base = files(s, d).select("job_id", "file_index", F.lit("queued").alias("status"), F.lit(None).cast("int").alias("pages"))
    came = files(s, d).filter("status = 'completed'").select("job_id", "file_index", "status", "pages", F.lit(1).alias("at"))
    return J.merge_results(base, came, ["job_id", "file_index"])


def q_durations(s, d):
    return J.durations(jobs(s, d))


def q_json_roundtrip(s, d):
    x = files(s, d).select(F.to_json(F.struct("job_id", "file_index", "filename", "status", "pages")).alias("record"))
    schema = "job_id string, file_index int, filename string, status string, pages int"
    return x.select(F.from_json("record", schema).alias("r")).select("r.*")


def q_props(s, d):
    p = F.from_json("props", "map<string,string>")
    return table(s, d, "events").filter("props IS NOT NULL").select("event_id", F.explode(F.map_keys(p)).alias("prop")).groupBy("prop").agg(F.count("*").alias("n"))


def q_warnings(s, d):
    w = cur(s, d, "job_files", "job_id", "file_index", "warnings")
    return w.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def q_stream(s, d):
    return replay_states(s, f"{d}/events.parquet")


_F, _J = current("job_files"), current("jobs")
_COUNTS = f"SELECT job_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS completed_files, count(*) FILTER (WHERE status = 'failed') AS failed_files, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages FROM {_F} GROUP BY job_id"
_FINAL = f"SELECT job_id, CASE WHEN completed_files + failed_files < total_files THEN 'running' WHEN failed_files = 0 THEN 'completed' ELSE 'completed_with_errors' END AS state FROM ({_COUNTS})"
_OLD = f"SELECT job_id FROM {_J} WHERE created_at < TIMESTAMP '{NOW} 00:00:00' - INTERVAL 400 DAY"
_STATE = "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, count(*) AS n_events FROM events GROUP BY user_id"
QUERIES = {
    "job_status_rollup": q_status, "job_file_counts": q_file_counts, "job_final_state": q_final, "jobs_lagging": q_lagging, "jobs_newest": q_newest, "files_retained": q_retained, "jobs_expired": q_expired, "latest_state": q_latest_state,
    "merge_results": q_merge, "job_durations": q_durations, "json_roundtrip": q_json_roundtrip, "event_props": q_props, "warning_counts": q_warnings, "stream_states": q_stream,
}
ORACLE = {
    "job_status_rollup": f"SELECT CASE WHEN grouping(status) = 1 THEN 'total' ELSE status END AS status, count(*) AS n FROM {_J} GROUP BY ROLLUP (status)",
    "job_file_counts": _COUNTS,
    "job_final_state": _FINAL,
    "jobs_lagging": f"SELECT job_id, status, state FROM {_J} JOIN ({_FINAL}) USING (job_id) WHERE status <> state",
    "jobs_newest": f"WITH t AS (SELECT job_id, status FROM {_J} ORDER BY created_at DESC, job_id LIMIT 50) SELECT t.job_id, t.status, string_agg(f.filename, '|' ORDER BY f.file_index, f.filename) AS file_names, count(f.job_id) AS n_files FROM t LEFT JOIN {_F} f USING (job_id) GROUP BY ALL",
    "files_retained": f"SELECT job_id, count(*) AS n_files FROM {_F} WHERE job_id NOT IN ({_OLD}) GROUP BY job_id",
    "jobs_expired": _OLD,
    "latest_state": _STATE,
    "merge_results": f"SELECT job_id, file_index, CASE WHEN status = 'completed' THEN status ELSE 'queued' END AS status, CASE WHEN status = 'completed' THEN pages END AS pages FROM {_F}",
    "job_durations": f"SELECT status, count(*) AS n, CAST(round(avg(x), 3) AS DOUBLE) AS mean_s, CAST(round(max(x), 3) AS DOUBLE) AS longest_s FROM (SELECT status, CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1000000 AS x FROM {_J} WHERE started_at IS NOT NULL AND finished_at IS NOT NULL) GROUP BY status",
    "json_roundtrip": f"SELECT job_id, file_index, filename, status, pages FROM {_F}",
    "event_props": "SELECT prop, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS prop FROM events WHERE props IS NOT NULL) GROUP BY prop",
    "warning_counts": f"SELECT warning, count(*) AS n FROM (SELECT unnest(warnings) AS warning FROM {_F}) GROUP BY warning",
    "stream_states": _STATE,
}
