"""Job states as a stream: file source, stateful last state, sinks by foreachBatch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.session import shared_dir


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Events as they arrive: new Parquet files under ``path`` (a folder, or one file)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    if files.getFileStatus(place).isDirectory():
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def last_states(events: DataFrame) -> DataFrame:
    """user_id, event_type, n_events: one row of state per key; late events count by their own time."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n_events"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event type and time window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_deliveries(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once: redeliveries within the watermark are dropped, so state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    """Run what is there to the end, batch by batch. The checkpoint lies in the shared folder, so
    a lost executor or a restart resumes after the last finished batch."""
    where = checkpoint or f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def replay_states(spark: SparkSession, path: str) -> DataFrame:
    """The states a stream over ``path`` ends with: each batch is written to the shared folder
    under its number, a repeated batch overwrites itself, and the last state of a key counts."""
    out = f"{shared_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], "user_id long, event_type string, n_events long, batch int").write.parquet(f"{out}/batch=none")
    events = event_stream(spark, path)
    run(last_states(events), sink)
    states = spark.read.option("recursiveFileLookup", "true").schema("user_id long, event_type string, n_events long, batch int").parquet(out)
    return states.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n_events"), "batch").alias("s")).select("user_id", "s.*")


def callback_sink(post: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A sink that hands each finished record to ``post`` as JSON from the executors; a failure of
    one record is swallowed, as a receiver's fault must not stop the stream."""

    def send(rows) -> None:
        for r in rows:
            try:
                post(r[0])
            except Exception:  # noqa: BLE001
                continue

    def sink(batch: DataFrame, _: int) -> None:
        batch.select(F.to_json(F.struct(*batch.columns))).foreachPartition(send)

    return sink


