"""Session and shared-storage helpers.

Nothing here assumes a machine: the folder for written intermediate tables is
the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) a local folder is chosen.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", name: str = "rowmill", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure a checkpoint folder is set."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, set here only if the session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="rowmill-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions by ``keys``: narrow rows before a costly Python stage, which
    adaptive execution would otherwise gather into few tasks by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_WRITTEN: list[str] = []


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables this process wrote; frames that read them can't be used any more."""
    fs = spark._jvm.org.apache.hadoop.fs
    while _WRITTEN:
        path = fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: later steps neither
    recompute it nor depend on the executors that made it. by: a column of few values the table is
    parted by, so that a filter on it reads only its part. :func:`forget` removes the tables
    when their results have been used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rowmill-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
