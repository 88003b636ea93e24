"""Spark session for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quillspark", cpus: int | str | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC time and few shuffle partitions."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Only a local session may do without one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, as a table in the shared folder: for what is read several times and would be shuffled each time."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
