"""Session helpers: a tuned local session for tests, and the shared folder for published tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "intake", cores: str | int = "*") -> SparkSession:
    """A session for tests and the benchmark; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("INTAKE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder; a cluster without the setting
    is an error, because a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="intake-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def publish(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of recomputing history) and gives
    the planner true file sizes, so that later joins choose a broadcast only when the table is small.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


def publish_all(**tables: DataFrame) -> dict[str, DataFrame]:
    """Publish independent tables side by side, so that small jobs do not wait for each other."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        jobs = {name: pool.submit(publish, df, name) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan yields fewer pieces than there are cores (one small file).

    Files of a real lake split into far more pieces than cores, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
