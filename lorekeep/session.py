"""Session helpers: shared folders, staged tables and lineage cuts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorekeep")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only a session without one (as in local tests) gets a folder under the local temp directory.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    local = os.path.join(tempfile.gettempdir(), "checkpoints", f"lorekeep-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir("file://" + local)
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting that drops a query's shuffle files when it ends; a later read of the same plan shuffles anew.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The written table cuts lineage: an executor that is lost later costs no recomputation, and a
    costly step that several consumers read runs once. Its shuffle files go as soon as it is written,
    and don't wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task of a dealt table takes.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys into a number of tasks that grows with its rows, so that what a task sorts or counts doesn't."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / ROWS_PER_TASK)), *keys)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/staged/" in folder.toString():
            folder.getFileSystem(conf).delete(folder, True)
