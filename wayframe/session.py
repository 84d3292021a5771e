"""Session settings, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wayframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings given outside win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        # a local session runs its tasks in the driver's JVM
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def cut_lineages(*frames: DataFrame) -> list[DataFrame]:
    """Write tables that do not depend on each other, as jobs that run side by side."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(cut_lineage, frames))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table as Parquet to the shared folder and read it from there.

    It is computed once, keeps its columns apart for later readers, and outlives the executors. The shuffle files it took
    go when it is written.
    """
    path = scratch_folder(df.sparkSession, "wayframe-cut")
    df.write.mode("overwrite").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now, not at its next half-hourly turn."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unbroadcast(df: DataFrame) -> DataFrame:
    """A table that joins sort and merge, however small its file.

    Spark takes the size of a file for that of its rows. Packed columns of few values unfold to many times of it in the
    driver, which builds what is broadcast.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names; None in a local session (tests) that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder or None


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for written tables and stream state that every executor can reach.

    Written tables are read lazily, so they stay until the folder the cluster names is cleaned; a local session's
    own folder goes with its process.
    """
    folder = shared_folder(spark) or _local_folder()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="wayframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
