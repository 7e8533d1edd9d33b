"""Session helpers: recommended settings, and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "threadloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables of this run, below the checkpoint folder all executors share.

    The session names that folder. Only a session whose executors are threads of the driver gets a
    folder of its own if it names none; elsewhere that is an error, because a folder of one machine
    would be lost with that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="threadloom-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """Path of a folder for this run alone, below the shared one; it is not made yet."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Computed once, durable when executors are lost, and still pruned and filtered by column when
    it is read, which a checkpoint of rows is not. The shuffle files of the write go with it: only
    the table is read later.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that `cut_lineage` returned. Frames that still read it must not be run any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{folder.rpartition('/')[2]}/table-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
