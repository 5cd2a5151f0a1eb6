"""Session defaults and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder, which only serves a local master.

    On a cluster an unset folder raises, since executors of several machines don't share a temporary one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'chronolane-shared')}"
    return where.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/chronolane-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for a table that cuts lineage; all of an application's lie in one folder."""
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the application's scratch tables; results that were not yet computed or written need them."""
    from chronolane.sources import files

    files.delete(spark, scratch_root(spark))


def written(df, what: str, *, partition_by: tuple[str, ...] = ()):
    """The same rows, read from a table written in the shared folder: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
