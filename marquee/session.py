"""Spark session for local work, and the folder every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "marquee", cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables.

    Only a local session may go without the setting; it then gets a folder of its
    own. The SparkContext is told about the folder, so that ``DataFrame.checkpoint``
    and ALS can cut their lineage there.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="marquee-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return os.path.join(shared_dir(spark), f"marquee-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at ``path``, in whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A path for a table that is deleted when the block ends."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables and models of this application.

    For its end: results that are not computed yet may still read them.
    """
    remove(spark, scratch_dir(spark))
