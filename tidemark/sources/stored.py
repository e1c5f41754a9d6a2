"""Tables that jobs derive once and keep in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's own setting: shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on a local master without one, a new temporary folder."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(SETTING, base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> str:
    """Write ``df`` once and return its path: what reads it has no lineage and a small plan, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run go with it; for frames that nothing else will run."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
