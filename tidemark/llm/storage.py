"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import new_path, shared_dir  # noqa: F401


#: Spark's own setting: shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``drop_shuffles``: its shuffle files go with the write, which the written table replaces; for a ``df`` that
    nothing else will run.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    try:
        if drop_shuffles:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`materialize` that nothing will read again."""
    path = getattr(df, "materialized_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named input columns, so that extra columns can never clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
