"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "millrace.scratch"  # the session's setting that ``scratch_space`` makes


def shared_dir(spark: SparkSession) -> str:
    """The folder of a ``scratch_space``, or else ``spark.checkpoint.dir``; only a local session may do without one."""
    named = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of what is done inside go to a folder of its own, which is deleted at the end: write or count
    the results before, since a returned DataFrame still reads them.
    """
    before, root = spark.conf.get(SCRATCH, None), f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    spark.conf.set(SCRATCH, root)
    try:
        yield root
    finally:
        spark.conf.set(SCRATCH, before) if before else spark.conf.unset(SCRATCH)
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: evaluated once, and whole when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
