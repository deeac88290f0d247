"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters; ``bytes.split()`` cuts at exactly the same ones.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of all rows is heavy. There are at most 1 / HEAVY_SHARE of them,
#: which is the proven bound on every table that ``join_per_key`` broadcasts.
HEAVY_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without: elsewhere executors would
    write where nobody else reads, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


def tidy() -> None:
    """Give a Python worker's free memory back to the system; workers live on between stages and share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. Each value
    of the columns ``by`` has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitting(sizes: list[int], room: int) -> list[int]:
    """Which of ``sizes``, in order, are taken into ``room``: each that needs no more than half of what is still free, so
    that one giant never shuts out those behind it. Where none fits, the smallest is taken.
    """
    taken = []
    for k, size in enumerate(sizes):
        if size * 2 <= room:
            taken.append(k)
            room -= size
    return taken if taken or not sizes else [min(range(len(sizes)), key=sizes.__getitem__)]


def fold(x: Column) -> Column:
    """crc32 of a value's text, as unsigned; the splits for held-out rows are made with it. Null stays null."""
    return F.crc32(x.cast("string").cast("binary"))


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join ``rows`` with ``per_key`` (one row per non-null ``key``, ``count`` of ``total`` rows each).

    Keys with over HEAVY_SHARE of all rows are at most 1 / HEAVY_SHARE and are broadcast, so that a hot key's rows
    stay where they are; the others are joined by a shuffle in which no key is large. Rows whose key is null or
    unknown stay, with nulls. ``rows`` is read once for each of three branches, so it should be a stored table.
    """
    limit = max(1, int(total * HEAVY_SHARE))
    heavy, light = per_key.filter(F.col(count) > limit), per_key.filter(F.col(count) <= limit)
    of_heavy = rows.join(F.broadcast(heavy), key)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    keyed = others.filter(F.col(key).isNotNull()).join(light, key, "left")
    new = [c for c in per_key.columns if c != key]
    null = others.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(per_key.schema[c].dataType).alias(c) for c in new])
    order = [*rows.columns, *new]
    return of_heavy.select(order).union(keyed.select(order)).union(null.select(order))
