"""Incremental reads of trails with the answers of the batch path, on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.plans import schema_reasons
from millrace.sources.files import found


def follow(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive under ``path``; the checkpoint is the consumer's offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def commit_after(stream: DataFrame, out: str, checkpoint: str, valid: Callable[[DataFrame], bool] = lambda _: True) -> int:
    """Write all that has arrived to ``out``, each batch only if ``valid``; batches written again replace themselves.

    Returns the number of batches. The offset moves only behind a written batch: a batch that is not valid ends the
    query, and the next call starts with it.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        if not valid(batch):
            raise ValueError(f"batch {number} is not valid; its offset stays")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def high_water(rows: DataFrame, at: str, key: str) -> DataFrame:
    """One row: the greatest (at, key)."""
    return rows.agg(F.max(F.struct(at, key)).alias("m")).select(f"m.{at}", f"m.{key}")


def overlapping(rows: DataFrame, at: str, mark: Column | None, seconds: int = 60) -> DataFrame:
    """Rows from ``seconds`` before the mark on; rows whose time can't be read are not. Without a mark all rows stay,
    those as well. What an earlier fetch has seen comes again: see ``unseen``.
    """
    return rows if mark is None else rows.filter(F.col(at) >= mark - F.expr(f"INTERVAL {seconds} SECONDS"))


def unseen(rows: DataFrame, key: list[str], seen: DataFrame | None = None) -> DataFrame:
    """One row a key, without the keys of ``seen``."""
    once = rows.dropDuplicates(key)
    return once if seen is None else once.join(seen.select(key).distinct(), key, "left_anti")


def isolated(rows: DataFrame, schema: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep to ``schema`` (see ``plans.schema_reasons``), and the others with their ``reason``: one bad row
    does not stop a fetch.
    """
    told = rows.withColumn("reason", F.array_join(schema_reasons(schema), "; "))
    return told.filter("reason = ''").drop("reason"), told.filter("reason <> ''")


def poll_report(good: DataFrame, bad: DataFrame, at: str, key: str, reasons: int = 20) -> DataFrame:
    """One row: emitted and skipped rows, at most ``reasons`` reasons, and the greatest (at, key) by text as the cursor."""
    mark = good.agg(F.count("*").alias("emitted"), F.max(F.struct(F.col(at).cast("string").alias("updated_at"), F.col(key).cast("string").alias("id"))).alias("cursor"))
    some = bad.select("reason").orderBy("reason").limit(reasons).agg(F.collect_list("reason").alias("reasons"))
    return mark.join(F.broadcast(bad.agg(F.count("*").alias("skipped")))).join(F.broadcast(some))


def pull(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, inbox_max: int, files_per_batch: int = 100) -> dict:
    """Fetch what has arrived under ``path`` to the spool ``out``, unless that holds ``inbox_max`` files or more: then
    nothing is read, the offset stays, and the report says so. An ``inbox_max`` below 1 sets no bound.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    depth = files.load(out).select("path").count() if found(spark, out) else 0
    if inbox_max >= 1 and depth >= inbox_max:
        return {"complete": True, "paused": True, "depth": depth, "batches": 0}
    return {"complete": True, "paused": False, "depth": depth, "batches": commit_after(follow(spark, path, schema, files_per_batch), out, checkpoint)}


def next_cursor(current: str | None, scratch: str | None) -> tuple[str | None, str | None]:
    """The cursor after a step and a warning, if any: an empty or unchanged scratch moves nothing, and what is no cursor
    (a JSON object of two texts) moves nothing either but is told.
    """
    if not (scratch or "").strip():
        return current, None
    try:
        found = json.loads(scratch)
    except ValueError:
        return current, "scratch is no JSON; the cursor stays"
    if not isinstance(found, dict) or not all(isinstance(found.get(k), str) for k in ("updated_at", "id")):
        return current, "scratch is no cursor; the cursor stays"
    return json.dumps({k: found[k] for k in ("updated_at", "id")}, separators=(",", ":")), None


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Events by tumbling window and key; rows later than ``late`` behind the newest are dropped with closed windows."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = timed.groupBy(F.window("_at", width).alias("w"), key).agg(F.count("*").alias("n_events"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n_events")
