"""Live trails: followed by run with state, watched for silence by timers, and re-fetched rows counted once.

State is Spark's own, kept in the query's checkpoint: a query that is started again goes on where it stopped. A trail is
a folder to which files of lines are added; files of a later call must have later names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.folds import TERMINAL
from millrace.sources.files import trail_rows

FOLLOWED = "run_id string, seq long, at_raw string, ev_at timestamp, event string, node string, exit_code int, data string"
PLACE = ["file", "block", "row"]  # where a line stands
STATUS = "run_id string, change long, status string, event string, last_at timestamp"


def trail_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of the trail files that arrive under ``path``, with their file and the place of their lines in it."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return trail_rows(lines.mapInArrow(_counted, "file string, block long, value string, row long"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place in the task; a stream has no other number that grows along a file."""
    n = 0
    for batch in batches:
        yield batch.append_column("row", pa.array(range(n, n + len(batch)), pa.int64()))
        n += len(batch)


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One run's rows of a batch as they stand in their files."""
    some = list(parts)
    rows = pd.concat(some, ignore_index=True) if len(some) > 1 else some[0]
    return rows.sort_values(PLACE, kind="stable")


def followed(events: DataFrame, stop: bool = True, schema: str = FOLLOWED) -> DataFrame:
    """New events of every run, as they come: seq must grow, so what comes again or late is dropped, and a row without
    seq counts as 0. With ``stop`` a run ends with its first terminal event.

    State is the last seq and whether the run has ended: one row a run, and no more of it is needed. ``schema`` names the
    columns of FOLLOWED that are wanted: no others are read from the lines or go through Python.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    needed = [c for c in _keyed(events).columns if c in {"run_id", "seq", "event", *PLACE, *columns}]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (0, False)
        kept = []
        rows = _in_order(parts)
        for n, (seq, event) in enumerate(zip(rows["seq"].fillna(0).astype("int64").tolist(), rows["event"].tolist(), strict=True)):
            if ended or seq <= last:
                continue
            kept.append(n)
            last = seq
            ended = stop and event in TERMINAL
        state.update((last, ended))
        yield rows[columns].iloc[kept]

    return _keyed(events).select(needed).groupBy("run_id").applyInPandasWithState(run, schema, "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def _keyed(events: DataFrame) -> DataFrame:
    """What the stateful steps read: plain types, and the place of every line."""
    return events.select(
        "run_id", "seq", "at_raw", F.col("ev_at").cast("timestamp").alias("ev_at"), "event", "node", "exit_code", F.to_json("data").alias("data"),
        "file", F.col("line_no.block").alias("block"), F.col("line_no.row").alias("row"),
    )


def watched(events: DataFrame, grace_s: int, late: str) -> DataFrame:
    """Changes of every run's status (see ``folds.run_status``), numbered by run: one row when it changes, none else.

    Now is the greatest event time less ``late``. A run whose last event looks alive becomes ``stale`` when nothing
    follows it for more than ``grace_s`` whole seconds, once, by a timer; a later event makes it ``running`` again. Rows
    whose time is older than ``late`` behind the newest are dropped by Spark. State is one row a run.
    """
    ended = {"gate-pending": "gate", "run-halt": "halted", "run-done": "done"}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        change, status, event, last = state.get if state.exists else (0, None, None, None)
        was = status
        if state.hasTimedOut:
            status = "stale"
        else:
            tail = _in_order(parts).iloc[-1]
            event, at = tail["event"], tail["ev_at"]
            last = None if pd.isna(at) else int(at.value // 10**9)  # whole seconds
            status = ended.get(event, "running")
            due = None if last is None else (last + grace_s + 1) * 1000 - 1  # the last millisecond of the grace
            if status == "running" and due is not None:
                if due < state.getCurrentWatermarkMs():
                    status = "stale"
                else:
                    state.setTimeoutTimestamp(max(due, 1))
        change += status != was
        state.update((change, status, event, last))
        if status != was:
            yield pd.DataFrame({"run_id": [key[0]], "change": [change], "status": [status], "event": [event], "last_at": [None if last is None else pd.Timestamp(last, unit="s")]})

    # times to the nearest millisecond, as ``folds.run_status`` reads them; of the lines no more than is asked for
    at = F.timestamp_micros(F.floor((F.unix_micros("ev_at") + 500) / 1000) * 1000)
    timed = _keyed(events).select("run_id", "event", at.alias("ev_at"), *PLACE).withWatermark("ev_at", late)
    return timed.groupBy("run_id").applyInPandasWithState(run, STATUS, "change long, status string, event string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_status(changes: DataFrame) -> DataFrame:
    """run_id and status after all ``changes``."""
    return changes.groupBy("run_id").agg(F.max_by("status", "change").alias("status"))


def once_within(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key's first row; a re-fetched one within ``late`` behind the newest time is dropped as known, an older one as
    lost. Rows whose time can't be read take no part. State holds keys no longer than ``late``.
    """
    timed = events.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(key)


def drained(stream: DataFrame, out: str, checkpoint: str, valid: Callable[[DataFrame], bool] | None = None) -> int:
    """Write all that has arrived to the Parquet folder ``out``, each batch once whatever is repeated; the number of rows
    that came too late for the stream's watermark.
    """

    def write(batch: DataFrame, number: int) -> None:
        if valid is not None and not valid(batch):
            raise ValueError(f"batch {number} is not valid; its offset stays")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(o["numRowsDroppedByWatermark"]) for p in q.recentProgress for o in p["stateOperators"])
