"""A polled source: rows that change upstream, fetched by cursor through Spark's Data Source API.

``spark.dataSource.register(PollSource)``, then ``spark.readStream.format("polled")`` with the options

* ``path``: a folder of Parquet files with ``id`` and ``updated_at`` (texts that sort as times do) and other columns,
* ``schema``: the columns to read, as DDL,
* ``cursor``: where the last call ended, as the text of a cursor; without one all is fetched,
* ``rowsPerBatch`` and ``partitionRows``: how many rows a batch and a task may hold,
* ``overlap``: seconds before the mark that are fetched again, so that rows written late are not lost.

An offset is a cursor (updated_at, id), and a batch holds the rows between two of them; the first batch of a call also
holds those of the overlap. So a batch that is run again reads the same rows, as long as upstream changes a row only by
giving it a later time. Tasks read ranges of cursors; the driver sees the cursors of one batch at most.
"""

from __future__ import annotations

import datetime as dt
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Cursor = tuple[str, str]
NOWHERE: Cursor = ("", "")
KEY = ["updated_at", "id"]


class Range(InputPartition):
    """Rows behind ``low`` (or at or behind ``low[0]`` with ``again``) up to ``high``."""

    def __init__(self, low: Cursor, high: Cursor, again: bool = False) -> None:
        self.low, self.high, self.again = low, high, again


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PollReader(self.options, schema.fieldNames())


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns
        self.rows, self.part = int(options.get("rowsPerBatch", 100_000)), int(options.get("partitionRows", 10_000))
        self.overlap = int(options.get("overlap", 60))
        told = options.get("cursor")
        self.at: Cursor = (json.loads(told)["updated_at"], json.loads(told)["id"]) if told else NOWHERE
        self.begun: Cursor = self.at

    def initialOffset(self) -> dict:
        return _offset(self.at)

    def latestOffset(self) -> dict:
        """The cursor of the last row of the next batch, or where the last one ended."""
        keys = _next_keys(self.path, self.at, self.rows)
        return _offset(keys[-1] if keys else self.at)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["updated_at"], start["id"]), (end["updated_at"], end["id"])
        self.at = max(self.at, high)
        cuts = [low, *_next_keys(self.path, low, self.rows, high)[self.part - 1 : -1 : self.part], high] if low < high else []
        out = [Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        if low == self.begun and low != NOWHERE and self.overlap:
            out.insert(0, Range((_earlier(low[0], self.overlap), ""), low, again=True))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in _scanned(self.path, partition, self.columns):
            if len(batch):
                yield batch


def _offset(c: Cursor) -> dict:
    return dict(zip(KEY, c, strict=True))


def _earlier(at: str, seconds: int) -> str:
    """A time ``seconds`` before a mark; a mark that can't be read stays."""
    try:
        t = dt.datetime.fromisoformat(at.replace("Z", "+00:00")) - dt.timedelta(seconds=seconds)
    except ValueError:
        return at
    return t.isoformat(timespec="microseconds" if "." in at else "seconds").replace("+00:00", "Z")


def _scanned(path: str, span: Range, columns: list[str], batch_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of a range; files and row groups whose statistics lie outside are not read."""
    (a, i), (b, j) = span.low, span.high
    at, key = ds.field("updated_at"), ds.field("id")
    above = at >= a if span.again else (at > a) | ((at == a) & (key > i))
    below = (at < b) | ((at == b) & (key <= j))
    for batch in ds.dataset(path, format="parquet").to_batches(columns=columns, filter=above & below, batch_size=batch_rows):
        yield batch


def _next_keys(path: str, low: Cursor, n: int, high: Cursor | None = None) -> list[Cursor]:
    """The first n cursors behind ``low``, in order; no more than n are held."""
    top = high or ("\U0010ffff", "\U0010ffff")
    rows = (k for batch in _scanned(path, Range(low, top), KEY) for k in zip(*(pc.cast(batch.column(c), pa.string()).to_pylist() for c in KEY), strict=True))
    return heapq.nsmallest(n, rows)


def fetched(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, cursor: str | None, rows: int, overlap: int = 60) -> str | None:
    """One call: all batches that are there, written to ``out`` (batch=N, a repeated one replaces itself), and the cursor
    to start the next call with.
    """
    options = {"path": path, "schema": schema, "rowsPerBatch": str(rows), "partitionRows": str(max(1, rows // 4)), "overlap": str(overlap)}
    if cursor:
        options["cursor"] = cursor
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.append(number)

    last = cursor
    while True:  # a query that is started once fetches one bounded batch of a source of this kind
        q = spark.readStream.format("polled").options(**options).load().writeStream.foreachBatch(write)
        q = q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        ends = [s["endOffset"] for p in q.recentProgress for s in json.loads(p.json)["sources"] if s["endOffset"]]
        now = json.dumps(ends[-1]) if ends else last
        if now == last:
            return last
        last = options["cursor"] = now
        options["overlap"] = "0"  # once a call
