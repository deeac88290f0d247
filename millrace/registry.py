"""The registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.sources import views as V

NOW_TRAIL, NOW_RUNS = "2024-01-31 00:00:00", "2001-09-01 00:00:00"
LATE_TRAIL = "2024-01-30 22:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def query(view: str, sql: str):
    """Register a query under its function's name, with the SQL over the views it names."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = V.sql(view, sql) if view else sql
        return f

    return add
