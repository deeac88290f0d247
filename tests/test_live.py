"""Live trails, polls, schedules, versions and log ends, by hand."""

import datetime as dt
import itertools
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import calendar, versions
from millrace.sources import files, poll
from millrace.streaming import live


def lines(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps({"v": 1, "seq": s, "at": f"2026-07-03T10:{m:02d}:00Z", "run_id": r, "event": e}) + "\n" for r, s, m, e in rows))


STEPS = [
    [("r", 1, 0, "run-start"), ("r", 2, 1, "step-done"), ("q", 1, 2, "gate-pending"), ("z", 1, 15, "step-done")],
    [("r", 2, 1, "step-done"), ("r", 3, 16, "step-done"), ("q", 2, 17, "run-done"), ("q", 3, 18, "learn"), ("z", 2, 15, "learn")],
    [("r", 1, 40, "run-start"), ("z", 3, 41, "x")],
]


def test_follow_goes_on_from_its_checkpoint(spark, tmp_path):
    for n, rows in enumerate(STEPS):
        lines(tmp_path / "in", f"a{n}", rows)
        live.drained(live.followed(live.trail_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/offsets")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("run_id", "seq", "event", "batch").collect()))
    assert got == [("q", 1, "gate-pending", 0), ("q", 2, "run-done", 1), ("r", 1, "run-start", 0), ("r", 2, "step-done", 0), ("r", 3, "step-done", 1), ("z", 1, "step-done", 0), ("z", 2, "learn", 1), ("z", 3, "x", 2)]


def test_silence_is_told_once_and_a_later_event_ends_it(spark, tmp_path):
    for n, rows in enumerate(STEPS):
        lines(tmp_path / "in", f"a{n}", rows)
        live.drained(live.watched(live.trail_stream(spark, f"{tmp_path}/in"), 600, "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/offsets")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("run_id", "change", "status").collect()))
    assert got == [("q", 1, "gate"), ("q", 2, "running"), ("q", 3, "stale"), ("r", 1, "running"), ("r", 2, "stale"), ("r", 3, "running"), ("z", 1, "running")]


def test_a_batch_that_is_not_valid_keeps_its_offset(spark, tmp_path):
    lines(tmp_path / "in", "a0", STEPS[0])
    args = (f"{tmp_path}/out", f"{tmp_path}/offsets")
    with pytest.raises(Exception, match="not valid"):
        live.drained(live.followed(live.trail_stream(spark, f"{tmp_path}/in")), *args, valid=lambda _: False)
    live.drained(live.followed(live.trail_stream(spark, f"{tmp_path}/in")), *args)
    assert spark.read.parquet(args[0]).count() == 4


def test_a_poll_reads_ranges_of_cursors(tmp_path):
    times = [f"2026-07-03T10:00:{s:02d}Z" for s in range(30)]
    rows = [{"id": f"i{k}", "updated_at": t, "v": k} for k, t in enumerate(t for t in times for _ in range(3))]
    for n in range(3):
        pq.write_table(pa.Table.from_pylist(rows[n::3]), tmp_path / f"{n}.parquet")
    options = {"path": str(tmp_path), "schema": "id string, updated_at string, v long", "rowsPerBatch": "20", "partitionRows": "6"}
    reader = poll.PollReader(options, ["id", "updated_at", "v"])
    start, seen, order = reader.initialOffset(), [], sorted(rows, key=lambda r: (r["updated_at"], r["id"]))
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        got = [[r for b in reader.read(p) for r in b.to_pylist()] for p in parts]
        assert sum(map(len, got)) <= 20 and max(map(len, got)) <= 6
        again = [[r for b in poll.PollReader(options, ["id", "updated_at", "v"]).read(p) for r in b.to_pylist()] for p in poll.PollReader(options, []).partitions(start, end)]
        key = lambda r: r["id"]
        assert sorted(itertools.chain(*again), key=key) == sorted(itertools.chain(*got), key=key)  # a replay reads the same
        seen += itertools.chain(*got)
        start = end
    assert sorted(seen, key=lambda r: r["v"]) == sorted(order, key=lambda r: r["v"])
    # from a cursor, rows of the overlap come again, but once a call
    later = poll.PollReader(options | {"cursor": json.dumps({"updated_at": times[20], "id": "i61"}), "overlap": "2"}, ["id", "updated_at", "v"])
    parts = later.partitions(later.initialOffset(), later.latestOffset())
    got = [r["v"] for p in parts for b in later.read(p) for r in b.to_pylist()]
    assert sorted(got) == list(range(54, 82)) and not later.partitions({"updated_at": times[28], "id": "i85"}, {"updated_at": times[28], "id": "i85"})


def matching(spec, t):
    minute, hour, dom, month, dow, dom_any, dow_any = spec
    day = dow_any or (t.isoweekday() % 7) in dow
    date = t.day in dom
    fits = date and day if dom_any or dow_any else date or (t.isoweekday() % 7) in dow
    return t.minute in minute and t.hour in hour and t.month in month and fits


CASES = [
    ("*/7 * * * *", ([*range(0, 60, 7)], range(24), range(1, 32), range(1, 13), range(7), True, True)),
    ("0 22 31 jan,MAR *", ([0], [22], [31], [1, 3], range(7), False, True)),
    ("5 4 1 * sun-tue", ([5], [4], [1], range(1, 13), [0, 1, 2], False, False)),
    ("50-58/4 0-6/3 * 2 7", ([50, 54, 58], [0, 3, 6], range(1, 32), [2], [0], True, False)),
]


@pytest.mark.parametrize(("expr", "spec"), CASES)
def test_next_fire_is_that_of_a_walk_over_minutes(spark, expr, spec):
    starts = [dt.datetime(2026, 1, 30, 21, 59, 30), dt.datetime(2024, 2, 28, 23, 59), dt.datetime(2026, 12, 31, 23, 58), dt.datetime(2026, 3, 1, 4, 5)]
    df = spark.createDataFrame([(s,) for s in starts], "t timestamp_ntz")
    for s, got in df.select("t", calendar.next_fire(calendar.parse_cron(F.lit(expr)), F.col("t"))).collect():
        t = s.replace(second=0) + dt.timedelta(minutes=1)
        while not matching(spec, t):
            t += dt.timedelta(minutes=1)
        assert got == t


def test_what_is_no_schedule_is_null(spark):
    bad = ["", "* * * *", "* * * * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "a * * * *", "5-1 * * * *", "*/0 * * * *", "1,,2 * * * *", "-3 * * * *", "@reboot", "@often", "1/x * * * *", "99999999999 * * * *", "50-70/5 * * * *"]
    df = spark.createDataFrame([(x,) for x in bad], "x string")
    assert df.filter(calendar.parse_cron(F.col("x")).isNotNull()).count() == 0
    good = spark.createDataFrame([(x,) for x in ("@daily", " 0  0 * * * ", "50-70/30 * * * *", "0 0 1 1 7")], "x string")
    assert good.filter(calendar.parse_cron(F.col("x")).isNull()).count() == 0


def test_versions_sort(spark):
    order = ["0.9", "1.0.dev2", "1.0a1", "1.0b1", "1.0rc1", "1.0rc2", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10", "v2"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(order)], "n long, x string")
    assert [r.n for r in df.orderBy(versions.version_key(F.col("x"))).collect()] == list(range(len(order)))
    bad = spark.createDataFrame([("1.",), ("x",), ("1.0c1",), ("",), ("1.0-1",), ("9" * 30,)], "x string")
    assert bad.filter(versions.version_key(F.col("x")).isNotNull()).count() == 0


def test_the_end_of_a_log_costs_as_much_however_long_it_is(spark, tmp_path):
    logs = {"a": b"one\n\n two \n \n", "b": b"x" * 9000, "c": b"first\n" * 200_000 + b"last \xff\r\n", "d": b"", "e": b"y" * 5000 + b"\nz"}
    for name, raw in logs.items():
        (tmp_path / f"{name}.log").write_bytes(raw)
    got = {r.path[-5]: r for r in files.log_tails(spark, str(tmp_path), "*.log").collect()}
    assert {k: r.last_line for k, r in got.items()} == {"a": "two", "b": "", "c": "last �", "e": "z"}
    for k, raw in ((k, raw) for k, raw in logs.items() if raw):
        assert got[k].size == len(raw) and got[k].bytes_read == min(len(raw), 4096) and got[k].tail == raw[-4096:].decode("utf-8", "replace")
    assert files.log_tails(spark, f"{tmp_path}/none").count() == 0


def test_cursors_of_columns_and_of_texts_agree(spark):
    from millrace.functions import scalars as S
    from millrace.streaming import follow

    scratches = [None, "", "  ", "{", "[1]", "7", '{"updated_at":"a","id":"b"}', '{"updated_at":"a","id":1}', '{"updated_at":"a"}']
    df = spark.createDataFrame([(n, x) for n, x in enumerate(scratches)], "n int, x string")
    for n, c in df.select("n", S.next_cursor(F.lit("old"), F.col("x"))).collect():
        assert tuple(c) == follow.next_cursor("old", scratches[n])


def test_scratch_tables_go_when_their_space_ends(spark, tmp_path):
    from pathlib import Path

    from millrace.sources.scratch import scratch_space, shared_dir, stored

    with scratch_space(spark) as root:
        assert shared_dir(spark) == root and stored(spark.range(5), "x").count() == 5
        where = Path(root.removeprefix("file://"))
        assert any(where.iterdir())
        with scratch_space(spark) as inner:
            assert inner.startswith(root) and shared_dir(spark) == inner
        assert shared_dir(spark) == root
    assert not where.exists() and shared_dir(spark) != root
