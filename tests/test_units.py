"""Hand-computed cases of readers, scalars, folds and streams."""

import datetime as dt
import fnmatch
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import folds, ledger, plans
from millrace.sources import files
from millrace.streaming import follow as stream

T0 = dt.datetime(2026, 7, 3, 10, 0, 0)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [("https://www.acme.co.uk/a?b", "acme-co"), ("acme.com", "acme"), ("http://A_b.example.org:80/", "a-b-example"), ("https://me:pw@www.acme.org/x", "acme"), ("host", "host"), ("", "")])
def test_slug(spark, url, want):
    assert one(spark, S.slug(F.col("u")), u=url) == want


@pytest.mark.parametrize(("n", "want"), [(3, "abc"), (-2, "abc"), (-9, ""), (0, ""), (9, "abcde")])
def test_short(spark, n, want):
    assert one(spark, S.short(F.col("v"), n), v="abcde") == want


@pytest.mark.parametrize(("a", "b", "want"), [("9", "10", -1), ("010", "10", 0), ("9" * 40, "1", 1), ("v1", "v1", 0), ("v1", "2", None)])
def test_rev_order(spark, a, b, want):
    assert one(spark, S.rev_order(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("text", "want"), [("90", 90), ("30m", 1800), ("1h30m", 5400), ("1.5h", None), ("", None), ("-3", None)])
def test_parse_duration(spark, text, want):
    assert one(spark, S.parse_duration(F.col("t")), t=text) == want


def test_item_names(spark):
    got = one(spark, S.parse_item_name(F.col("n")), n="p3-inbox-a-r2-b-r17.json")
    assert tuple(got) == (3, "inbox", "a-r2-b", "17")
    assert one(spark, S.parse_item_name(F.col("n")), n="P3-inbox-a-r1.json") is None
    assert one(spark, S.safe_item_id(F.col("n")), n="--Ab  c..-d_") == "ab-c-d"
    assert one(spark, S.safe_item_id(F.col("n")), n="._-") is None
    assert tuple(one(spark, S.parse_item_name(F.col("n")), n="p3-inbox-a-r1-2.json")) == (3, "inbox", "a", "1-2")
    for bad in ("p3-inbox-a--r1.json", "p3-inbox-a.-r1.json", "p3-inbox-a-r-1.json", "p3-inbox-" + "a" * 250 + "-r1.json"):
        assert one(spark, S.parse_item_name(F.col("n")), n=bad) is None


def test_exit_class_and_redaction(spark):
    assert [one(spark, S.exit_class(F.lit(c))["outcome"]) for c in (0, 6, 8, 9, 1, -15)] == ["DONE", "WAITING", "WAITING", "WAITING", "FAILED", "FAILED"]
    assert one(spark, S.redacted(F.col("t"), ["key", "key-long"]), t="key-long key") == "*** ***"
    with pytest.raises(KeyError):
        S.rendered("{missing}", {})


def test_read_trail(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    (run / "trail.jsonl").write_text('{"seq":1,"at":"2026-07-03T10:00:00.000Z","event":"run-start","data":{}}\n\n[1]\n{"seq":"z","event":"x"}\n{"seq":4,"ev')
    rows = files.read_trail(spark, f"{tmp_path}/*/trail.jsonl").orderBy("line_no").collect()
    assert [(r.run_id, r.seq, r.event) for r in rows] == [("r1", 1, "run-start"), ("r1", None, "x")]
    assert rows[0].ev_at == T0
    assert files.last_seq(files.read_trail(spark, f"{tmp_path}/*/trail.jsonl")).first()["last_seq"] == 0


def test_param_sets_name_the_bad_line(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a":1}\n\n[2]\n')
    with pytest.raises(Exception, match="line 3"):
        files.read_param_sets(spark, f"{tmp_path}/p.jsonl").collect()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"n": n, "pad": "x" * (n % 37)}) if n % 10 else "" for n in range(1, 4001)]
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n")
    lines[2776] = "[7]"
    (tmp_path / "bad.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_param_sets(spark, f"{tmp_path}/p.jsonl")
        assert spark.read.text(f"{tmp_path}/p.jsonl").rdd.getNumPartitions() > 10
        n = F.try_variant_get("params", "$.n", "int")
        assert got.count() == 3600 and got.filter(n != F.col("line_no")).count() == 0
        with pytest.raises(Exception, match="line 2777"):
            files.read_param_sets(spark, f"{tmp_path}/bad.jsonl").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_paths_are_empty(spark, tmp_path):
    assert files.read_trail(spark, f"{tmp_path}/none/*/trail.jsonl").count() == 0
    assert files.read_manifests(spark, f"{tmp_path}/none").count() == 0
    assert files.read_gates(spark, f"{tmp_path}/none").count() == 0
    assert files.read_appended(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="no parameter sets"):
        files.read_param_sets(spark, f"{tmp_path}/none.jsonl")


def test_failed_append_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda a, b: spark.range(a, b).selectExpr("'r' AS run_id", "id AS line_no", "'soon' AS at", "concat('e', id) AS event", "CAST(NULL AS STRING) AS node", "CAST(NULL AS STRING) AS data")
    assert files.append_trail(rows(0, 3), path, "a")
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, data, schema=None: (_ for _ in ()).throw(OSError("full")) if schema == "batch string" else spark.sql("SELECT CAST(NULL AS STRING) AS run_id, 0L AS last_seq WHERE false"))
        with pytest.raises(OSError, match="full"):
            files.append_trail(rows(3, 6), path, "b")
    assert files.read_appended(spark, path).count() == 3  # staged lines are there, but not committed
    assert files.append_trail(rows(3, 6), path, "b") and not files.append_trail(rows(3, 6), path, "b")
    assert files.append_trail(rows(6, 8), path, "c")
    got = files.read_appended(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.event) for r in got] == [(k + 1, f"e{k}") for k in range(8)]
    with pytest.raises(ValueError, match="not a batch's name"):
        files.append_trail(rows(0, 1), path, "../x")


def test_artifact_globs_are_those_of_pathlib(spark, tmp_path):
    runs = {"r1": ["a.json", "out/b.json", "out/deep/c.json", "out/deep/d.txt", "out/[x].json", "out/b1.json", "blue/x"], "r2": ["a.json", "z/a.json"]}
    for run, paths in runs.items():
        for path in paths:
            (tmp_path / run / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / run / path).write_text("x")
    there = files.run_paths(spark, str(tmp_path))
    assert sorted(map(tuple, there.collect())) == sorted((r, p) for r, ps in runs.items() for p in ps)
    globs = ["*.json", "**/*.json", "out/**", "out/*", "out/b*.json", "out/b?.json*", "out/[!b]*.json", "o*t/*/c*", "**/deep/*", "nothing/*", "out/[[]x]*"]
    plain = ["a.json", "./out//b.json", "gone.json", "out/[x].json"]
    declared = spark.createDataFrame([(r, g, g) for r in runs for g in globs + plain], "run_id string, artifact string, path string")
    got = [(r.run_id, r.artifact, r.path, r.present) for r in files.artifact_files(there, declared).collect()]
    want = []
    for run in runs:
        root = tmp_path / run
        for g in globs:
            pattern = f"{g}/*" if g.endswith("**") else g
            want += [(run, g, str(p.relative_to(root)), True) for p in root.glob(pattern) if p.is_file()]
        for g in plain:
            path = g.replace("./", "").replace("//", "/")
            want.append((run, g, path, (root / path).is_file()))
    assert sorted(got) == sorted(want) and got == sorted(got, key=lambda r: r[:3])
    for bad in ("/etc/x", "a/../b", "../*", ""):
        with pytest.raises(Exception, match="leaves the run's folder"):
            files.artifact_files(there, spark.createDataFrame([("r1", "x", bad)], "run_id string, artifact string, path string")).collect()


def trail(spark, rows):
    schema = "run_id long, line_no long, ev_at timestamp_ntz, event string, node string, exit_code int, decided_by string"
    return spark.createDataFrame([(r, n, T0 + dt.timedelta(seconds=s), e, node, code, by) for n, (r, s, e, node, code, by) in enumerate(rows)], schema)


def test_folds(spark):
    t = trail(
        spark,
        [
            (1, 0, "gate-pending", "a", None, None),
            (1, 5, "gate-pending", "a", None, None),
            (1, 10, "gate-answered", "a", None, "tty"),
            (1, 20, "run-halt", "a", 9, None),
            (1, 80, "step-done", "a", None, None),
            (1, 90, "run-done", None, None, None),
            (2, 0, "run-halt", None, 9, None),
            (3, 0, "gate-answered", "b", None, "flag"),
            (3, 9, "gate-pending", "b", None, None),
        ],
    )
    now = F.lit(T0 + dt.timedelta(seconds=1800)).cast("timestamp_ntz")
    assert {r.run_id: r.status for r in folds.run_status(t, now).collect()} == {1: "done", 2: "halted", 3: "gate"}
    assert [r.latency_s for r in folds.gate_latencies(folds.gates(t)).collect()] == [10.0]  # the pair below zero is left out
    s = folds.blocked_snapshot(t, now).first()
    assert (s.open_parks, s.oldest_s, s.resolved_parks, s.mean_park_s) == (1, 1800.0, 1, 60.0)
    h = folds.human_share(t).first()
    assert (h.human, h.machine, h.share) == (1, 0, 1.0)
    empty = t.limit(0)
    assert folds.human_share(empty).first().share is None
    assert folds.gate_latency(empty).first().n_gates == 0


def test_window_counts_all_events_of_a_run(spark):
    t = trail(spark, [(1, 0, "x", None, None, None), (1, 100, "x", None, None, None), (2, 0, "x", None, None, None)])
    assert folds.window_runs(t, F.lit(T0 + dt.timedelta(seconds=50)).cast("timestamp_ntz")).count() == 2


def test_circuit_counts_since_the_last_success(spark):
    t = trail(spark, [(1, k, e, None, c, None) for k, (e, c) in enumerate([("run-halt", 1), ("run-done", None), ("run-halt", 1), ("run-halt", 9), ("run-halt", 2), ("run-halt", None)])])
    r = folds.circuit(t).first()
    assert (r.failures, r.is_open) == (3, True)


def test_window_takes_runs_by_their_manifest(spark):
    t = trail(spark, [(1, 0, "x", None, None, None), (2, 0, "x", None, None, None), (3, 0, "x", None, None, None)])
    m = spark.createDataFrame([(1, "2026-07-03T10:01:00Z"), (2, "2026-07-03T09:00:00Z"), (3, "soon")], "run_id long, created_at string")
    assert [r.run_id for r in folds.window_runs(t, F.lit(T0 + dt.timedelta(seconds=50)).cast("timestamp_ntz"), m).collect()] == [1]


def test_lit_failures_leave_the_circuit_closed(spark):
    t = trail(spark, [(1, k, "run-halt", None, 1, None) for k in range(5)])
    r = folds.circuit(t.withColumn("dark", F.col("line_no") % 2 == 0)).first()
    assert r.failures == t.filter("line_no % 2 = 0").count() < 5
    assert not folds.circuit(t.withColumn("dark", F.lit(False))).first().is_open


def test_retries_and_reasoned_step_failures_are_fails(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    lines = [
        '{"event": "step-done", "node": "a"}',
        '{"event": "retry", "node": "a"}',
        '{"event": "step-fail", "node": "a", "data": {"validator_reasons": ["x", "y"]}}',
        '{"event": "step-fail", "node": "a", "data": {"validator_reasons": "x"}}',
        '{"event": "step-fail", "node": "a", "data": {"validator_reasons": []}}',
        '{"event": "step-fail", "node": "a"}',
        '{"event": "run-halt", "node": "a", "data": {"code": 3}}',
        '{"event": "retry", "node": 7}',
    ]
    (tmp_path / "r1/trail.jsonl").write_text("\n".join(lines))
    r = {r.node: r for r in folds.step_rates(files.read_trail(spark, f"{tmp_path}/*/trail.jsonl")).collect()}
    assert (r["a"].passes, r["a"].fails, r["a"].rate, r["a"].validated, r["a"].validator_rate) == (1, 3, 0.25, 0, 0.0)
    assert (r["?"].retries, r["?"].rate) == (1, 0.0)


def test_admission_in_order_of_its_rules(spark):
    rows = [(1, "a", "5", "inbox"), (2, "a", "5", "done"), (3, "b", "7", "inbox"), (4, "b", "6", "claim"), (5, "c", "v1", "inbox"), (6, "c", "9", "done"), (7, "D!", "1", "inbox")]
    items = spark.createDataFrame(rows, "item_no long, identity string, rev string, lane string")
    assert {r.item_no: r.disposition for r in ledger.admission(items).collect()} == {1: "skip", 3: "defer", 5: "admit", 7: "reject"}


def test_commit_only_behind_valid_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: stream.follow(spark, f"{tmp_path}/in", rows.schema)
    with pytest.raises(Exception, match="not valid"):
        stream.commit_after(source(), f"{tmp_path}/out", f"{tmp_path}/cp", valid=lambda b: False)
    assert stream.commit_after(source(), f"{tmp_path}/out", f"{tmp_path}/cp") >= 1
    assert stream.commit_after(source(), f"{tmp_path}/out", f"{tmp_path}/cp") == 0
    rows.withColumn("k", F.col("k") + 2).write.mode("append").parquet(f"{tmp_path}/in")
    stream.commit_after(source(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_file_order_decides_not_time(spark):
    """A halt written first stands after a run-done whose clock ran behind; a later line decides."""
    t = trail(spark, [(1, 10, "run-halt", "a", 9, None), (1, 5, "run-done", None, None, None), (2, 9, "run-done", None, None, None), (2, 1, "step-done", "a", None, None)])
    got = {r.run_id: (r.status, r.terminal) for r in folds.run_status(t, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got == {1: ("done", "run-done"), 2: ("running", "run-done")}
    assert [r.event for r in folds.node_latest(t).filter("run_id = 2 and node = 'a'").collect()] == ["step-done"]


def test_a_long_trail_keeps_its_order_when_it_is_split(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    lines = [f'{{"seq": {i}, "event": "{"run-done" if i % 2 else "run-halt"}", "data": {{"exit_code": 6}}}}' for i in range(1, 2001)]
    (tmp_path / "r1/trail.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        t = files.read_trail(spark, f"{tmp_path}/*/trail.jsonl")
        assert t.rdd.getNumPartitions() > 5
        assert [r.seq for r in t.orderBy("line_no").collect()] == list(range(1, 2001))
        assert folds.run_status(t, F.lit(T0).cast("timestamp_ntz")).first().waiting_kind == "needs_human"
        assert files.last_seq(t).first().last_seq == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifests_strict_and_lenient(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"run_id":"a","pipeline":"p","extra":1}\n{"run_id":"b","pi\n{"run_id":"c","params":{"x":"1"}}\n{"run_id":5,"pipeline":["x"]}\n')
    assert [r.run_id for r in files.read_manifests(spark, f"{tmp_path}/m.json").orderBy("run_id").collect()] == ["a", "c"]
    assert files.broken_manifests(spark, f"{tmp_path}/m.json").count() == 2
    with pytest.raises(Exception, match="malformed manifest|manifest without"):
        files.read_manifests(spark, f"{tmp_path}/m.json", strict=True).collect()
    good = '{"run_id":"a","pipeline":"p","created_at":"2026-07-03T10:00:00Z","status":"done"}\n'
    (tmp_path / "good.json").write_text(good)
    assert files.read_manifests(spark, f"{tmp_path}/good.json", strict=True).first().pipeline == "p"
    (tmp_path / "bad.json").write_text(good + '{"run_id":"b","pipeline":["x"],"created_at":"soon","status":"done"}\n')
    with pytest.raises(Exception, match="manifest without pipeline"):
        files.read_manifests(spark, f"{tmp_path}/bad.json", strict=True).collect()
    (tmp_path / "odd.json").write_text('{"run_id":"a","pipeline":["x"],"origin":7}\n')
    assert tuple(files.read_manifests(spark, f"{tmp_path}/odd.json").first())[:5] == ("a", None, None, None, None)


def stats_case(spark, tmp_path):
    """Three done runs and one that waits for a human; one trail without manifest; an unsigned gate file."""
    runs = {
        "a": ('ship', "trigger:inbox", [("step-done", "s", {"artifacts": []}), ("gate-pending", "g", {}), ("gate-answered", "g", {"by": "tty"}), ("run-done", None, {})]),
        "b": ("ship", "trigger:inbox", [("step-done", "s", {"artifacts": ["x"]}), ("retry", "s", {}), ("gate-answered", "h", {"by": "flag"}), ("run-done", None, {})]),
        "c": ("docs", None, [("run-halt", None, {"exit_code": 9}), ("run-done", None, {})]),
        "d": ("ship", None, [("gate-pending", "g", {}), ("run-halt", None, {"exit_code": 6})]),
        "e": (None, None, [("run-halt", None, {"exit_code": 9})]),
    }
    for name, (pipeline, origin, events) in runs.items():
        (tmp_path / name).mkdir()
        rows = [{"seq": n + 1, "at": f"2026-07-03T10:{n:02}:00.000Z", "event": e, "node": node, "data": data} for n, (e, node, data) in enumerate(events)]
        (tmp_path / name / "trail.jsonl").write_text("\n".join(map(json.dumps, rows)))
    docs = [{"run_id": n, "pipeline": p, "origin": o, "created_at": "2026-07-03T09:00:00Z"} for n, (p, o, _) in runs.items() if n != "e"]
    (tmp_path / "manifests.json").write_text("\n".join(map(json.dumps, docs)))
    decided = [{"run_id": "c", "gate": "k", "by": "tty", "verified": False, "mtime": "2026-07-03T10:00:00Z"}, {"run_id": "d", "gate": "g", "by": "tty", "verified": True, "at": "2026-07-03T10:00:30Z"}]
    (tmp_path / "gates.json").write_text("\n".join(map(json.dumps, decided)))
    return files.read_trail(spark, f"{tmp_path}/*/trail.jsonl"), files.read_manifests(spark, f"{tmp_path}/manifests.json"), files.read_gates(spark, f"{tmp_path}/gates.json")


def test_board_by_hand(spark, tmp_path):
    t, m, g = stats_case(spark, tmp_path)
    now = F.lit(dt.datetime(2026, 7, 3, 11, 0)).cast("timestamp_ntz")
    r = folds.board(t, m, g, now).first()
    assert (r.runs_scanned, r.completed, r.halted, r.passes, r.fails, r.validated, r.retries) == (4, 3, 1, 2, 1, 1, 1)
    assert (r.human, r.machine, r.other, r.share) == (1, 1, 1, 0.5)  # d's gate is of a run that is not done
    assert (r.n_gates, r.mean_s) == (2, 45.0)  # a after a minute; d by its file
    assert (r.open_parks, r.resolved_parks, r.total_park_s) == (0, 1, 60.0)
    assert r.days < 1 and r.per_day is None
    later = folds.board(t, m, g, F.lit(dt.datetime(2026, 7, 5, 10, 1)).cast("timestamp_ntz"), files.parse_since("2026-07-03T10:01:00Z")).first()
    assert (later.completed, later.days, later.per_day) == (3, 2.0, 1.5)
    assert {r.origin: r.completed for r in folds.throughput(t, m, "origin").collect()} == {"trigger:inbox": 2, "(none)": 1}
    assert {(r.pipeline, r.completed, r.halted) for r in folds.throughput(t, m, "pipeline").collect()} == {("ship", 2, 1), ("docs", 1, 0)}
    assert [r.run_id for r in folds.skipped_runs(t, m).collect()] == ["e"]
    shown = json.loads(folds.report(folds.board(t, m, g, now)).first().report)
    assert shown["schema_version"] == 2 and shown["snapshot"] == {"oldest_s": None, "open_parks": 0} and shown["window"]["completed"] == 3


def test_board_of_nothing(spark, tmp_path):
    t, m, g = stats_case(spark, tmp_path)
    r = folds.board(t.limit(0), m.limit(0), g.limit(0), F.lit(T0).cast("timestamp_ntz")).first()
    assert (r.runs_scanned, r.completed, r.n_gates, r.share, r.mean_s, r.per_day, r.step_rate) == (0, 0, 0, None, None, None, None)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 11, 60])
def test_ranks_are_exact(spark, n):
    rows = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
    r = folds.picked_ranks(rows, "x", {"med": ("(n + 1) div 2", "n div 2 + 1"), "p90": ("cast(ceil(n * 90 / 100) as bigint)",)}).first()
    values = sorted(float(i * i) for i in range(n))
    assert (r.n, r.med, r.p90) == (n, statistics.median(values), values[-(-n * 90 // 100) - 1])


def test_runs_that_cannot_be_judged_are_not_deleted(spark):
    day = lambda n: T0 - dt.timedelta(days=n)
    rows = [("a", day(9), "done", None), ("b", day(8), "done", None), ("c", day(1), "running", None), ("d", None, "done", None), ("e", day(9), "halted", 6), ("f", day(9), "halted", 8), ("g", day(9), "halted", 1)]
    runs = spark.createDataFrame([(r, "p", c, s, False, False, x) for r, c, s, x in rows], "run_id string, pipeline string, created_at timestamp_ntz, status string, pinned boolean, locked boolean, last_exit int")
    now = F.lit(T0).cast("timestamp_ntz")
    verdicts = lambda *a, **k: {r.run_id: r.verdict for r in folds.keep_plan(runs, now, *a, **k).collect()}
    got = verdicts(2, 5)
    assert got == {"a": "delete", "b": "retained", "c": "running", "d": "skipped", "e": "waiting", "f": "waiting", "g": "delete"}
    assert verdicts(2, 5, needs_human_too=True)["e"] == "delete"
    assert set(verdicts(None, None).values()) == {"retained", "running", "waiting"}
    assert [r.run_id for r in folds.gc_candidates(folds.keep_plan(runs, now, 2, 5)).collect()] == ["a", "g"]


def test_learnings_by_raw_text(spark, tmp_path):
    (tmp_path / "r").mkdir()
    rows = [("2026-07-03T10:00:00Z", "risk"), ("2026-07-03T09:00:00+02:00", ""), ("soon", "risk"), ("2026-07-03T11:00:00Z", None)]
    (tmp_path / "r/trail.jsonl").write_text("\n".join(json.dumps({"seq": n, "at": at, "event": "learn", "data": {"tag": tag, "note": "x"}}) for n, (at, tag) in enumerate(rows)))
    t, m = files.read_trail(spark, f"{tmp_path}/*/trail.jsonl"), spark.createDataFrame([], "run_id string, pipeline string")
    assert [r.seq for r in folds.learnings(t, m).collect()] == [1, 0, 3, 2]
    assert [r.seq for r in folds.learnings(t, m, "risk").collect()] == [0, 2]
    assert [r.seq for r in folds.learnings(t, m, "risk", files.parse_since("2026-07-03")).collect()] == [0]
    assert [r.tag for r in folds.tags(folds.learnings(t, m)).collect()] == ["risk"]
    with pytest.raises(Exception, match="soon"):
        t.filter(F.col("ev_at") >= files.parse_since("soon")).collect()


def test_append_numbers_on_and_redacts(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "2026-07-03T10:00:00Z", "learn", "s3cret", "s3cret-key"), ("r", 2, "soon", "run-done", None, None)], "run_id string, line_no long, at string, event string, node string, data string")
    for batch in ("one", "two", "one"):
        assert files.append_trail(rows, f"{tmp_path}/t", batch, ["s3cret", "s3cret-key"]) is (batch != "one" or files.committed(spark, f"{tmp_path}/t").count() == 1)
    got = files.read_appended(spark, f"{tmp_path}/t").orderBy("line_no").collect()
    assert [(r.seq, r.event, r.node, r.text) for r in got] == [(1, "learn", "***", "***"), (2, "run-done", None, None), (3, "learn", "***", "***"), (4, "run-done", None, None)]
    assert "s3cret" not in "".join(p.read_text() for p in (tmp_path / "t").rglob("*.txt"))


def test_inbox_scan(spark, tmp_path):
    for name in ("b.json", "a.json", ".hidden.json", "ledger-version", "c.txt"):
        (tmp_path / name).write_text("{}")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper/d.json").write_text("{}")
    assert [r.name for r in files.scan_inbox(spark, str(tmp_path), "*.json").collect()] == ["a.json", "b.json"]
    assert [r.name for r in files.scan_inbox(spark, str(tmp_path)).collect()] == ["a.json", "b.json", "c.txt"]


def test_parked_is_the_fold_over_arrivals(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for n in range(400):
        who, rev = f"i{rng.randrange(40)}", rng.choice(["1", "2", "3", "03", "10", "va", "vb"])
        rows.append((n, who, rev))
        held = want.get(who)
        if held and (held[1] == rev or held[1].isdigit() and rev.isdigit() and int(rev) <= int(held[1])):
            continue
        want[who] = (n, rev)
    items = spark.createDataFrame(rows, "item_no long, identity string, rev string")
    assert {r.identity: (r.item_no, r.rev) for r in ledger.parked(items).collect()} == want


def test_queue_rules_by_hand(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    old, new = T0 - dt.timedelta(hours=3), T0 - dt.timedelta(seconds=30)
    rows = [(1, "claim", "a", old), (2, "claim", "b", new), (3, "waiting", "a", old), (4, "failed", "c", old), (5, "done", "d", old), (6, "claim", "e", old)]
    items = spark.createDataFrame([(n, lane, i, "1", at) for n, lane, i, at in rows], "item_no long, lane string, identity string, rev string, updated_at timestamp_ntz")
    pointers = spark.createDataFrame([(3, "waiting"), (9, "failed")], "item_no long, lane string")
    leases = spark.createDataFrame([(6, old, 60, True), (1, old, 60, False)], "item_no long, claimed_at timestamp_ntz, ttl_s int, holder_alive boolean")
    none = spark.createDataFrame([], "identity string, reserved_at timestamp_ntz")
    issues = ledger.audit(items, pointers, leases, none, now)
    got = {(r.item_no, r.identity, r.issue) for r in issues.collect()}
    assert got == {(9, None, "pointer without item"), (1, "a", "item without pointer"), (4, "c", "item without pointer"), (1, "a", "claim without reservation"), (None, "a", "identity in two live lanes")}
    moved = {r.item_no: r.issues.count(";") + 1 for r in ledger.quarantined(items, issues).collect()}
    assert moved == {1: 3, 3: 1, 4: 1}
    runs = spark.createDataFrame([(1, "runs/1")], "item_no long, run_dir string")
    reaped = ledger.reaped(items.filter("lane = 'claim'").select("item_no"), leases, runs, now)
    assert {r.item_no: r.action for r in reaped.collect()} == {1: "waiting", 2: "stuck", 6: "flag"}
    state = ledger.lease_status(items.filter("lane = 'claim'"), leases, now).first()
    assert (state.lease_count, state.oldest_s, state.expired_live, state.missing_lease) == (2, 10800, 1, 1)
    assert [one(spark, ledger.lease_ttl(F.lit(c), F.lit(k))) for c, k in ((0, 4), (90, 1), (-1, 1), (-1, 2))] == [None, 90, None, 3600]


def test_retire_and_promote_by_hand(spark):
    claims = spark.createDataFrame([(1, "a", "5", 0, "7"), (2, "b", "5", 8, None), (3, "c", "5", 4, "7"), (4, "d", "5", None, None)], "item_no long, identity string, rev string, exit_code int, receipt_rev string")
    got = {r.item_no: (r.lane, r.tombstone, r.compared_rev) for r in ledger.retired(claims).collect()}
    assert got == {1: ("done", "a-r5", "7"), 2: ("waiting", None, None), 3: ("failed", "c-r5", "5"), 4: ("failed", "d-r5", "5")}
    assert {r.lane for r in ledger.retired(claims, "delete").filter("item_no = 1").collect()} == {"deleted"}
    parked = spark.createDataFrame([("a", 9, "6"), ("b", 8, "6"), ("c", 7, "v1")], "identity string, item_no long, rev string")
    assert {r.identity: r.action for r in ledger.promotion(parked, claims).collect()} == {"a": "drop", "b": "promote", "c": "promote"}


def test_retry_of_failed_items(spark):
    rows = [(1, "a", "5", "failed"), (2, "b", "5", "failed"), (3, "b", "6", "done"), (4, "c", "5", "failed"), (5, "c", "9", "claim"), (6, "d", "5", "failed"), (7, "e", "5", "failed"), (8, "e", "v2", "deferred"), (9, "f", "5", "failed"), (10, "f", "6", "deferred")]
    items = spark.createDataFrame(rows, "item_no long, identity string, rev string, lane string")
    pointers = spark.createDataFrame([(n, "failed", None if n == 6 else "r") for n in (1, 2, 4, 6, 7, 9)], "item_no long, lane string, run_dir string")
    none = spark.createDataFrame([], "identity string")
    assert {r.item_no: r.verdict for r in ledger.retryable(items, pointers, none).collect()} == {1: "retry", 2: "superseded", 4: "owned", 6: "no run", 7: "retry", 9: "owned"}


def test_presets_and_validators_that_are_missing_are_errors(spark):
    rows, presets = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert plans.with_dims(rows.filter("k = 'a'"), presets, "k").first().v == 1
    with pytest.raises(Exception, match="no preset for b"):
        plans.with_dims(rows, presets, "k").collect()
    with pytest.raises(KeyError):
        plans.validated(rows, "k", {}, ("nobody",))


def test_needs_come_from_earlier_groups(spark):
    rows = [(1, 1, "s1", "x", "a"), (1, 2, "s2", "a", "b"), (1, 2, "s3", "b", "c"), (1, 3, "s4", "c", "b")]
    steps = spark.createDataFrame(rows, "pipeline long, grp int, step string, needs string, produces string")
    assert {(r.step, r.needs) for r in plans.unmet_needs(steps).collect()} == {("s1", "x"), ("s3", "b")}
    assert plans.clashing_products(steps).count() == 0
    assert plans.clashing_products(steps.withColumn("produces", F.lit("z"))).first().steps == 2


def test_scalars_by_hand(spark):
    assert [one(spark, S.age_text(F.lit(n))) for n in (0, 89, 90, 5399, 5400, 7300)] == ["0s", "89s", "1m", "89m", "1h", "2h"]
    assert one(spark, S.error_tail(F.col("t")), t="\n a\nb \n") == "a\nb"
    assert one(spark, S.error_tail(F.col("t")), t="\n".join(map(str, range(30)))) == "\n".join(map(str, range(10, 30)))
    assert one(spark, F.length(S.error_tail(F.col("t"))), t="x" * 5000) == 2000
    assert one(spark, S.error_tail(F.col("t")), t=" \n ") is None
    assert one(spark, S.redacted_map(F.create_map(F.lit("key1"), F.lit("a"), F.lit("key2"), F.lit("key1 b")), ["key1", "key2"])) == {"***": "*** b"}
    assert one(spark, S.rendered("{slug(params.u)}{dash(params.v)} {short(params.v, -1)}", {"params.u": F.lit("www.a.org"), "params.v": F.lit("xyz")})) == "a-xyz xy"
    with pytest.raises(Exception, match="unknown look-up"):
        one(spark, S.write_back(F.lit("maybe")))
    assert one(spark, S.receipt_rev(F.col("a"), F.col("b")), a="{torn", b='{"rev":true,"checked_rev":7}') == "7"
    assert one(spark, S.receipt_rev(F.col("a"), F.col("b")), a="[]", b='{"rev":""}') is None
    assert one(spark, S.auth_failure(F.col("t"), F.lit(1)), t="Error: Not logged in") and not one(spark, S.auth_failure(F.col("t"), F.lit(0)), t="not logged in")
    assert one(spark, S.overlap_since(F.col("t")), t="2026-07-03T10:00:30Z") == "2026-07-03T09:59:30Z" and one(spark, S.overlap_since(F.col("t")), t="soon") == "soon"
    assert one(spark, S.cursor_of(F.col("t")), t='{"updated_at":"x"}') is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<<<STEP {"status":"done"} STEP>>>', '{"status":"done"}'),
        ('<<<STEP {"summary":"a } STEP>>> b"}\n<<<STEP {"status":"maybe"}', '{"summary":"a } STEP>>> b"}'),
        ('<<<STEP {"learnings":[{"tag":"x"}]}', None),
        ("<<<STEP [1]", None),
        (None, None),
        ("", None),
    ],
)
def test_last_valid_step_object(text, want):
    assert S.last_step(text) == want


def test_pull_pauses_at_a_full_spool(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    go = lambda bound: stream.pull(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/cp", bound)
    assert not go(1)["paused"] and spark.read.parquet(f"{tmp_path}/out").count() == 1
    rows.write.mode("append").parquet(f"{tmp_path}/in")
    assert go(1)["paused"] and spark.read.parquet(f"{tmp_path}/out").count() == 1  # the offset has stayed
    assert not go(0)["paused"] and spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_cursor_moves_only_by_a_cursor():
    old, new = '{"updated_at":"a","id":"1"}', '{"updated_at":"b","id":"2"}'
    assert stream.next_cursor(old, new) == (new, None) and stream.next_cursor(old, old) == (old, None)
    assert stream.next_cursor(old, " ") == (old, None) and stream.next_cursor(None, None) == (None, None)
    for garbage in ("{torn", "[1]", '{"updated_at":1,"id":"2"}'):
        assert stream.next_cursor(old, garbage)[0] == old and "stays" in stream.next_cursor(old, garbage)[1]


def test_windowed_counts_close_behind_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), "a") for m in (0, 1, 11, 40)], "at timestamp_ntz, k string")
    rows.write.parquet(f"{tmp_path}/in")
    out = stream.windowed_counts(stream.follow(spark, f"{tmp_path}/in", rows.schema), "at", "k", "10 minutes", "5 minutes")
    out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n_events for r in spark.table("windows").collect()) == [1, 1, 2]


def test_a_fetch_reports_bad_rows(spark):
    rows = spark.createDataFrame([(1, "b", 5.0), (2, "a", 6.0), (3, "c", 1.0)], "id long, at string, value double")
    good, bad = stream.isolated(rows, {"value": {"minimum": 5}})
    r = stream.poll_report(good, bad, "at", "id").first()
    assert (r.emitted, r.skipped, list(r.reasons), tuple(r.cursor)) == (2, 1, ["value: less than 5"], ("b", "1"))


@pytest.mark.parametrize("glob", ["", "*", "a*", "rm -rf [ab]?", "[!x]*.py", "a[", "[]]", "[a-c]z", "x.y", "a[b", "[!]]q", "\\\\*"])
def test_globs_are_those_of_the_shell(spark, glob):
    texts = ["", "a", "abc", "rm -rf ab", "rm -rf cb", "x.py", "y.py\n", "a[", "]", "bz", "x.y", "xzy", "a[b", "aq", "]q", "a\nb", "\\\\z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(S.glob_pattern(glob)).alias("hit")).collect()
    assert {r.t: r.hit for r in rows} == {t: fnmatch.fnmatchcase(t, glob) for t in texts}


def test_overlap_leaves_out_unreadable_times_only_behind_a_mark(spark):
    t = trail(spark, [(1, 0, "x", None, None, None), (1, 100, "x", None, None, None)]).unionByName(trail(spark, [(2, 0, "x", None, None, None)]).withColumn("ev_at", F.lit(None).cast("timestamp_ntz")))
    assert stream.overlapping(t, "ev_at", None).count() == 3
    assert stream.overlapping(t, "ev_at", F.lit(T0 + dt.timedelta(seconds=120)).cast("timestamp_ntz"), 60).count() == 1
