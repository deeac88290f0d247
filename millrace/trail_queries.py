"""Registered queries over trails: some over the view, some over files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import folds, ledger
from millrace.registry import LATE_TRAIL, NOW_RUNS, NOW_TRAIL, at, query
from millrace.sources import files
from millrace.sources import views as V
from millrace.sources.scratch import shared_dir
from millrace.streaming import follow as stream

_LAST = "arg_max_null({0}, line_no)"
_TERMINAL = "event IN ('run-done', 'run-halt')"


def stored_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trails, manifests, gate decisions and the runs of torn manifests, written as files and read back; run_id is a
    number again.
    """
    root = V.write_run_files(spark, d)
    number = lambda df: df.withColumn("run_id", F.col("run_id").cast("long"))
    return (
        number(files.read_trail(spark, f"{root}/trails")),
        number(files.read_manifests(spark, f"{root}/manifests")),
        number(files.read_gates(spark, f"{root}/gates")),
        number(files.broken_manifests(spark, f"{root}/manifests")).select("run_id").filter("run_id IS NOT NULL"),
    )


# What can be read back of the files: torn manifests are gone.
_M = "m AS (SELECT * FROM manifests WHERE run_id % 17 <> 4)"


_SKIPPED = "(SELECT DISTINCT run_id FROM trail WHERE run_id NOT IN (SELECT run_id FROM m) UNION SELECT run_id FROM manifests WHERE run_id % 17 = 4)"


def _ends(t: str) -> str:
    return f"(SELECT run_id, {_LAST.format('event')} AS terminal, {_LAST.format('exit_code')} AS exit_code FROM {t} WHERE {_TERMINAL} GROUP BY run_id)"


def _gates(t: str) -> str:
    return f"""(SELECT coalesce(a.run_id, f.run_id) AS run_id, coalesce(a.node, f.gate) AS gate, pending, coalesce(answered, f.decided_at, f.mtime) AS decided,
  coalesce(by_, CASE WHEN verified THEN f.decided_by END) AS decided_by, answered IS NOT NULL OR f.gate IS NOT NULL AS evidence
  FROM (SELECT run_id, node, arg_min(ev_at, line_no) FILTER (event = 'gate-pending' AND ev_at IS NOT NULL) AS pending,
    arg_max(ev_at, line_no) FILTER (event = 'gate-answered' AND ev_at IS NOT NULL) AS answered,
    arg_max(decided_by, line_no) FILTER (event = 'gate-answered' AND decided_by IS NOT NULL) AS by_
    FROM {t} WHERE node IS NOT NULL AND event IN ('gate-pending', 'gate-answered') GROUP BY ALL) a
  FULL JOIN (SELECT * FROM gate_files WHERE run_id IN (SELECT run_id FROM {t})) f ON a.run_id = f.run_id AND a.node = f.gate)"""


def _latency(t: str) -> str:
    return f"(SELECT (epoch_us(decided) - epoch_us(pending)) / 1e6 AS s FROM {_gates(t)} WHERE decided >= pending)"


def _share(t: str) -> str:
    return f"""(SELECT count(*) FILTER (d IN ('tty', 'external')) AS human, count(*) FILTER (d IN ('default', 'flag') OR d LIKE 'lane:%') AS machine,
  count(*) FILTER (d NOT IN ('tty', 'external', 'default', 'flag') AND d NOT LIKE 'lane:%') AS other
  FROM (SELECT coalesce(decided_by, '?') AS d FROM {_gates(t)} WHERE (evidence OR decided_by IS NOT NULL) AND run_id IN (SELECT run_id FROM {_ends(t)} WHERE terminal = 'run-done')))"""


def _parks(t: str) -> str:
    return f"""(SELECT run_id, line_no, nxt IS NOT NULL AS resolved, greatest(0, epoch_us(coalesce(nxt, TIMESTAMP '{NOW_TRAIL}')) - epoch_us(ev_at)) / 1e6 AS seconds
  FROM (SELECT *, lead(ev_at) OVER (PARTITION BY run_id ORDER BY line_no) AS nxt FROM {t}) WHERE event = 'run-halt' AND exit_code = 9 AND ev_at IS NOT NULL)"""


def _snapshot(t: str) -> str:
    return f"""(SELECT count(*) FILTER (NOT resolved) AS open_parks, round(max(seconds) FILTER (NOT resolved), 3) AS oldest_s,
  count(*) FILTER (resolved) AS resolved_parks, round(sum(seconds) FILTER (resolved), 3) AS total_park_s, round(avg(seconds) FILTER (resolved), 3) AS mean_park_s FROM {_parks(t)})"""


def _steps(t: str) -> str:
    return f"""(SELECT coalesce(node, '?') AS node, count(*) FILTER (event = 'step-done') AS passes,
  count(*) FILTER (event = 'retry' OR event = 'step-fail' AND len(reasons) > 0) AS fails, count(*) FILTER (event = 'step-done' AND len(artifacts) > 0) AS validated,
  count(*) FILTER (event = 'retry') AS retries FROM {t} GROUP BY 1)"""


def _per_day(t: str, start: str | None = None) -> str:
    begin = f"TIMESTAMP '{start}'" if start else "min(ev_at) FILTER (event = 'run-done')"
    return f"""(SELECT completed, round(days, 6) AS days, CASE WHEN days >= 1 AND completed > 0 THEN round(completed / days, 6) END AS per_day FROM (
  SELECT count(DISTINCT run_id) AS completed, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{NOW_TRAIL}') - epoch_us({begin})) / 86400e6) AS days
  FROM {t} WHERE run_id IN (SELECT run_id FROM {_ends(t)} WHERE terminal = 'run-done')))"""


@query("trail", "SELECT run_id, line_no, event, seq FROM trail WHERE seq > 20")
def trail_since(spark, d):
    return files.since(V.trail(spark, d), 20).select("run_id", "line_no", "event", "seq")


@query("trail", "SELECT run_id, count(*)::BIGINT AS n_events, max(seq)::BIGINT AS last_seq, count(ev_at) AS readable FROM trail GROUP BY run_id")
def trail_files(spark, d):
    """Trails written as files and read back: nothing but torn lines is lost, and the last offset is that of the last line."""
    t = stored_runs(spark, d)[0]
    counts = t.groupBy("run_id").agg(F.count("*").alias("n_events"), F.count("ev_at").alias("readable"))
    return counts.join(files.last_seq(t), "run_id")


_STATUS = f"""(SELECT run_id, CASE last WHEN 'gate-pending' THEN 'gate' WHEN 'run-halt' THEN 'halted' WHEN 'run-done' THEN 'done'
  ELSE CASE WHEN epoch_ms(TIMESTAMP '{NOW_TRAIL}') // 1000 - epoch_ms(last_at) // 1000 > 7200 THEN 'stale' ELSE 'running' END END AS status, terminal, exit_code,
  CASE WHEN terminal = 'run-halt' THEN CASE exit_code WHEN 6 THEN 'needs_human' WHEN 8 THEN 'capacity' WHEN 9 THEN 'blocked' END END AS waiting_kind, last_gate, last_at, n_events
FROM (SELECT run_id, {_LAST.format("event")} AS last, {_LAST.format("ev_at")} AS last_at, {_LAST.format("event")} FILTER ({_TERMINAL}) AS terminal,
  {_LAST.format("exit_code")} FILTER ({_TERMINAL}) AS exit_code, {_LAST.format("node")} FILTER (event = 'gate-pending') AS last_gate, count(*) AS n_events FROM trail GROUP BY run_id))"""


@query("trail", f"SELECT * EXCLUDE (last_at) FROM {_STATUS}")
def run_status(spark, d):
    return folds.run_status(V.trail(spark, d), at(NOW_TRAIL), 7200).drop("last_at")


@query("trail", f"SELECT * EXCLUDE (last_at) FROM {_STATUS}")
def run_status_of_files(spark, d):
    return folds.run_status(stored_runs(spark, d)[0], at(NOW_TRAIL), 7200).drop("last_at")


@query("trail manifests", f"""SELECT * FROM (SELECT run_id, pipeline, CASE WHEN s.status = 'gate' OR waiting_kind = 'needs_human' THEN 'answerable' WHEN waiting_kind IS NOT NULL THEN 'waiting_other' END AS kind,
  coalesce(greatest(0, epoch_ms(TIMESTAMP '{NOW_TRAIL}') // 1000 - epoch_ms(last_at) // 1000), 0) AS age_s, last_gate FROM {_STATUS} s JOIN manifests m USING (run_id)) WHERE kind IS NOT NULL""")
def inbox_cards(spark, d):
    return folds.inbox_cards(V.trail(spark, d), V.manifests(spark, d), at(NOW_TRAIL), 7200)


@query("trail", f"SELECT run_id, node, {_LAST.format('event')} AS event, max(line_no) AS line_no, min(line_no) AS first_line FROM trail GROUP BY run_id, node")
def node_latest(spark, d):
    return folds.node_latest(V.trail(spark, d))


_LATE = f"(SELECT run_id FROM trail WHERE ev_at >= TIMESTAMP '{LATE_TRAIL}' UNION SELECT run_id FROM manifests WHERE created_at >= TIMESTAMP '{LATE_TRAIL}')"


@query("trail manifests", f"SELECT run_id, count(*) AS n_events FROM trail t WHERE run_id IN {_LATE} GROUP BY run_id")
def window_runs(spark, d):
    return folds.window_runs(V.trail(spark, d), at(LATE_TRAIL), V.manifests(spark, d)).groupBy("run_id").agg(F.count("*").alias("n_events"))


def _by(what: str, default: str) -> str:
    return f"""SELECT coalesce({what}, '{default}') AS {what}, count(*) FILTER (terminal = 'run-done') AS completed, count(*) FILTER (terminal = 'run-halt') AS halted
  FROM {_ends("trail")} JOIN manifests USING (run_id) GROUP BY 1"""


@query("trail manifests", _by("pipeline", "?"))
def throughput_by_pipeline(spark, d):
    return folds.throughput(V.trail(spark, d), V.manifests(spark, d), "pipeline")


@query("trail manifests", _by("origin", "(none)"))
def throughput_by_origin(spark, d):
    return folds.throughput(V.trail(spark, d), V.manifests(spark, d), "origin")


@query("trail", f"SELECT *, round(passes / nullif(passes + fails, 0), 6) AS rate, round(validated / nullif(validated + fails, 0), 6) AS validator_rate FROM {_steps('trail')}")
def step_success(spark, d):
    return folds.step_rates(V.trail(spark, d))


@query("trail", f"SELECT node, retries FROM {_steps('trail')} WHERE retries > 0")
def retry_by_node(spark, d):
    return folds.step_rates(V.trail(spark, d)).filter("retries > 0").select("node", "retries")


@query("trail gate_files", f"SELECT count(*) AS n_gates, round(avg(s), 3) AS mean_s, round(median(s), 3) AS med_s, round(quantile_disc(s, 0.9), 3) AS p90_s FROM {_latency('trail')}")
def gate_latency(spark, d):
    return folds.gate_latency(V.trail(spark, d), V.gate_files(spark, d))


@query("trail gate_files", f"SELECT run_id, gate, decided_by, evidence, decided >= pending AS timed FROM {_gates('trail')}")
def gate_decisions(spark, d):
    return folds.gates(V.trail(spark, d), V.gate_files(spark, d)).select("run_id", "gate", "decided_by", "evidence", (F.col("decided") >= F.col("pending")).alias("timed"))


@query("trail gate_files", f"SELECT *, round(human / nullif(human + machine, 0), 6) AS share FROM {_share('trail')}")
def human_share(spark, d):
    return folds.human_share(V.trail(spark, d), V.gate_files(spark, d))


@query("trail", f"SELECT * FROM {_per_day('trail')}")
def per_day_rate(spark, d):
    return folds.per_day_rate(V.trail(spark, d), at(NOW_TRAIL))


@query("trail", f"SELECT * FROM {_parks('trail')}")
def blocked_parks(spark, d):
    return folds.blocked_parks(V.trail(spark, d), at(NOW_TRAIL))


@query("trail", f"SELECT * FROM {_snapshot('trail')}")
def blocked_snapshot(spark, d):
    return folds.blocked_snapshot(V.trail(spark, d), at(NOW_TRAIL))


@query("trail", f"SELECT run_id, line_no, round(seconds, 3) AS age_s FROM {_parks('trail')} WHERE NOT resolved")
def open_park_ages(spark, d):
    return folds.open_ages(V.trail(spark, d), at(NOW_TRAIL))


def _board(start: str | None) -> str:
    late = f"(SELECT run_id FROM trail WHERE ev_at >= TIMESTAMP '{start}' UNION SELECT run_id FROM manifests WHERE created_at >= TIMESTAMP '{start}')"
    where = f" AND run_id IN {late}" if start else ""
    return f""", {_M}, t AS (SELECT * FROM trail WHERE run_id IN (SELECT run_id FROM m){where})
SELECT (SELECT count(*) FROM m) AS runs_scanned, (SELECT count(*) FROM {_SKIPPED}) AS runs_skipped, (SELECT count(DISTINCT run_id) FROM t) AS runs_in_window, s.*, h.halted, p.*, g.*, q.*, round(q.human / nullif(q.human + q.machine, 0), 6) AS share, b.*,
  round(passes / nullif(passes + fails, 0), 6) AS step_rate, round(retries / nullif(completed, 0), 6) AS retries_per_run
FROM (SELECT sum(passes)::BIGINT AS passes, sum(fails)::BIGINT AS fails, sum(validated)::BIGINT AS validated, sum(retries)::BIGINT AS retries FROM {_steps("t")}) s,
  (SELECT count(*) FILTER (terminal = 'run-halt') AS halted FROM {_ends("t")}) h, {_per_day("t", start)} p,
  (SELECT count(*) AS n_gates, round(avg(s), 3) AS mean_s, round(median(s), 3) AS med_s, round(quantile_disc(s, 0.9), 3) AS p90_s FROM {_latency("t")}) g,
  {_share("t")} q, {_snapshot("t")} b"""


@query("trail manifests gate_files", _board(None))
def stats_board(spark, d):
    """All gauges over files."""
    t, m, g, torn = stored_runs(spark, d)
    return folds.board(t, m, g, at(NOW_TRAIL), broken=torn)


@query("trail manifests gate_files", _board(LATE_TRAIL))
def stats_since(spark, d):
    """All gauges of the runs in a window."""
    t, m, g, torn = stored_runs(spark, d)
    return folds.board(t, m, g, at(NOW_TRAIL), at(LATE_TRAIL), torn)


@query("trail manifests", f", {_M} SELECT * FROM {_SKIPPED}")
def skipped_runs(spark, d):
    t, m, _, torn = stored_runs(spark, d)
    return folds.skipped_runs(t, m, torn)


@query("trail manifests", f""", {_M} SELECT coalesce(t.run_id, m.run_id, b.run_id) AS run_id, CASE WHEN t.run_id IS NULL THEN 'skipped: no trail'
  WHEN b.run_id IS NOT NULL THEN 'no pipeline: manifest can''t be read' ELSE 'no pipeline: no manifest' END AS warning
FROM (SELECT DISTINCT run_id FROM trail WHERE run_id % 10 <> 7) t FULL JOIN m ON t.run_id = m.run_id FULL JOIN (SELECT run_id FROM manifests WHERE run_id % 17 = 4) b ON coalesce(t.run_id, m.run_id) = b.run_id
WHERE t.run_id IS NULL OR m.run_id IS NULL""")
def learning_warnings(spark, d):
    """Some trails are taken away, so that their runs have a manifest only."""
    t, m, _, torn = stored_runs(spark, d)
    return folds.learning_warnings(t.filter("run_id % 10 <> 7"), m, torn)


_PAGE = 1000  # ages of a report's page
_REPORT = "schema_version int, snapshot struct<ages_s array<double>, open_parks long, triggers map<string, struct<inbox long, inflight long>>>, window struct<by_node map<string, long>, by_origin map<string, long>, by_pipeline map<string, long>, halted long, runs_in_window long, runs_skipped long>"


@query("trail manifests gate_files items", f""", {_M}, t AS (SELECT * FROM trail WHERE run_id IN (SELECT run_id FROM m)), e AS (SELECT * FROM {_ends("t")} JOIN m USING (run_id) WHERE terminal = 'run-done')
SELECT 'ages_s' AS key, (row_number() OVER (ORDER BY seconds DESC) - 1)::VARCHAR AS name, round(round(seconds, 3) * 1000)::BIGINT AS value FROM {_parks("t")} WHERE NOT resolved
UNION ALL SELECT 'by_node', node, retries FROM {_steps("t")} WHERE retries > 0 UNION ALL SELECT 'by_pipeline', coalesce(pipeline, '?'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'by_origin', coalesce(origin, '(none)'), count(*) FROM e GROUP BY 2
UNION ALL SELECT 'triggers', 'p' || prio, count(*) FILTER (lane = 'inbox') * 1000000 + count(*) FILTER (lane IN ('claim', 'waiting')) FROM items GROUP BY 2
UNION ALL SELECT 'counts', 'halted', count(*) FROM {_ends("t")} WHERE terminal = 'run-halt' UNION ALL SELECT 'counts', 'runs_in_window', count(DISTINCT run_id) FROM t UNION ALL SELECT 'counts', 'runs_skipped', count(*) FROM {_SKIPPED}""")
def stats_report(spark, d):
    """The whole board as texts, with its maps, ages and triggers; then taken apart again."""
    t, m, g, torn = stored_runs(spark, d)
    depths = ledger.lane_depths(V.items(spark, d), ledger.read_pointers(V.pointers(spark, d)))
    triggers = depths.select(F.concat(F.lit("p"), F.col("prio").cast("string")).alias("name"), "inbox", "inflight")
    r = folds.full_report(t, m, g, at(NOW_TRAIL), broken=torn, triggers=triggers, page_ages=_PAGE).select("page", F.from_json("report", _REPORT).alias("r")).select("page", "r.*")
    entries = lambda key, column: r.select(F.lit(key).alias("key"), F.explode(column).alias("name", "value"))
    out = r.select(F.lit("ages_s").alias("key"), "page", F.posexplode("snapshot.ages_s").alias("p", "s")).select("key", (F.col("page").cast("long") * _PAGE + F.col("p")).cast("string").alias("name"), F.round(F.col("s") * 1000).cast("long").alias("value"))
    for name in ("by_node", "by_pipeline", "by_origin"):
        out = out.unionByName(entries(name, f"window.{name}"))
    out = out.unionByName(entries("triggers", "snapshot.triggers").withColumn("value", F.col("value.inbox") * 1_000_000 + F.col("value.inflight")))
    counts = F.create_map(*[x for c in ("halted", "runs_in_window", "runs_skipped") for x in (F.lit(c), F.col(f"window.{c}"))])
    return out.unionByName(r.filter("page = 0").select(F.lit("counts").alias("key"), F.explode(counts).alias("name", "value")))


@query("trail", f"""SELECT concat('{{"schema_version":2,"snapshot":{{"oldest_s":', coalesce(oldest_s::VARCHAR, 'null'), ',"open_parks":', open_parks, '}},"window":{{"resolved_parks":', resolved_parks, '}}}}') AS report FROM {_snapshot('trail')}""")
def stable_report(spark, d):
    row = folds.blocked_snapshot(V.trail(spark, d), at(NOW_TRAIL))
    return folds.report(row.select("open_parks", "oldest_s", "resolved_parks"))


@query("trail", f"""SELECT run_id, failures, failures >= 3 AS is_open FROM (SELECT run_id, arg_max(n, island) AS failures FROM (
SELECT run_id, island, count(*) FILTER (event = 'run-halt' AND dark AND coalesce(exit_code, 1) NOT IN (0, 6, 8, 9)) AS n FROM (
SELECT *, count(*) FILTER (event = 'run-done') OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM trail WHERE {_TERMINAL}) GROUP BY run_id, island) GROUP BY run_id)""")
def circuit_state(spark, d):
    return folds.circuit(V.trail(spark, d))


@query("trail", "SELECT run_id, coalesce(max(exit_code) FILTER (exit_code <> 0), 0) AS worst FROM trail GROUP BY run_id")
def worst_exit(spark, d):
    return folds.worst_exit(V.trail(spark, d))


@query("trail", """SELECT exit_code, CASE WHEN exit_code = 0 THEN 'DONE' WHEN exit_code IN (6, 8, 9) THEN 'WAITING' ELSE 'FAILED' END AS outcome,
  CASE exit_code WHEN 6 THEN 'needs_human' WHEN 8 THEN 'capacity' WHEN 9 THEN 'blocked' END AS waiting_kind, count(*) AS halts FROM trail WHERE event = 'run-halt' GROUP BY ALL""")
def exit_class(spark, d):
    rows = V.trail(spark, d).filter("event = 'run-halt'").groupBy("exit_code").agg(F.count("*").alias("halts"))
    return rows.withColumn("c", S.exit_class(F.col("exit_code"))).select("exit_code", "c.outcome", "c.waiting_kind", "halts")


_PLAN = f"""(SELECT run_id, pipeline, CASE WHEN pinned THEN 'pinned' WHEN last_exit IN (6, 8, 9) THEN 'waiting' WHEN status = 'running' THEN 'running' WHEN locked THEN 'locked'
  WHEN created_at IS NULL THEN 'skipped' WHEN r <= 50 OR epoch(TIMESTAMP '{NOW_RUNS}') - epoch(created_at) <= 90 * 86400 THEN 'retained' ELSE 'delete' END AS verdict
  FROM (SELECT *, CASE WHEN created_at IS NOT NULL THEN row_number() OVER (PARTITION BY pipeline ORDER BY created_at DESC NULLS LAST, run_id DESC) END AS r FROM runs))"""


@query("runs", f"SELECT *, CASE WHEN verdict = 'delete' THEN 'keep-days+keep-last' END AS reason FROM {_PLAN}")
def gc_plan(spark, d):
    return folds.keep_plan(V.runs(spark, d), at(NOW_RUNS), 50, 90)


@query("runs", f"SELECT run_id, pipeline, 'keep-days+keep-last' AS reason FROM {_PLAN} WHERE verdict = 'delete'")
def gc_candidates(spark, d):
    return folds.gc_candidates(folds.keep_plan(V.runs(spark, d), at(NOW_RUNS), 50, 90))


_LAST_OF = "SELECT run_id, '{1}' AS kind, seq, event, tag, note, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS place FROM (SELECT * FROM trail {0} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= {2})"


@query("trail", f"{_LAST_OF.format('', 'event', 12)} UNION ALL {_LAST_OF.format("WHERE event = 'learn'", 'learning', 5)}")
def trail_context(spark, d):
    return folds.trail_context(V.trail(spark, d)).select("run_id", "kind", "seq", "event", "tag", "note", "place")


_LEARNT = """SELECT run_id, pipeline, node, coalesce(strftime(ev_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'soon') AS at_raw, tag, note, seq::BIGINT AS seq
  FROM trail LEFT JOIN m USING (run_id) WHERE event = 'learn'"""


@query("trail manifests", f", {_M} {_LEARNT}")
def learnings(spark, d):
    t, m, *_ = stored_runs(spark, d)
    return folds.learnings(t, m)


@query("trail manifests", f", {_M} {_LEARNT} AND tag = 'risk' AND ev_at >= TIMESTAMP '2024-01-20 00:00:00'")
def learnings_of_a_tag(spark, d):
    t, m, *_ = stored_runs(spark, d)
    return folds.learnings(t, m, "risk", files.parse_since("2024-01-20"))


@query("trail", "SELECT DISTINCT tag FROM trail WHERE tag <> ''")
def learning_tags(spark, d):
    return folds.tags(V.trail(spark, d))


@query("trail", "SELECT DISTINCT run_id, node FROM trail WHERE event IN ('gate-pending', 'gate-answered')")
def gate_union(spark, d):
    t = V.trail(spark, d)
    return t.filter("event = 'gate-pending'").select("run_id", "node").unionByName(t.filter("event = 'gate-answered'").select("run_id", "node")).distinct()


@query("trail", "SELECT ev_at, line_no FROM trail WHERE ev_at IS NOT NULL ORDER BY ev_at DESC, line_no DESC LIMIT 1")
def highwater(spark, d):
    return stream.high_water(V.trail(spark, d).filter("ev_at IS NOT NULL"), "ev_at", "line_no")


@query("trail", f"SELECT run_id, line_no FROM trail WHERE ev_at >= TIMESTAMP '{LATE_TRAIL}' - INTERVAL 60 SECONDS")
def overlap_fetch(spark, d):
    """Two fetches that overlap: what the first has seen is not seen again."""
    t = V.trail(spark, d)
    again = stream.overlapping(t, "ev_at", at(LATE_TRAIL))
    return stream.unseen(again.unionByName(again), ["run_id", "line_no"]).select("run_id", "line_no")


@query("trail", "SELECT run_id, seq, 'user_' || event AS event, CASE WHEN node = 'n3' THEN '***' ELSE node END AS node FROM trail")
def appended_trail(spark, d):
    """Events appended in two calls, with a secret in them: offsets go on where the first call ended. A call that comes
    again changes nothing.
    """
    t = V.trail(spark, d)
    rows = t.select("run_id", "line_no", F.coalesce(F.col("ev_at").cast("string"), F.lit("soon")).alias("at"), F.concat(F.lit("user_"), "event").alias("event"), "node", F.lit("n3").alias("data"), "seq")
    path = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    for batch, part in (("first", "seq <= 10"), ("second", "seq > 10"), ("first", "seq <= 10")):
        files.append_trail(rows.filter(part).drop("seq"), path, batch, ["n3"])
    return files.read_appended(spark, path).select(F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("int").alias("seq"), "event", "node")


@query("", "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_follow(spark, d):
    """All events through a stream that commits batch by batch, then counted; only the counts leave."""
    out = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    schema = V.table(spark, d, "events").schema
    stream.commit_after(stream.follow(spark, f"{d}/events.parquet*", schema), f"{out}/rows", f"{out}/offsets")
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("users"))


@query("", "SELECT CASE WHEN value < 5 THEN 'value: less than 5' END AS reason, count(*) AS n_events FROM events GROUP BY 1")
def poison_isolation(spark, d):
    """Bad rows step aside with their reason, and the batch still ends."""
    good, bad = stream.isolated(V.table(spark, d, "events"), {"value": {"minimum": 5}})
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n_events"))
