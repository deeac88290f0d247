"""Registered queries over live trails and stores: files that are written step by step, and read as they come."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources import files, poll
from millrace.sources import views as V
from millrace.sources.scratch import shared_dir
from millrace.streaming import follow, live

STEPS, GRACE_S, LATE_H, KNOWN_D = 3, 43_200, 3, 2

#: The trail with the third of the events that a row belongs to.
_PARTS = f"p AS (SELECT *, least({STEPS - 1}, line_no * {STEPS} // (SELECT count(*) FROM events)) AS part FROM trail)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "events").count()
    return V.trail(spark, d).withColumn("part", F.least(F.lit(STEPS - 1), F.floor(F.col("line_no") * STEPS / F.lit(max(1, n)))).cast("int"))


def _stepped(spark: SparkSession, arriving: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> tuple[str, list[int]]:
    """Write the rows of each ``step`` as trail files and drain the stream behind it, started anew for every step; where
    the results are, by step, and how many rows came too late in each.
    """
    root, lost = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", []
    arriving = arriving.select("step", "run_id", "seq", V.trail_line().alias("value"))
    for step in range(STEPS):
        rows = arriving.filter(F.col("step") == step).repartition("run_id").sortWithinPartitions("run_id", "seq")
        rows.select("value").write.mode("append").text(f"{root}/in")
        lost.append(live.drained(stream(live.trail_stream(spark, f"{root}/in")), f"{root}/out/step={step}", f"{root}/offsets"))
    return f"{root}/out", lost


#: Every part's rows arrive in its step; some come again in the next one, and some of the first part in the last only.
_ARRIVING = f"""{_PARTS}, arriving AS (SELECT *, part AS step FROM p WHERE NOT (part = 0 AND k % 29 = 5)
  UNION ALL SELECT *, part + 1 FROM p WHERE part < {STEPS - 1} AND k % 4 = 0 AND NOT (part = 0 AND k % 29 = 5) UNION ALL SELECT *, {STEPS - 1} FROM p WHERE part = 0 AND k % 29 = 5),
placed AS (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY step, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM arriving),
fresh AS (SELECT * FROM placed WHERE seq > coalesce(prev, 0)),
told AS (SELECT *, count(*) FILTER (event IN ('run-done', 'run-halt')) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM fresh)"""


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    late = (F.col("part") == 0) & (F.col("k") % 29 == 5)
    again = p.filter(~late & (F.col("part") < STEPS - 1) & (F.col("k") % 4 == 0))
    return p.filter(~late).withColumn("step", F.col("part")).unionByName(again.withColumn("step", F.col("part") + 1)).unionByName(p.filter(late).withColumn("step", F.lit(STEPS - 1)))


def _followed(spark: SparkSession, d: str, stop: bool) -> DataFrame:
    out, _ = _stepped(spark, _arriving(spark, d), lambda events: live.followed(events, stop, "run_id string, seq long, event string, node string"))
    return spark.read.parquet(out).select(F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("int").alias("seq"), "event", "node", "step")


@query("trail", f", {_ARRIVING} SELECT run_id, seq, event, node, step FROM told")
def trail_follow(spark, d):
    """A trail that is followed in three steps, each from the last one's checkpoint: repeats and late lines are dropped."""
    return _followed(spark, d, stop=False)


@query("trail", f", {_ARRIVING} SELECT run_id, seq, event, node, step FROM told WHERE ended = 0")
def trail_follow_to_end(spark, d):
    """The same, and every run ends with its first terminal."""
    return _followed(spark, d, stop=True)


@query("trail", f""", {_PARTS}, now AS (SELECT step, max(ev_at) - INTERVAL {LATE_H} HOURS AS now FROM p, range({STEPS}) s(step) WHERE part <= step GROUP BY step)
SELECT step, run_id, CASE last WHEN 'gate-pending' THEN 'gate' WHEN 'run-halt' THEN 'halted' WHEN 'run-done' THEN 'done'
  ELSE CASE WHEN epoch_ms(now) // 1000 - epoch_ms(last_at) // 1000 > {GRACE_S} THEN 'stale' ELSE 'running' END END AS status
FROM (SELECT step, run_id, arg_max_null(event, line_no) AS last, arg_max_null(ev_at, line_no) AS last_at FROM p, range({STEPS}) s(step) WHERE part <= step GROUP BY ALL) JOIN now USING (step)""")
def stale_watch(spark, d):
    """Every run's status after each of three steps, as a stream with timers tells it."""
    out, _ = _stepped(spark, _parts(spark, d).withColumn("step", F.col("part")), lambda events: live.watched(events, GRACE_S, f"{LATE_H} hours"))
    changes = spark.read.parquet(out)
    after = changes.select(F.explode(F.sequence("step", F.lit(STEPS - 1))).alias("at_step"), "run_id", "change", "status")
    return after.groupBy(F.col("at_step").cast("long").alias("step"), F.col("run_id").cast("long").alias("run_id")).agg(F.max_by("status", "change").alias("status"))


@query("trail", f""", {_PARTS}, arriving AS (SELECT *, part AS step FROM p UNION ALL SELECT *, part + 1 FROM p WHERE part < {STEPS - 1} AND k % 4 = 0),
timed AS (SELECT * FROM arriving WHERE ev_at IS NOT NULL),
mark AS (SELECT s.step, to_timestamp(epoch_ms(max(ev_at)) / 1000) AT TIME ZONE 'UTC' - INTERVAL {KNOWN_D} DAYS AS mark FROM timed t, range({STEPS}) s(step) WHERE t.step < s.step GROUP BY s.step),
told AS (SELECT timed.*, coalesce(ev_at <= mark, false) AS lost FROM timed LEFT JOIN mark USING (step))
SELECT run_id, min(seq) AS seq, min(step) AS step, (SELECT count(*) FROM told WHERE lost) AS lost FROM told WHERE NOT lost GROUP BY run_id, line_no""")
def overlap_stream(spark, d):
    """Rows that are fetched again in the next step: those within two days count once, older ones are lost."""
    p = _parts(spark, d)
    again = p.filter((F.col("part") < STEPS - 1) & (F.col("k") % 4 == 0)).withColumn("step", F.col("part") + 1)
    arriving = p.withColumn("step", F.col("part")).unionByName(again)
    out, lost = _stepped(spark, arriving, lambda events: live.once_within(events, ["run_id", "seq"], "ev_at", f"{KNOWN_D} days").select("run_id", "seq"))
    rows = spark.read.parquet(out).select(F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("int").alias("seq"), F.col("step").cast("long").alias("step"))
    return rows.withColumn("lost", F.lit(sum(lost)).cast("long"))


_LOG_LINES = "(SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS log FROM documents GROUP BY source)"


@query("", f"""SELECT source, strlen(log) AS size, CASE WHEN strlen(log) <= {files.TAIL_BYTES} OR strlen(last) + strlen(log) - strlen(cut) < {files.TAIL_BYTES} THEN trim(last) ELSE '' END AS last_line, least(strlen(log), {files.TAIL_BYTES}) AS bytes_read
FROM (SELECT *, string_split(cut, chr(10))[-1] AS last FROM (SELECT *, rtrim(log, ' ' || chr(10)) AS cut FROM {_LOG_LINES}))""")
def log_tails(spark, d):
    """A log for every source of documents, and the end of each: as many bytes are read of a long log as of a short one."""
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    docs = V.table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(root)
    rows = files.log_tails(spark, root, "*.txt")
    return rows.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "size", "last_line", "bytes_read")


#: Patterns of artifacts, and the same as conditions on a file's path.
GLOBS = [("out/*", "p LIKE 'out/%' AND p NOT LIKE 'out/%/%'"), ("out/**", "p LIKE 'out/%'"), ("**/s[1-3]*.json", "regexp_matches(p, '(^|/)s[1-3][^/]*[.]json$')"), ("*/?/s5.json", "regexp_matches(p, '^[^/]+/[^/]/s5[.]json$')"), ("**/s[!0]?.json", "regexp_matches(p, '(^|/)s[^0/][^/][.]json$')"), ("none/*", "false")]


@query("", f"""WITH f AS (SELECT DISTINCT l_orderkey AS run_id, CASE WHEN l_linenumber = 1 THEN 'out/s' ELSE 'out/' || l_linenumber || '/s' END || (l_suppkey % 15) || '.json' AS p FROM lineitem)
SELECT run_id, artifact, path, present FROM (SELECT run_id, '{GLOBS[0][0]}' AS artifact, p AS path, true AS present FROM f WHERE {GLOBS[0][1]} {" ".join(f"UNION ALL SELECT run_id, '{g}', p, true FROM f WHERE {c}" for g, c in GLOBS[1:])}
UNION ALL SELECT r.run_id, 'plain', 'out/s3.json', f.p IS NOT NULL FROM (SELECT DISTINCT run_id FROM f) r LEFT JOIN f ON f.run_id = r.run_id AND f.p = 'out/s3.json')""")
def artifact_globs(spark, d):
    """Orders as runs, their lines as files: what patterns and a plain path name in each."""
    n = F.col("l_linenumber").cast("string")
    path = F.concat(F.when(F.col("l_linenumber") == 1, "out/s").otherwise(F.concat(F.lit("out/"), n, F.lit("/s"))), (F.col("l_suppkey") % 15).cast("string"), F.lit(".json"))
    there = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), path.alias("path"))
    told = F.array(*[F.struct(F.lit(g).alias("artifact"), F.lit(g).alias("path")) for g, _ in GLOBS], F.struct(F.lit("plain").alias("artifact"), F.lit("./out//s3.json").alias("path")))
    declared = there.select("run_id").distinct().select("run_id", F.inline(told))
    return files.artifact_files(there, declared)


@query("", "SELECT c_custkey, true AS in_order FROM customer")
def param_sets(spark, d):
    """Customers as parameter files of a batch, blank lines among them; lines are numbered in each file, whatever its splits."""
    path = f"{shared_dir(spark)}/params-{uuid.uuid4().hex}"
    c = V.table(spark, d, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    c.select(F.concat(F.to_json(F.struct("c_custkey", F.spark_partition_id().alias("part"))), F.when(F.col("c_custkey") % 3 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    rows = files.read_param_sets(spark, path).select("line_no", F.try_variant_get("params", "$.c_custkey", "long").alias("c_custkey"), F.try_variant_get("params", "$.part", "int").alias("part"))
    first = rows.groupBy("part").agg(F.min("c_custkey").alias("first"))
    blank = lambda n: F.floor((n + 2) / 3)  # noqa: E731  multiples of three below n
    want = F.col("c_custkey") - F.col("first") + blank(F.col("c_custkey")) - blank(F.col("first")) + 1
    return rows.join(F.broadcast(first), "part").select("c_custkey", (F.col("line_no") == want).alias("in_order"))


@query("manifests", "SELECT run_id, pipeline, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, status, origin FROM manifests WHERE pipeline IS NOT NULL AND created_at IS NOT NULL")
def manifests_strict(spark, d):
    """Manifests that have all they must, read in the way that takes no others."""
    path = f"{shared_dir(spark)}/strict-{uuid.uuid4().hex}"
    m = V.manifests(spark, d).filter("pipeline IS NOT NULL AND created_at IS NOT NULL")
    V.manifest_line(m).write.text(path)
    return files.read_manifests(spark, path, strict=True).select(F.col("run_id").cast("long").alias("run_id"), "pipeline", "created_at", "status", "origin")


@query("", "SELECT event_type, count(*) AS n_events, true AS paused FROM events GROUP BY event_type")
def back_pressure(spark, d):
    """Events are pulled to a spool; the next pull pauses, since the spool is full, and reads nothing."""
    out = f"{shared_dir(spark)}/pull-{uuid.uuid4().hex}"
    schema = V.table(spark, d, "events").schema
    told = [follow.pull(spark, f"{d}/events.parquet*", schema, f"{out}/rows", f"{out}/offsets", inbox_max=1) for _ in range(2)]
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n_events")).withColumn("paused", F.lit(not told[0]["paused"] and told[1]["paused"]))


POLLED = "id string, updated_at string, event_type string, value double"


@query("", """WITH e AS (SELECT printf('%09d', event_id) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at, event_type, value, event_id % 7 = 3 AND event_id * 2 < (SELECT count(*) FROM events) AS late FROM events),
first AS (SELECT max(updated_at) AS mark FROM e WHERE NOT late AND id < printf('%09d', (SELECT count(*) // 2 FROM events)))
SELECT id, updated_at, event_type, value, CASE WHEN NOT late AND id < printf('%09d', (SELECT count(*) // 2 FROM events)) THEN 1 ELSE 2 END AS call
FROM e, first WHERE NOT late OR updated_at >= strftime(strptime(mark, '%Y-%m-%dT%H:%M:%S.%fZ') - INTERVAL 600 SECONDS, '%Y-%m-%dT%H:%M:%S.%fZ')""")
def polled_rows(spark, d):
    """Two polls of a folder that grows between them, each from the last cursor, in bounded batches; of rows that come late
    those within ten minutes are still found, and what comes again counts once.
    """
    root = f"{shared_dir(spark)}/polled-{uuid.uuid4().hex}"
    events = V.table(spark, d, "events")
    n = events.count()
    e = events.select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_at"), "event_type", "value", "event_id")
    late, half = (F.col("event_id") % 7 == 3) & (F.col("event_id") * 2 < n), F.col("event_id") < n // 2
    spark.dataSource.register(poll.PollSource)
    mark = None
    for call, part in ((1, half & ~late), (2, ~half | late)):
        e.filter(part).drop("event_id").write.mode("append").parquet(f"{root}/in")
        mark = poll.fetched(spark, f"{root}/in", POLLED, f"{root}/out/call={call}", f"{root}/offsets", mark, max(1, n // 6), 600)
    rows = spark.read.schema(f"{POLLED}, call int").parquet(f"{root}/out")
    return rows.groupBy("id", "updated_at", "event_type", "value").agg(F.min("call").alias("call"))
