"""Deterministic projections of the driver's tables into trails, runs, queues, plans, artifacts and turns.

The test tables hold no trails, so every operator runs over these views. Each has a SQL twin of the same name in
``SQL``, which the oracles use as common table expressions; both are written in the dialect that Spark and DuckDB share
as far as that goes. ``write_run_files`` stores the same events as trail, manifest and gate files, so that queries can
read real files back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import shared_dir

DECIDERS = ("tty", "external", "default", "flag", "lane:x")  # fixed values: who answers a gate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, n: Column) -> Column:
    """The n-th of fixed values, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


#: Which event of a trail a row stands for, by its type and the number in its props.
EVENT = """CASE event_type WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN 'learn' ELSE 'step-done' END
  WHEN 'click' THEN CASE WHEN k % 4 = 3 THEN 'retry' ELSE 'gate-pending' END
  WHEN 'signup' THEN 'gate-answered' WHEN 'purchase' THEN 'run-done'
  ELSE CASE WHEN k % 3 = 2 THEN 'step-fail' ELSE 'run-halt' END END"""
NODE = "CASE WHEN k % 13 = 12 THEN NULL ELSE concat('n', CAST(k % 7 AS {text})) END"


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event. File order is ``line_no``; some times run backwards, some can't be read (null).

    run_id, line_no, seq (from 1 by run), ev_at, event, node, exit_code (of halts), decided_by, reasons, artifacts (of
    finished steps), tag, note, dark, k.
    """
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    k = F.col("k")
    rows = rows.withColumn("event", F.expr(EVENT))
    is_ = F.col("event").__eq__
    return rows.select(
        "run_id",
        "line_no",
        F.expr("row_number() OVER (PARTITION BY run_id ORDER BY line_no)").alias("seq"),
        F.when(k == 98, None).when(k % 9 == 0, F.col("ts") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts")).alias("ev_at"),
        "event",
        F.expr(NODE.format(text="string")).alias("node"),
        F.when(is_("run-halt"), k % 10).alias("exit_code"),
        F.when(is_("gate-answered") & (k % 17 != 0), pick(DECIDERS, k % 5)).alias("decided_by"),
        F.when(is_("retry") | (is_("step-fail") & (k % 2 == 0)), F.array(F.concat(F.lit("exit "), k.cast("string")))).alias("reasons"),
        F.when(is_("step-done"), F.when(k % 2 == 0, F.array(F.lit("a.json"))).otherwise(F.array().cast("array<string>"))).alias("artifacts"),
        F.when(is_("learn"), pick(("risk", "idea", ""), k % 3)).alias("tag"),
        F.when(is_("learn"), F.concat(F.lit("seen "), k.cast("string"))).alias("note"),
        (k % 4 != 1).alias("dark"),
        "k",
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, pipeline, origin, created_at, status of the runs that have a manifest; a seventh of the runs has none."""
    n = F.col("run_id")
    runs_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct().filter("run_id % 7 <> 3")
    return runs_.select(
        "run_id",
        F.when(n % 11 != 5, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("pipeline"),
        F.when(n % 3 != 0, F.concat(F.lit("trigger:t"), (n % 3).cast("string"))).alias("origin"),
        F.when(n % 13 != 6, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(run_id * 5 AS int))")).alias("created_at"),
        pick(("done", "halted", "running"), n % 3).alias("status"),
    )


def gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, gate, decided_by, verified, decided_at (may be null), mtime: decisions that are kept as files."""
    asked = trail(spark, sf_dir).filter("event = 'gate-pending' AND k % 6 = 0 AND node IS NOT NULL AND ev_at IS NOT NULL")
    rows = asked.groupBy("run_id", F.col("node").alias("gate")).agg(F.min("ev_at").alias("t"), F.max("k").alias("m"))
    return rows.select(
        "run_id",
        "gate",
        pick(DECIDERS, F.col("m") % 5).alias("decided_by"),
        (F.col("m") % 4 != 0).alias("verified"),
        F.when(F.col("m") % 5 != 2, F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("decided_at"),
        (F.col("t") + F.expr("INTERVAL 2 HOURS")).alias("mtime"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, pipeline, created_at (some null), status, pinned, locked, last_exit."""
    n = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "halted").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        n.alias("run_id"),
        F.col("o_orderpriority").alias("pipeline"),
        F.when(n % 101 != 7, F.col("o_orderdate")).alias("created_at"),
        status.alias("status"),
        (n % 97 == 0).alias("pinned"),
        (n % 89 == 0).alias("locked"),
        F.when(F.col("o_orderstatus") == "O", (n % 12).cast("int")).alias("last_exit"),
    )


LANES = ("inbox", "claim", "waiting", "failed", "done", "deferred")  # fixed values
FRESH_AT = "2001-08-31 23:30:00"  # when the fresh ones of the leases were taken, half an hour before the queries' now


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_no, name, prio, source, identity (by customer), rev, updated_at, lane. item_no is the order of arrival. Some
    names keep to no grammar, some deferred items have the name of one in the inbox, and a tenth of the identities is never
    live.
    """
    n = F.col("o_orderkey")
    rev = F.when(n % 11 == 0, F.concat(F.lit("v"), (n % 50).cast("string"))).otherwise((n * 7919 % 1000).cast("string"))
    cust = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        n.alias("item_no"),
        F.when((n % 60).isin(0, 5), F.concat(F.lit("p5-order-g"), F.floor(n / 60).cast("string"), F.lit("-r1.json")))
        .otherwise(F.concat(F.when(n % 37 == 0, "P").otherwise("p"), (n % 10).cast("string"), F.lit("-order-"), cust, F.lit("-r"), rev, F.lit(".json")))
        .alias("name"),
        (n % 10).cast("int").alias("prio"),
        F.lit("order").alias("source"),
        F.concat(F.lit("order-"), cust).alias("identity"),
        rev.alias("rev"),
        F.col("o_orderdate").alias("updated_at"),
        F.when((F.col("o_custkey") % 10 == 0) & (n % 6).isin(1, 2), "done").otherwise(pick(LANES, n % 6)).alias("lane"),
        (n % 150).alias("run_id"),
    )


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_no, lane, body: pointer files as text; some are torn, some items have none, some pointers have no item."""
    n = F.col("item_no")
    body = F.when(n % 19 == 0, '{"run_dir": "ru').otherwise(
        F.concat(F.lit('{"run_dir":"runs/'), F.col("run_id").cast("string"), F.lit('","exit_code":'), pick(("6", "8", "9", "1", "null"), n % 5), F.lit("}"))
    )
    own = items(spark, sf_dir).filter("lane IN ('claim', 'waiting', 'failed') AND item_no % 8 <> 1").select("item_no", "lane", body.alias("body"))
    stray = items(spark, sf_dir).filter("lane = 'inbox' AND item_no % 31 = 0").select("item_no", F.lit("waiting").alias("lane"), body.alias("body"))
    return own.unionByName(stray)


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_no, claimed_at, ttl_s, holder_alive of claims; some claims have no lease."""
    n = F.col("item_no")
    rows = items(spark, sf_dir).filter("lane = 'claim' AND item_no % 5 <> 0")
    fresh = F.lit(FRESH_AT).cast("timestamp_ntz")
    return rows.select("item_no", F.when(n % 7 == 2, fresh).otherwise(F.col("updated_at")).alias("claimed_at"), F.lit(3600).alias("ttl_s"), (n % 4 == 1).alias("holder_alive"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many more runs may start, which is what the pool holds less what living holders of fresh leases use."""
    used = leases(spark, sf_dir).agg(F.count_if(F.col("holder_alive") & (F.col("claimed_at") == F.lit(FRESH_AT).cast("timestamp_ntz"))).alias("used"))
    pool = table(spark, sf_dir, "customer").agg(F.floor(F.count("*") / 4).alias("size"))
    return pool.join(F.broadcast(used)).select(F.greatest(F.lit(0), F.col("size") - F.col("used")).cast("int").alias("free"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity, reserved_at: one row an identity, for four fifths of the customers that ever ordered."""
    rows = items(spark, sf_dir).groupBy("identity").agg(F.max("updated_at").alias("reserved_at"), F.max("item_no").alias("_n"))
    return rows.filter("_n % 5 <> 0").drop("_n")


def receipts(spark: SparkSession, sf_dir: str, lane: str = "done") -> DataFrame:
    """item_no of a lane's items and the bodies of up to three receipt files and the run's manifest, as text."""
    n = F.col("item_no")
    text = n.cast("string")
    rows = items(spark, sf_dir).filter(F.col("lane") == lane)
    return rows.select(
        "item_no",
        "identity",
        "rev",
        F.when(n % 4 == 0, F.concat(F.lit('{"checked_rev":"'), text, F.lit('"}'))).when(n % 4 == 2, F.lit("{torn")).alias("receipt_1"),
        F.when(n % 3 == 0, F.concat(F.lit('{"rev":'), text, F.lit("}"))).alias("receipt_2"),
        F.when(n % 7 == 0, F.lit('{"rev":"","delivered_rev":"d7"}')).alias("receipt_3"),
        F.when(n % 2 == 0, F.concat(F.lit('{"receipt_rev":"m'), text, F.lit('"}'))).otherwise(F.lit("{}")).alias("manifest"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pipeline, pos, step, grp (steps of one group run side by side), needs and produces: plans as rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pipeline"),
        F.col("l_linenumber").alias("pos"),
        F.expr("concat('s', cast(l_linenumber AS string))").alias("step"),
        F.expr("(l_linenumber + 1) div 2").cast("int").alias("grp"),
        F.expr("concat('a', cast(l_suppkey % 5 AS string))").alias("needs"),
        F.expr("concat('a', cast(l_partkey % 5 AS string))").alias("produces"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars, quality, toxic: documents with their labels, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def trail_line() -> Column:
    """A row of ``trail`` as it stands in a trail file."""
    data = F.struct("exit_code", F.col("decided_by").alias("by"), F.col("reasons").alias("validator_reasons"), "artifacts", "tag", "note", "dark")
    at = F.coalesce(F.date_format("ev_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("soon"))
    return F.to_json(F.struct(F.lit(1).alias("v"), "seq", at.alias("at"), F.col("run_id").cast("string").alias("run_id"), "event", "node", data.alias("data")))


def manifest_line(m: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``manifests`` as they stand in a file (value), with other columns beside."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    return m.select(*columns, F.to_json(F.struct(F.col("run_id").cast("string").alias("run_id"), "pipeline", at, "status", "origin")).alias("value"))


def write_run_files(spark: SparkSession, sf_dir: str) -> str:
    """Store the views trail, manifests and gate_files as JSON lines, torn lines among them; returns the folder.

    A run's lines stand in one file, in order; files hold many runs, so their number does not grow with the runs.
    """
    out = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    t = trail(spark, sf_dir)
    line = trail_line()
    torn = F.when(F.col("k") == 50, F.concat(line, F.lit('\n{"seq": 9, "eve'))).when(F.col("k") == 51, F.concat(F.lit("\n"), line)).otherwise(line)
    t.select("run_id", "line_no", torn.alias("value")).repartition("run_id").sortWithinPartitions("run_id", "line_no").select("value").write.text(f"{out}/trails")
    m = manifest_line(manifests(spark, sf_dir), "run_id")
    m.select(F.when(F.col("run_id") % 17 == 4, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value")).write.text(f"{out}/manifests")
    g = gate_files(spark, sf_dir)
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    g.select(F.to_json(F.struct(F.col("run_id").cast("string").alias("run_id"), "gate", F.col("decided_by").alias("by"), "verified", when("decided_at").alias("at"), when("mtime").alias("mtime"))).alias("value")).write.text(f"{out}/gates")
    return out


_deciders = ", ".join(f"'{d}'" for d in DECIDERS)
_lanes = ", ".join(f"'{x}'" for x in LANES)
SQL = {
    "trail": f"""trail AS (SELECT run_id, line_no, row_number() OVER (PARTITION BY run_id ORDER BY line_no)::INTEGER AS seq,
  CASE WHEN k = 98 THEN NULL WHEN k % 9 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END AS ev_at, event, {NODE.format(text="VARCHAR")} AS node,
  CASE WHEN event = 'run-halt' THEN k % 10 END AS exit_code, CASE WHEN event = 'gate-answered' AND k % 17 <> 0 THEN [{_deciders}][k % 5 + 1] END AS decided_by,
  CASE WHEN event = 'retry' OR event = 'step-fail' AND k % 2 = 0 THEN ['exit ' || k] END AS reasons,
  CASE WHEN event = 'step-done' THEN CASE WHEN k % 2 = 0 THEN ['a.json'] ELSE [] END END AS artifacts,
  CASE WHEN event = 'learn' THEN ['risk', 'idea', ''][k % 3 + 1] END AS tag, CASE WHEN event = 'learn' THEN 'seen ' || k END AS note, k % 4 <> 1 AS dark, k
  FROM (SELECT *, {EVENT} AS event FROM (SELECT user_id AS run_id, event_id AS line_no, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""",
    "manifests": """manifests AS (SELECT run_id, CASE WHEN run_id % 11 <> 5 THEN 'p' || (run_id % 4) END AS pipeline, CASE WHEN run_id % 3 <> 0 THEN 'trigger:t' || (run_id % 3) END AS origin,
  CASE WHEN run_id % 13 <> 6 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours((run_id * 5)::INTEGER) END AS created_at, ['done', 'halted', 'running'][run_id % 3 + 1] AS status
  FROM (SELECT DISTINCT user_id AS run_id FROM events) WHERE run_id % 7 <> 3)""",
    "gate_files": f"""gate_files AS (SELECT run_id, gate, [{_deciders}][m % 5 + 1] AS decided_by, m % 4 <> 0 AS verified, CASE WHEN m % 5 <> 2 THEN t + INTERVAL 1 HOUR END AS decided_at, t + INTERVAL 2 HOURS AS mtime
  FROM (SELECT run_id, node AS gate, min(ev_at) AS t, max(k) AS m FROM trail WHERE event = 'gate-pending' AND k % 6 = 0 AND node IS NOT NULL AND ev_at IS NOT NULL GROUP BY ALL))""",
    "runs": """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS pipeline, CASE WHEN o_orderkey % 101 <> 7 THEN o_orderdate END AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'halted' ELSE 'running' END AS status, o_orderkey % 97 = 0 AS pinned, o_orderkey % 89 = 0 AS locked,
  CASE WHEN o_orderstatus = 'O' THEN (o_orderkey % 12)::INTEGER END AS last_exit FROM orders)""",
    "items": f"""items AS (SELECT item_no, CASE WHEN item_no % 60 IN (0, 5) THEN 'p5-order-g' || (item_no // 60) || '-r1.json' ELSE CASE WHEN item_no % 37 = 0 THEN 'P' ELSE 'p' END || (item_no % 10) || '-order-' || cust || '-r' || rev || '.json' END AS name, (item_no % 10)::INTEGER AS prio, 'order' AS source, 'order-' || cust AS identity, rev, updated_at,
  CASE WHEN never AND item_no % 6 IN (1, 2) THEN 'done' ELSE [{_lanes}][item_no % 6 + 1] END AS lane, item_no % 150 AS run_id FROM (SELECT o_orderkey AS item_no, 'c' || o_custkey AS cust, o_custkey % 10 = 0 AS never, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 11 = 0 THEN 'v' || (o_orderkey % 50) ELSE (o_orderkey * 7919 % 1000)::VARCHAR END AS rev FROM orders))""",
    "pointers": """pointers AS (SELECT item_no, lane, CASE WHEN item_no % 19 = 0 THEN '{"run_dir": "ru' ELSE '{"run_dir":"runs/' || run_id || '","exit_code":' || ['6', '8', '9', '1', 'null'][item_no % 5 + 1] || '}' END AS body
  FROM (SELECT item_no, lane, run_id FROM items WHERE lane IN ('claim', 'waiting', 'failed') AND item_no % 8 <> 1 UNION ALL SELECT item_no, 'waiting', run_id FROM items WHERE lane = 'inbox' AND item_no % 31 = 0)),
pointed AS (SELECT item_no, lane, CASE WHEN item_no % 19 <> 0 THEN 'runs/' || (item_no % 150) END AS run_dir, CASE WHEN item_no % 19 <> 0 THEN [6, 8, 9, 1, NULL][item_no % 5 + 1] END AS exit_code FROM pointers)""",
    "leases": """leases AS (SELECT item_no, CASE WHEN item_no % 7 = 2 THEN TIMESTAMP '{fresh}' ELSE updated_at END AS claimed_at, 3600 AS ttl_s, item_no % 4 = 1 AS holder_alive FROM items WHERE lane = 'claim' AND item_no % 5 <> 0)""".replace("{fresh}", FRESH_AT),
    "slots": """slots AS (SELECT greatest(0, (SELECT count(*) FROM customer) // 4 - (SELECT count(*) FROM leases WHERE holder_alive AND claimed_at = TIMESTAMP '{fresh}'))::INTEGER AS free)""".replace("{fresh}", FRESH_AT),
    "reservations": """reservations AS (SELECT identity, max(updated_at) AS reserved_at FROM items GROUP BY identity HAVING max(item_no) % 5 <> 0)""",
    "steps": """steps AS (SELECT l_orderkey AS pipeline, l_linenumber AS pos, 's' || l_linenumber AS step, ((l_linenumber + 1) // 2)::INTEGER AS grp, 'a' || (l_suppkey % 5) AS needs, 'a' || (l_partkey % 5) AS produces FROM lineitem)""",
    "artifacts": """artifacts AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
}


def sql(view: str, query: str) -> str:
    return f"WITH {', '.join(SQL[v] for v in view.split())}\n{query}"
