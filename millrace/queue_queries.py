"""Registered queries over the work queue's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import folds, ledger, queue_state
from millrace.registry import NOW_RUNS, at, query
from millrace.sources import files
from millrace.sources import views as V
from millrace.sources.scratch import shared_dir

_DIGITS = "regexp_matches(rev, '^[0-9]+$')"
_N = "TRY_CAST({0} AS BIGINT)"
_LIVE_LANES = "lane IN ('claim', 'waiting')"


def _pointers(spark, d):
    return ledger.read_pointers(V.pointers(spark, d))


def _age(c: str) -> str:
    return f"(epoch(TIMESTAMP '{NOW_RUNS}') - epoch({c}))"


@query("items", f"""SELECT item_no, name, prio, round(effective, 6) AS effective FROM (SELECT item_no, name, prio, coalesce(prio, 5) - greatest(0, {_age('updated_at')}) / 3600.0::DOUBLE AS effective
FROM (SELECT * REPLACE (CASE WHEN item_no % 24 <> 0 THEN prio END AS prio) FROM items WHERE lane = 'inbox')) ORDER BY effective, name, item_no LIMIT 100""")
def aged_queue_topk(spark, d):
    """The 100 items to take first; some have no priority of their own."""
    some = V.items(spark, d).filter("lane = 'inbox'").withColumn("prio", F.when(F.col("item_no") % 24 != 0, F.col("prio")))
    return ledger.in_order(some, at(NOW_RUNS)).limit(100).select("item_no", "name", "prio", F.round("effective", 6).alias("effective"))


@query("items", "SELECT item_no, name FROM (SELECT item_no, CASE WHEN item_no % 23 = 0 THEN '.' || name WHEN item_no % 29 = 0 THEN 'ledger-version' ELSE name END AS name FROM items WHERE lane = 'inbox') WHERE name NOT LIKE '.%' AND name <> 'ledger-version'")
def inbox_candidates(spark, d):
    name = F.when(F.col("item_no") % 23 == 0, F.concat(F.lit("."), "name")).when(F.col("item_no") % 29 == 0, files.VERSION_MARKER).otherwise(F.col("name"))
    return files.candidates(V.items(spark, d).filter("lane = 'inbox'").select("item_no", name.alias("name")))


@query("items", f"SELECT identity, item_no, rev FROM items WHERE {_DIGITS} QUALIFY row_number() OVER (PARTITION BY identity ORDER BY {_N.format('rev')} DESC, item_no DESC) = 1")
def rev_latest_dedupe(spark, d):
    return ledger.newest(V.items(spark, d))


_COVER = f"""EXISTS (SELECT 1 FROM items t WHERE t.lane IN ('done', 'failed') AND t.identity = i.identity AND (t.rev = i.rev OR {_N.format('i.rev')} <= {_N.format('t.rev')}))"""


@query("items", f"SELECT item_no FROM items i WHERE lane = 'inbox' AND {_COVER}")
def tombstone_cover(spark, d):
    i = V.items(spark, d)
    return ledger.covered(i.filter("lane = 'inbox'"), i.filter("lane IN ('done', 'failed')")).select("item_no")


@query("items", f"""SELECT item_no, identity, CASE WHEN NOT regexp_matches(name, '{S.ITEM_NAME}') THEN 'reject' WHEN {_COVER} THEN 'skip' WHEN identity IN (SELECT identity FROM items WHERE {_LIVE_LANES}) THEN 'defer' ELSE 'admit' END AS disposition
FROM items i WHERE lane = 'inbox'""")
def admission(spark, d):
    return ledger.admission(V.items(spark, d))


@query("items", """SELECT identity, r['item_no'] AS item_no, r['rev'] AS rev FROM (SELECT identity, list_reduce(list({'item_no': item_no, 'rev': rev} ORDER BY item_no),
  lambda s, x: CASE WHEN s['rev'] = x['rev'] OR TRY_CAST(x['rev'] AS BIGINT) <= TRY_CAST(s['rev'] AS BIGINT) THEN s ELSE x END) AS r FROM items WHERE lane = 'deferred' GROUP BY identity)""")
def park_deferred(spark, d):
    return ledger.parked(V.items(spark, d).filter("lane = 'deferred'"))


_RECEIPT = """coalesce(CASE WHEN item_no % 4 = 0 THEN item_no::VARCHAR END, CASE WHEN item_no % 3 = 0 THEN item_no::VARCHAR END, CASE WHEN item_no % 7 = 0 THEN 'd7' END, CASE WHEN item_no % 2 = 0 THEN 'm' || item_no END)"""


def _receipts(spark, d, lane="done"):
    return V.receipts(spark, d, lane).withColumn("receipt_rev", S.receipt_rev(*map(F.col, ("receipt_1", "receipt_2", "receipt_3", "manifest"))))


@query("items", f"SELECT item_no, {_RECEIPT} AS receipt_rev FROM items WHERE lane = 'done'")
def receipt_revs(spark, d):
    return _receipts(spark, d).select("item_no", "receipt_rev")


@query("items", f"""SELECT identity, item_no, CASE WHEN prev = base OR {_N.format('prev')} <= {_N.format('base')} THEN 'drop' ELSE 'promote' END AS action
FROM (SELECT identity, max(item_no) AS item_no, arg_max(rev, item_no) AS prev FROM items WHERE lane = 'deferred' GROUP BY identity)
JOIN (SELECT identity, arg_max(coalesce({_RECEIPT}, rev), item_no) AS base FROM items WHERE lane = 'done' GROUP BY identity) USING (identity)""")
def promote_deferred(spark, d):
    i = V.items(spark, d)
    last = i.filter("lane = 'deferred'").groupBy("identity").agg(F.max_by(F.struct("item_no", "rev"), "item_no").alias("x")).select("identity", "x.*")
    done = _receipts(spark, d).groupBy("identity").agg(F.max_by(F.struct("rev", "receipt_rev"), "item_no").alias("x")).select("identity", "x.*")
    return ledger.promotion(last, done)


@query("items pointers", f"""SELECT item_no, identity, CASE WHEN code = 0 THEN 'done' WHEN code IN (6, 8, 9) THEN 'waiting' ELSE 'failed' END AS lane,
  CASE WHEN code NOT IN (6, 8, 9) THEN identity || '-r' || rev END AS tombstone, CASE WHEN code NOT IN (6, 8, 9) THEN CASE WHEN code = 0 THEN coalesce({_RECEIPT}, rev) ELSE rev END END AS compared_rev
FROM (SELECT i.*, CASE WHEN i.item_no % 7 = 0 THEN 0 ELSE coalesce(exit_code, 1) END AS code FROM items i LEFT JOIN (SELECT * FROM pointed WHERE lane = 'claim') p USING (item_no) WHERE i.lane = 'claim')""")
def retire(spark, d):
    rows = V.items(spark, d).filter("lane = 'claim'").join(_pointers(spark, d).filter("lane = 'claim'").select("item_no", "exit_code"), "item_no", "left")
    code = F.when(F.col("item_no") % 7 == 0, 0).otherwise(F.col("exit_code"))
    told = _receipts(spark, d, "claim").select("item_no", "receipt_rev")
    return ledger.retired(rows.withColumn("exit_code", code).join(told, "item_no", "left"))


_TERMS = "(SELECT run_id, arg_max_null(event, line_no) AS terminal, arg_max_null(exit_code, line_no) AS exit_code FROM trail WHERE event IN ('run-done', 'run-halt') GROUP BY run_id)"


@query("items trail leases slots", f"""SELECT item_no, CASE WHEN cap AND count(*) FILTER (cap) OVER (ORDER BY item_no) <= (SELECT free FROM slots) THEN 'resume' ELSE action END AS action FROM (
SELECT item_no, CASE WHEN terminal = 'run-done' THEN 'done' WHEN terminal = 'run-halt' AND coalesce(exit_code, 1) NOT IN (0, 6, 8, 9) THEN 'failed' ELSE 'leave' END AS action,
  coalesce(terminal = 'run-halt' AND exit_code = 8, false) AS cap FROM items LEFT JOIN {_TERMS} USING (run_id) WHERE lane = 'waiting')""")
def sweep(spark, d):
    return ledger.swept(V.items(spark, d).filter("lane = 'waiting'"), folds.last_terminal(V.trail(spark, d)), V.slots(spark, d).first()["free"])


@query("items", "SELECT item_no, CASE prio WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN item_no % 3 > 1 THEN 3600 END ELSE prio * 100 END::INTEGER AS ttl_s FROM items WHERE lane = 'claim'")
def lease_ttl(spark, d):
    configured = F.when(F.col("prio") == 0, 0).when(F.col("prio") == 1, -1).otherwise(F.col("prio") * 100)
    return V.items(spark, d).filter("lane = 'claim'").select("item_no", ledger.lease_ttl(configured, F.col("item_no") % 3).alias("ttl_s"))


@query("items leases", f"""SELECT count(claimed_at) AS lease_count, max({_age('claimed_at')})::BIGINT AS oldest_s, count(*) FILTER ({_age('claimed_at')} > ttl_s AND holder_alive) AS expired_live,
  count(*) FILTER (claimed_at IS NULL) AS missing_lease FROM items LEFT JOIN leases USING (item_no) WHERE lane = 'claim'""")
def lease_status(spark, d):
    return ledger.lease_status(V.items(spark, d).filter("lane = 'claim'"), V.leases(spark, d), at(NOW_RUNS))


@query("items leases pointers", f"""SELECT item_no, CASE WHEN claimed_at IS NULL THEN 'stuck' WHEN NOT {_age('claimed_at')} > ttl_s THEN 'held' WHEN holder_alive THEN 'flag' WHEN run_dir IS NOT NULL THEN 'waiting' ELSE 'requeue' END AS action
FROM (SELECT item_no FROM items WHERE lane = 'claim') LEFT JOIN leases USING (item_no) LEFT JOIN (SELECT item_no, run_dir FROM pointed WHERE lane = 'claim') USING (item_no)""")
def lease_reap(spark, d):
    return ledger.reaped(V.items(spark, d).filter("lane = 'claim'").select("item_no"), V.leases(spark, d), _pointers(spark, d).filter("lane = 'claim'"), at(NOW_RUNS))


@query("items", f"SELECT identity, count(DISTINCT lane) AS lanes, count(*) AS items FROM items WHERE {_LIVE_LANES} GROUP BY identity HAVING count(DISTINCT lane) > 1")
def double_live(spark, d):
    return ledger.double_live(V.items(spark, d))


_SETTLED = f"""(SELECT * FROM items i WHERE lane IN ('claim', 'waiting', 'failed', 'done') AND (lane <> 'claim' OR NOT (item_no IN (SELECT item_no FROM leases WHERE holder_alive) OR {_age('updated_at')} < 60)))"""
_ISSUES = f"""(SELECT item_no, NULL AS identity, 'pointer without item' AS issue FROM pointers p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.item_no = p.item_no AND i.lane = p.lane)
UNION ALL SELECT item_no, identity, 'item without pointer' FROM {_SETTLED} i WHERE lane <> 'done' AND NOT EXISTS (SELECT 1 FROM pointers p WHERE i.item_no = p.item_no AND i.lane = p.lane)
UNION ALL SELECT item_no, identity, 'claim without reservation' FROM {_SETTLED} WHERE lane = 'claim' AND identity NOT IN (SELECT identity FROM reservations)
UNION ALL SELECT NULL, identity, 'identity in two live lanes' FROM items WHERE {_LIVE_LANES} GROUP BY identity HAVING count(DISTINCT lane) > 1)"""


def _audit(spark, d):
    return ledger.audit(V.items(spark, d), V.pointers(spark, d), V.leases(spark, d), V.reservations(spark, d), at(NOW_RUNS))


@query("items pointers leases reservations", f"SELECT * FROM {_ISSUES}")
def ledger_audit(spark, d):
    return _audit(spark, d)


@query("items pointers leases reservations", f"""SELECT i.item_no, i.lane, string_agg(DISTINCT issue, '; ' ORDER BY issue) AS issues FROM items i JOIN {_ISSUES} x
  ON issue <> 'pointer without item' AND (x.item_no = i.item_no OR x.item_no IS NULL AND x.identity = i.identity AND {_LIVE_LANES.replace('lane', 'i.lane')}) GROUP BY ALL""")
def quarantine(spark, d):
    return ledger.quarantined(V.items(spark, d), _audit(spark, d))


@query("items", f"""SELECT item_no, identity, CASE WHEN name IN (SELECT name FROM items WHERE lane = 'inbox') THEN 'keep' ELSE 'promote' END AS action FROM items
WHERE lane = 'deferred' AND identity NOT IN (SELECT identity FROM items WHERE {_LIVE_LANES})""")
def stranded_deferred(spark, d):
    return ledger.stranded(V.items(spark, d))


@query("items reservations", f"SELECT identity FROM reservations WHERE {_age('reserved_at')} >= 60 AND identity NOT IN (SELECT identity FROM items WHERE {_LIVE_LANES})")
def orphan_reservations(spark, d):
    return ledger.orphan_reservations(V.reservations(spark, d), V.items(spark, d), at(NOW_RUNS))


@query("", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def orphan_items(spark, d):
    return ledger.orphans(V.table(spark, d, "customer"), V.table(spark, d, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


_DEPTHS = """(SELECT prio, count(*) FILTER (lane = 'inbox') AS inbox, count(*) FILTER (lane = 'claim') AS claim, count(*) FILTER (lane = 'waiting') AS waiting,
  count(*) FILTER (lane = 'failed') AS failed, count(*) FILTER (lane = 'done') AS done, count(*) FILTER (lane = 'deferred') AS deferred,
  count(*) FILTER (lane = 'waiting' AND exit_code = 6) AS needs_human, count(*) FILTER (lane = 'waiting' AND exit_code = 9) AS blocked, count(*) FILTER (lane = 'waiting' AND exit_code = 8) AS capacity,
  count(*) FILTER (lane IN ('claim', 'waiting')) AS inflight FROM items LEFT JOIN (SELECT item_no, exit_code FROM pointed WHERE lane = 'waiting') USING (item_no) GROUP BY prio)"""


@query("items pointers", f"SELECT * FROM {_DEPTHS}")
def lane_depths(spark, d):
    return ledger.lane_depths(V.items(spark, d), _pointers(spark, d))


CAPS = {"needs_human": 50, "blocked": 40, "capacity": 60, "inflight": 400}


@query("items pointers", f"""SELECT prio, CASE WHEN needs_human >= 50 THEN 'needs_human' WHEN blocked >= 40 THEN 'blocked' WHEN capacity >= 60 THEN 'capacity' WHEN inflight >= 400 THEN 'inflight' END AS "full" FROM {_DEPTHS}""")
def admission_caps(spark, d):
    return ledger.cap_reason(ledger.lane_depths(V.items(spark, d), _pointers(spark, d)), CAPS).select("prio", "full")


@query("items pointers", "SELECT item_no, lane, run_dir, exit_code, item_no % 19 <> 0 AS legible FROM pointed")
def pointer_states(spark, d):
    return _pointers(spark, d).select("item_no", "lane", "run_dir", "exit_code", "legible")


@query("items", """SELECT item_no, CASE WHEN item_no % 5 = 1 THEN item_no % 4 ELSE 0 END::INTEGER AS consecutive_failures, CASE WHEN item_no % 5 = 1 THEN 'soon' END AS opened_at FROM items WHERE lane = 'claim'""")
def circuit_files(spark, d):
    """Circuit files: torn, missing and wrongly typed ones are closed."""
    n = F.col("item_no")
    body = F.when(n % 5 == 1, F.concat(F.lit('{"consecutive_failures":'), (n % 4).cast("string"), F.lit(',"opened_at":"soon"}'))).when(n % 5 == 2, "{torn").when(n % 5 == 3, '{"consecutive_failures":"x"}')
    return ledger.read_circuits(V.items(spark, d).filter("lane = 'claim'").select("item_no", body.alias("body"))).select("item_no", "consecutive_failures", "opened_at")


@query("items pointers reservations", f"""SELECT item_no, identity, CASE WHEN run_dir IS NULL THEN 'no run' WHEN {_N.format('rev')} < done_rev THEN 'superseded'
  WHEN identity IN (SELECT identity FROM items WHERE {_LIVE_LANES}) OR identity IN (SELECT identity FROM reservations) OR {_N.format('rev')} < deferred_rev THEN 'owned' ELSE 'retry' END AS verdict
FROM (SELECT * FROM items WHERE lane = 'failed') LEFT JOIN (SELECT item_no, run_dir FROM pointed WHERE lane = 'failed') USING (item_no)
LEFT JOIN (SELECT identity, max({_N.format('rev')}) FILTER (lane = 'done') AS done_rev, max({_N.format('rev')}) FILTER (lane = 'deferred') AS deferred_rev FROM items GROUP BY identity) USING (identity)""")
def failed_retry(spark, d):
    return ledger.retryable(V.items(spark, d), _pointers(spark, d), V.reservations(spark, d))


@query("items pointers", """SELECT source, name, item_no, CASE WHEN legible THEN run_dir WHEN NOT legible THEN '(unreadable pointer)' END AS run_dir FROM items
LEFT JOIN (SELECT item_no, run_dir, item_no % 19 <> 0 AS legible FROM pointed WHERE lane = 'failed') USING (item_no) WHERE lane = 'failed'""")
def failed_listing(spark, d):
    return ledger.failed_listing(V.items(spark, d), _pointers(spark, d))


@query("items", """SELECT a.item_no, b.item_no AS other_no, CASE WHEN a.rev = b.rev THEN 0 WHEN TRY_CAST(a.rev AS BIGINT) < TRY_CAST(b.rev AS BIGINT) THEN -1 WHEN TRY_CAST(a.rev AS BIGINT) > TRY_CAST(b.rev AS BIGINT) THEN 1
  WHEN TRY_CAST(a.rev AS BIGINT) IS NOT NULL AND TRY_CAST(b.rev AS BIGINT) IS NOT NULL THEN 0 END::INTEGER AS rev_order FROM items a JOIN items b ON b.item_no = a.item_no + CASE WHEN a.item_no % 8 = 0 THEN 1000 ELSE 1 END""")
def rev_orders(spark, d):
    """Items beside their next one, or the one a thousand on, whose revision is the same."""
    i = V.items(spark, d).select("item_no", "rev")
    other = i.select(F.col("item_no").alias("other_no"), F.col("rev").alias("_rev"))
    return i.withColumn("other_no", F.col("item_no") + F.when(F.col("item_no") % 8 == 0, 1000).otherwise(1)).join(other, "other_no").select("item_no", "other_no", S.rev_order(F.col("rev"), F.col("_rev")).alias("rev_order"))


@query("", """SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed'
  WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change FROM (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a
  FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0) b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL""")
def schedule_diff(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    was = o.filter("o_orderkey % 4 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("v")))
    return ledger.changed(o.filter("o_orderkey % 3 <> 0"), was, "o_orderkey", "v")


BATCHES = 4
#: Items arrive in batches by number; some that stand in live lanes are retired one batch later.
_MOVES = f"""b AS (SELECT *, (item_no * {BATCHES} // (SELECT count(*) FROM orders))::INTEGER AS batch FROM items),
moves AS (SELECT batch, item_no AS seq, item_no, name, identity, rev, NULL AS from_lane, lane AS to_lane FROM b
  UNION ALL SELECT batch + 1, item_no + 1000000000, item_no, name, identity, rev, lane, 'done' FROM b WHERE lane IN ('claim', 'waiting') AND item_no % 4 < 3 AND batch < {BATCHES - 1})"""


def _queue(spark, d) -> str:
    """Four batches of transitions, the third sent twice; returns the folder of the state."""
    root = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    n = V.table(spark, d, "orders").count()
    b = V.items(spark, d).withColumn("batch", F.floor(F.col("item_no") * BATCHES / F.lit(max(1, n))).cast("int"))
    new = b.select("batch", F.col("item_no").alias("seq"), "item_no", "name", "identity", "rev", F.lit(None).cast("string").alias("from_lane"), F.col("lane").alias("to_lane"))
    gone = b.filter(F.col("lane").isin("claim", "waiting") & (F.col("item_no") % 4 < 3) & (F.col("batch") < BATCHES - 1))
    gone = gone.select((F.col("batch") + 1).alias("batch"), (F.col("item_no") + 1_000_000_000).alias("seq"), "item_no", "name", "identity", "rev", F.col("lane").alias("from_lane"), F.lit("done").alias("to_lane"))
    moves = new.unionByName(gone)
    for k in (0, 1, 2, 2, 3):
        queue_state.apply(spark, root, moves.filter(F.col("batch") == k).drop("batch"), f"b{k}")
    return root


@query("items", f""", {_MOVES}, tomb AS (SELECT * FROM moves WHERE to_lane IN ('done', 'failed')),
alive AS (SELECT s.batch, identity FROM moves, range({BATCHES}) s(batch) WHERE moves.batch <= s.batch GROUP BY ALL HAVING sum((to_lane IN ('claim', 'waiting'))::INTEGER - coalesce(from_lane IN ('claim', 'waiting'), false)::INTEGER) > 0)
SELECT item_no, identity, batch + 1 AS version, CASE WHEN NOT regexp_matches(name, '{S.ITEM_NAME}') THEN 'reject'
  WHEN EXISTS (SELECT 1 FROM tomb t WHERE t.batch <= m.batch AND t.identity = m.identity AND (t.rev = m.rev OR {_N.format('m.rev')} <= {_N.format('t.rev')})) THEN 'skip'
  WHEN EXISTS (SELECT 1 FROM alive a WHERE a.batch = m.batch AND a.identity = m.identity) THEN 'defer' ELSE 'admit' END AS disposition FROM moves m WHERE to_lane = 'inbox'""")
def queue_dispositions(spark, d):
    """Inbox items judged batch by batch, by the state that all batches so far have left."""
    return queue_state.dispositions(spark, _queue(spark, d))


@query("items", f""", {_MOVES} SELECT 'live' AS kind, identity, NULL::BIGINT AS item_no, NULL AS rev, sum((to_lane IN ('claim', 'waiting'))::INTEGER - coalesce(from_lane IN ('claim', 'waiting'), false)::INTEGER)::BIGINT AS n
FROM moves GROUP BY identity HAVING n > 0 UNION ALL SELECT DISTINCT 'retired', identity, NULL, rev, NULL FROM moves WHERE to_lane IN ('done', 'failed')
UNION ALL SELECT 'parked', identity, r['item_no'], r['rev'], NULL FROM (SELECT identity, list_reduce(list({{'item_no': item_no, 'rev': rev}} ORDER BY seq),
  lambda s, x: CASE WHEN s['rev'] = x['rev'] OR TRY_CAST(x['rev'] AS BIGINT) <= TRY_CAST(s['rev'] AS BIGINT) THEN s ELSE x END) AS r FROM moves WHERE to_lane = 'deferred' GROUP BY identity)""")
def queue_tables(spark, d):
    """Live identities, tombstones and parked items after all batches."""
    t = queue_state.tables(spark, _queue(spark, d), BATCHES)
    out = t["live"].select(F.lit("live").alias("kind"), "identity", "n")
    for name in ("retired", "parked"):
        out = out.unionByName(t[name].withColumn("kind", F.lit(name)), allowMissingColumns=True)
    return out.select("kind", "identity", "item_no", "rev", "n")


_SWEEP = f""", s1 AS (SELECT item_no, action, CASE action WHEN 'waiting' THEN 'waiting' WHEN 'requeue' THEN 'inbox' END AS to_lane FROM (
  SELECT item_no, CASE WHEN claimed_at IS NULL THEN 'stuck' WHEN NOT {_age('claimed_at')} > ttl_s THEN 'held' WHEN holder_alive THEN 'flag' WHEN run_dir IS NOT NULL THEN 'waiting' ELSE 'requeue' END AS action
  FROM (SELECT item_no FROM items WHERE lane = 'claim') LEFT JOIN leases USING (item_no) LEFT JOIN (SELECT item_no, run_dir FROM pointed WHERE lane = 'claim') USING (item_no))),
l1 AS (SELECT i.* REPLACE (coalesce(to_lane, lane) AS lane) FROM items i LEFT JOIN s1 USING (item_no)),
here AS (SELECT * FROM (SELECT p.* REPLACE (CASE WHEN lane = 'claim' AND to_lane IS NOT NULL THEN to_lane ELSE lane END AS lane) FROM pointed p LEFT JOIN s1 USING (item_no)) WHERE lane <> 'inbox'),
s2 AS (SELECT h.item_no, CASE WHEN l.lane IS NULL THEN 'orphan' ELSE 'repair' END AS action, CASE WHEN l.lane IS NOT NULL THEN h.lane END AS to_lane FROM here h LEFT JOIN l1 l USING (item_no) WHERE h.lane IS DISTINCT FROM l.lane),
l2 AS (SELECT i.* REPLACE (coalesce(to_lane, lane) AS lane) FROM l1 i LEFT JOIN s2 USING (item_no)),
w AS (SELECT item_no, cap, CASE WHEN p.item_no IS NULL OR item_no % 19 = 0 THEN 'stuck' WHEN run_dir IS NULL THEN 'failed' WHEN terminal = 'run-done' THEN 'done' WHEN terminal = 'run-halt' AND coalesce(t.exit_code, 1) NOT IN (0, 6, 8, 9) THEN 'failed' ELSE 'leave' END AS action
  FROM (SELECT * FROM l2 WHERE lane = 'waiting') LEFT JOIN (SELECT *, coalesce(terminal = 'run-halt' AND exit_code = 8, false) AS cap FROM {_TERMS}) t USING (run_id) LEFT JOIN (SELECT item_no, run_dir FROM here WHERE lane = 'waiting') p USING (item_no)),
s3 AS (SELECT item_no, CASE WHEN action = 'leave' AND cap AND count(*) FILTER (action = 'leave' AND cap) OVER (ORDER BY item_no) <= (SELECT free FROM slots) THEN 'resume' ELSE action END AS action, CASE WHEN action IN ('done', 'failed') THEN action END AS to_lane FROM w),
l3 AS (SELECT i.* REPLACE (coalesce(to_lane, lane) AS lane) FROM l2 i LEFT JOIN s3 USING (item_no)),
s4 AS (SELECT item_no, CASE WHEN name IN (SELECT name FROM l3 WHERE lane = 'inbox') THEN 'keep' ELSE 'promote' END AS action FROM l3 WHERE lane = 'deferred' AND identity NOT IN (SELECT identity FROM l3 WHERE {_LIVE_LANES}))
SELECT 1 AS step, item_no, action, to_lane FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3 UNION ALL SELECT 4, item_no, action, CASE WHEN action = 'promote' THEN 'inbox' END FROM s4"""


@query("items pointers leases slots trail", _SWEEP)
def sweep_steps(spark, d):
    """One sweep with its four steps: leases, pointers, waiting items, deferred ones."""
    free = V.slots(spark, d).first()["free"]
    return queue_state.sweep(V.items(spark, d), _pointers(spark, d), V.leases(spark, d), folds.last_terminal(V.trail(spark, d)), at(NOW_RUNS), free)


#: Names under which quarantined items and those of the inbox meet: ``g7.json``, and the same with a number.
_QUARANTINED = f"""quarantined AS (SELECT item_no, CASE WHEN item_no % 4 = 1 THEN 'g' || item_no // 60 || '.json' WHEN item_no % 4 = 2 THEN 'g' || item_no // 60 || '-v2.json' ELSE name END AS name FROM items i
  WHERE EXISTS (SELECT 1 FROM {_ISSUES} x WHERE issue <> 'pointer without item' AND (x.item_no = i.item_no OR x.item_no IS NULL AND x.identity = i.identity AND {_LIVE_LANES.replace('lane', 'i.lane')}))),
inbox AS (SELECT CASE WHEN item_no % 60 = 0 THEN 'g' || item_no // 60 || '.json' WHEN item_no % 12 = 6 THEN 'g' || item_no // 60 || '-v3.json' ELSE name END AS name FROM items WHERE lane = 'inbox')"""


@query("items pointers leases reservations", f""", {_QUARANTINED},
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY item_no) - (name NOT IN (SELECT name FROM inbox))::INTEGER AS k FROM quarantined),
free AS (SELECT item_no, k, regexp_replace(name, '[.]json$', '-v' || n || '.json') AS inbox_name, n FROM placed, range(2, 100) r(n))
SELECT item_no, name, coalesce(inbox_name, name) AS inbox_name FROM placed LEFT JOIN (
  SELECT item_no, inbox_name FROM free WHERE inbox_name NOT IN (SELECT name FROM inbox UNION SELECT name FROM quarantined) QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY n) = k) USING (item_no)""")
def quarantine_release(spark, d):
    """All that an audit moved aside goes back to the inbox, under names that are free there."""
    n = F.col("item_no")
    group = F.concat(F.lit("g"), F.floor(n / 60).cast("string"))
    i = V.items(spark, d)
    aside = ledger.quarantined(i, _audit(spark, d)).join(i.select("item_no", "name"), "item_no")
    name = F.when(n % 4 == 1, F.concat(group, F.lit(".json"))).when(n % 4 == 2, F.concat(group, F.lit("-v2.json"))).otherwise(F.col("name"))
    there = F.when(n % 60 == 0, F.concat(group, F.lit(".json"))).when(n % 12 == 6, F.concat(group, F.lit("-v3.json"))).otherwise(F.col("name"))
    return queue_state.released(aside.select("item_no", name.alias("name")), i.filter("lane = 'inbox'").select(there.alias("name")))
