"""The queue from batch to batch: live identities, tombstones and parked items as versioned tables, and the whole sweep.

A batch holds transitions of items (seq from 0, item_no, name, identity, rev, from_lane, to_lane); from_lane is null for a new
item. Each batch makes a new version of the three tables from the last one and itself; a commit log says which versions
count, so a batch that failed or comes again changes nothing twice. What all items together would give is never computed
again: tables are joined with the batch by identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import ITEM_NAME, exit_class, rev_key
from millrace.operators import ledger
from millrace.operators.ledger import LIVE
from millrace.sources.files import found
from millrace.sources.scratch import stored

TABLES = {"live": "identity string, n long", "retired": "identity string, rev string", "parked": "identity string, item_no long, rev string"}


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Committed versions and their batches, in order: one row for each batch there has been."""
    if not found(spark, f"{root}/commits/*.json"):
        return []
    rows = spark.read.schema("version long, batch string").json(f"{root}/commits").filter("batch IS NOT NULL").distinct().collect()
    return sorted((r["version"], r["batch"]) for r in rows)


def tables(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame]:
    """The state after a version; empty tables for version 0."""
    if version == 0:
        return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}/v={version}") for name, schema in TABLES.items()}


def advanced(state: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """The state after a batch. An identity is live while more of its items entered live lanes than left them; retired
    revisions stay for ever; what is parked is folded in the order of arrival (see ``ledger.parked``).
    """
    live_in, live_out = F.col("to_lane").isin(*LIVE), F.coalesce(F.col("from_lane").isin(*LIVE), F.lit(False))
    moved = batch.groupBy("identity").agg(F.sum(live_in.cast("long") - live_out.cast("long")).alias("n"))
    live = state["live"].unionByName(moved).groupBy("identity").agg(F.sum("n").alias("n")).filter("n > 0")
    gone = batch.filter(F.col("to_lane").isin("done", "failed")).select("identity", "rev")
    retired = state["retired"].unionByName(gone).distinct()
    arriving = batch.filter("to_lane = 'deferred'").select("identity", (F.col("seq") + 1).alias("order"), "item_no", "rev")
    known = state["parked"].select("identity", F.lit(0).cast("long").alias("order"), "item_no", "rev")
    both = known.join(arriving.select("identity").distinct(), "identity", "left_semi").unionByName(arriving)
    # the fold orders by number; the parked item comes first, whatever its own number is
    folded = ledger.parked(both.select("identity", F.col("order").alias("item_no"), "rev")).join(both.select("identity", F.col("order").alias("_o"), F.col("item_no").alias("_n")), "identity").filter("item_no = _o")
    folded = stored(folded.select("identity", F.col("_n").alias("item_no"), "rev"), "folded")
    parked = state["parked"].join(folded.select("identity"), "identity", "left_anti").unionByName(folded)
    return {"live": live, "retired": retired, "parked": parked}


def judged(state: dict[str, DataFrame], batch: DataFrame) -> DataFrame:
    """item_no, identity and disposition of the batch's new inbox items by a state (see ``ledger.admission``)."""
    inbox = batch.filter("to_lane = 'inbox' AND from_lane IS NULL").select("item_no", "name", "identity", "rev")
    told = ledger.covered(inbox, state["retired"]).select("item_no", F.lit(True).alias("_covered"))
    rows = inbox.join(told, "item_no", "left").join(state["live"].select("identity", F.lit(True).alias("_live")), "identity", "left")
    verdict = F.when(~F.col("name").rlike(ITEM_NAME), "reject").when(F.col("_covered"), "skip").when(F.col("_live"), "defer").otherwise("admit")
    return rows.select("item_no", "identity", verdict.alias("disposition"))


def apply(spark: SparkSession, root: str, batch: DataFrame, name: str) -> bool:
    """Make the next version from ``batch``, with the dispositions of its inbox items; false where that name is committed.

    Tables are written before their version is committed; a call that failed is written anew by the next one.
    """
    known = versions(spark, root)
    if name in {b for _, b in known}:
        return False
    version = (known[-1][0] if known else 0) + 1
    for table, df in advanced(tables(spark, root, version - 1), batch).items():
        df.write.mode("overwrite").parquet(f"{root}/{table}/v={version}")
    judged(tables(spark, root, version), batch).write.mode("overwrite").parquet(f"{root}/dispositions/v={version}")
    spark.createDataFrame([(version, name)], "version long, batch string").coalesce(1).write.mode("append").json(f"{root}/commits")
    return True


def dispositions(spark: SparkSession, root: str) -> DataFrame:
    """item_no, identity, disposition and version of all committed batches."""
    rows = spark.read.schema("item_no long, identity string, disposition string, v long").parquet(f"{root}/dispositions")
    return rows.filter(F.col("v") <= F.lit(max((v for v, _ in versions(spark, root)), default=0))).withColumnRenamed("v", "version")


def _moved(items: DataFrame, moves: DataFrame) -> DataFrame:
    """``items`` in the lanes that ``moves`` (item_no, to_lane) take them to."""
    there = moves.filter("to_lane IS NOT NULL").select("item_no", F.col("to_lane").alias("_to"))
    return items.join(there, "item_no", "left").withColumn("lane", F.coalesce("_to", "lane")).drop("_to")


def sweep(items: DataFrame, pointers: DataFrame, leases: DataFrame, terminals: DataFrame, now: Column, free_slots: int) -> DataFrame:
    """Everything that one sweep does, in its order: step, item_no, action and to_lane (null: it stays).

    1 *reap*: see ``ledger.reaped``; claims whose lease ran out go to waiting or back to the inbox. 2 *repair*: a pointer
    that moved before its item takes the item along. 3 *advance*: waiting items go by their run's last terminal; without a
    legible pointer they are stuck, without a run they have failed; the first ``free_slots`` capacity parks resume. 4
    *mop*: deferred items whose identity no longer lives go to the inbox. Each step sees the lanes that the last one left.
    """
    claims = items.filter("lane = 'claim'")
    reap = ledger.reaped(claims.select("item_no"), leases, pointers.filter("lane = 'claim'"), now)
    to = F.when(F.col("action") == "waiting", "waiting").when(F.col("action") == "requeue", "inbox")
    one = reap.select(F.lit(1).alias("step"), "item_no", "action", to.alias("to_lane"))
    lanes = _moved(items, one)
    # a reaped claim's pointer goes with it
    here = pointers.join(one.filter("to_lane IS NOT NULL").select("item_no", F.col("to_lane").alias("_to")), "item_no", "left")
    here = here.withColumn("lane", F.when((F.col("lane") == "claim") & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("lane"))).filter("lane <> 'inbox'").drop("_to")
    ahead = here.select("item_no", F.col("lane").alias("_p")).join(lanes.select("item_no", "lane"), "item_no", "left").filter(~F.col("lane").eqNullSafe(F.col("_p")))
    two = ahead.select(F.lit(2).alias("step"), "item_no", F.when(F.col("lane").isNull(), "orphan").otherwise("repair").alias("action"), F.when(F.col("lane").isNotNull(), F.col("_p")).alias("to_lane"))
    lanes = _moved(lanes, two)
    waiting = lanes.filter("lane = 'waiting'").select("item_no", "run_id")
    told = here.filter("lane = 'waiting'").select("item_no", F.lit(True).alias("_pointed"), "legible", "run_dir")
    swept = ledger.swept(waiting, terminals, 0).join(waiting, "item_no").join(told, "item_no", "left")
    action = (
        F.when(F.col("_pointed").isNull() | ~F.coalesce("legible", F.lit(False)), "stuck").when(F.col("run_dir").isNull(), "failed").otherwise(F.col("action"))
    )
    rows = swept.select("item_no", "run_id", action.alias("action"))
    cap = exit_class(F.coalesce("exit_code", F.lit(1)))["waiting_kind"] == "capacity"
    parks = rows.filter("action = 'leave'").join(terminals.filter((F.col("terminal") == "run-halt") & cap).select("run_id"), "run_id", "left_semi")
    resumed = ledger.first_items(parks, free_slots).select("item_no", F.lit("resume").alias("_r"))
    rows = rows.join(resumed, "item_no", "left").withColumn("action", F.coalesce("_r", "action"))
    three = rows.select(F.lit(3).alias("step"), "item_no", "action", F.when(F.col("action").isin("done", "failed"), F.col("action")).alias("to_lane"))
    lanes = _moved(lanes, three)
    mop = ledger.stranded(lanes)
    four = mop.select(F.lit(4).alias("step"), "item_no", "action", F.when(F.col("action") == "promote", "inbox").alias("to_lane"))
    return one.unionByName(two).unionByName(three).unionByName(four)


#: A file name as stem and ending: the last dot parts them, unless nothing stands before or behind it.
_NAME = r"(?s)^(.+?)(\.[^.]+)?\z"


def released(quarantine: DataFrame, inbox: DataFrame) -> DataFrame:
    """Quarantined items (item_no, name) that an operator lets go, under the names they get in the inbox.

    The first item of a name keeps it, unless it stands in the inbox; the others, by item_no, get ``-v2``, ``-v3`` ...
    before the ending, in order the numbers that no name in the inbox or the quarantine has. So no two items get one name:
    a numbered name tells its stem and number, and all names that are kept are left out. Names are few for each stem. A null
    name stays null; an empty name is numbered like any other.
    """
    stem = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, _NAME, 1), F.lit("")), c)
    numbered = r"(?s)^(.*)-v([1-9][0-9]{0,8})\z"
    parted = lambda rows: rows.withColumn("_stem", stem(F.col("name"))).withColumn("_end", F.regexp_extract("name", _NAME, 2))
    taken = inbox.select("name").unionByName(quarantine.select("name")).distinct()
    numbers = parted(taken).filter(F.col("_stem").rlike(numbered)).groupBy(F.regexp_extract("_stem", numbered, 1).alias("_stem"), "_end")
    numbers = numbers.agg(F.collect_set(F.regexp_extract("_stem", numbered, 2).cast("int")).alias("_used"))
    there = inbox.select("name", F.lit(1).alias("_there")).distinct()
    place = F.row_number().over(Window.partitionBy("name").orderBy("item_no"))
    rows = parted(quarantine.withColumn("_k", place).join(there, "name", "left")).withColumn("_k", F.col("_k") - 1 + F.coalesce("_there", F.lit(0)))
    rows = rows.join(numbers, ["_stem", "_end"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(2), F.col("_k") + F.size("_used") + 1), F.col("_used"))
    version = F.concat("_stem", F.lit("-v"), F.get(free, F.col("_k") - 1).cast("string"), "_end")
    return rows.select("item_no", "name", F.when(F.col("_k") == 0, F.col("name")).otherwise(version).alias("inbox_name"))
