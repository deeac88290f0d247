"""The work queue as tables: admission, claims, leases, retirement, audits, depths and order.

Lanes are values of a column; what the queue does is a table of transitions (item, from, to, why) that the caller
applies. Every rule is a join, a grouping or a CASE over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import ITEM_NAME, exit_class, rev_key, rev_order
from millrace.operators.folds import ranked

# Lanes whose items are alive, seconds that a fresh claim or reservation is left alone, the default lease.
LIVE = ("claim", "waiting")
GRACE_S, DEFAULT_LEASE_S = 60, 3600


def age_s(at: Column, now: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))


def read_pointers(rows: DataFrame) -> DataFrame:
    """``rows`` with run_dir, exit_code and child_pid of their pointer's ``body``; a torn body leaves all null."""
    v = F.try_parse_json("body")
    whole = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "BIGINT", F.try_variant_get(v, f"$.{key}", "int"))
    legible = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = rows.withColumn("run_dir", F.nullif(F.try_variant_get(v, "$.run_dir", "string"), F.lit(""))).withColumn("exit_code", whole("exit_code")).withColumn("child_pid", whole("child_pid"))
    return found.withColumn("legible", legible).drop("body")


def read_circuits(rows: DataFrame) -> DataFrame:
    """``rows`` with consecutive_failures and opened_at of their ``body``; anything unreadable is a closed circuit."""
    v = F.try_parse_json("body")
    n = F.expr("try_cast(try_variant_get(try_parse_json(body), '$.consecutive_failures', 'string') AS int)")
    opened = F.try_variant_get(v, "$.opened_at", "string")
    return rows.withColumn("consecutive_failures", F.greatest(F.lit(0), F.coalesce(n, F.lit(0)))).withColumn("opened_at", opened).drop("body")


def aged(items: DataFrame, now: Column) -> DataFrame:
    """``items`` with effective priority: one point less an hour of age; future items have age 0; unknown is 5."""
    return items.withColumn("effective", F.coalesce("prio", F.lit(5)) - F.greatest(F.lit(0), age_s(F.col("updated_at"), now)) / 3600.0)


def in_order(items: DataFrame, now: Column) -> DataFrame:
    """``items`` with their effective priority, in the order in which they are taken: the least first, ties by name."""
    return aged(items, now).orderBy("effective", "name", *(["item_no"] if "item_no" in items.columns else []))


def tombstones(items: DataFrame) -> DataFrame:
    """identity and its greatest comparable revision among retired items: one row an identity, so coverage is an equi-join."""
    return items.filter(F.col("lane").isin("done", "failed")).groupBy("identity").agg(F.max(rev_key(F.col("rev"))).alias("tomb"))


def covered(items: DataFrame, retired: DataFrame) -> DataFrame:
    """The rows that some tombstone of their identity covers: a comparable revision at least theirs, or the same text."""
    numbers = retired.groupBy("identity").agg(F.max(rev_key(F.col("rev"))).alias("_tomb"))
    same = retired.select("identity", "rev", F.lit(True).alias("_same")).distinct()
    rows = items.join(numbers, "identity", "left").join(same, ["identity", "rev"], "left")
    hit = F.coalesce(rev_key(F.col("rev")) <= F.col("_tomb"), F.lit(False)) | F.coalesce("_same", F.lit(False))
    return rows.filter(hit).select(items.columns)


def live_identities(items: DataFrame) -> DataFrame:
    return items.filter(F.col("lane").isin(*LIVE)).select("identity").distinct()


def admission(items: DataFrame) -> DataFrame:
    """Disposition of every inbox item: reject a bad name, skip what a tombstone covers, defer while its identity is
    live, else admit. Revisions that can't be compared are not covered, unless their texts are equal.
    """
    retired = items.filter(F.col("lane").isin("done", "failed"))
    inbox = items.filter("lane = 'inbox'")
    told = covered(inbox, retired).select("item_no", F.lit(True).alias("_covered"))
    rows = inbox.join(told, "item_no", "left").join(live_identities(items).withColumn("_live", F.lit(True)), "identity", "left")
    bad = ~F.col("name").rlike(ITEM_NAME) if "name" in items.columns else ~F.col("identity").rlike("^[a-z0-9._-]+$")
    verdict = F.when(bad, "reject").when(F.col("_covered"), "skip").when(F.col("_live"), "defer").otherwise("admit")
    return rows.select("item_no", "identity", verdict.alias("disposition"))


def newest(items: DataFrame) -> DataFrame:
    """Each identity's item of the greatest comparable revision, ties to the larger number."""
    best = F.max_by(F.struct("item_no", "rev"), F.when(rev_key(F.col("rev")).isNotNull(), F.struct(rev_key(F.col("rev")).alias("k"), "item_no")))
    rows = items.groupBy("identity").agg(best.alias("b"))
    return rows.filter("b is not null").select("identity", "b.item_no", "b.rev")


def parked(deferred: DataFrame) -> DataFrame:
    """What stays parked of deferred items that arrive by item_no: identity, item_no, rev.

    An arrival takes the place of the parked one unless it is comparably no newer. So the last revision that is not a
    number clears what came before; of the numbers behind it the greatest stays, and of equals the first. Both steps
    are aggregates by identity.
    """
    key = rev_key(F.col("rev"))
    rows = deferred.withColumn("_key", key)
    # equal texts that are not numbers do not replace each other: the first of the last such run stays
    words = rows.filter("_key IS NULL").groupBy("identity").agg(F.max("item_no").alias("_last"), F.max_by("rev", "item_no").alias("_word"))
    known = rows.join(words, "identity", "left")
    behind = known.filter(F.col("_key").isNotNull() & (F.coalesce("_last", F.lit(-1)) < F.col("item_no")))
    numbers = behind.groupBy("identity").agg(F.max_by(F.struct("item_no", "rev"), F.struct("_key", -F.col("item_no"))).alias("b"))
    # where no number follows: the first item of the run of equal texts that ends at _last
    other = known.filter(F.col("_last").isNotNull() & ~F.col("rev").eqNullSafe(F.col("_word")) & (F.col("item_no") < F.col("_last"))).groupBy("identity").agg(F.max("item_no").alias("_other"))
    runs = known.filter(F.col("rev").eqNullSafe(F.col("_word"))).join(other, "identity", "left").filter(F.col("item_no") > F.coalesce("_other", F.lit(-1)))
    firsts = runs.groupBy("identity").agg(F.min_by(F.struct("item_no", "rev"), "item_no").alias("w"))
    both = firsts.join(numbers, "identity", "full").select("identity", F.coalesce("b", "w").alias("x"))
    return both.select("identity", "x.item_no", "x.rev")


def promotion(parked_items: DataFrame, retiring: DataFrame) -> DataFrame:
    """What becomes of the item parked behind a retiring one (identity, rev, receipt_rev): identity, item_no, action.

    The parked revision is compared with the receipt's, or else the retired item's: no newer is dropped (and gets a
    tombstone), newer or incomparable is promoted to the inbox.
    """
    base = retiring.select("identity", F.coalesce("receipt_rev", "rev").alias("_base"))
    order = rev_order(F.col("rev"), F.col("_base"))
    action = F.when(order <= 0, "drop").otherwise("promote")
    return parked_items.join(base, "identity").select("identity", "item_no", action.alias("action"))


def retired(claims: DataFrame, on_done: str = "done") -> DataFrame:
    """Where claimed items go by their exit_code: item_no, lane, tombstone (identity and revision, or null).

    Done goes to ``done`` (or is deleted), waiting to ``waiting`` without a tombstone, all else to ``failed``. Only
    done items use a receipt's revision.
    """
    outcome = exit_class(F.coalesce("exit_code", F.lit(1)))["outcome"]
    lane = F.when(outcome == "DONE", F.lit("deleted" if on_done == "delete" else "done")).when(outcome == "WAITING", "waiting").otherwise("failed")
    tomb = F.when(outcome != "WAITING", F.concat("identity", F.lit("-r"), "rev"))
    base = F.when(outcome == "DONE", F.coalesce("receipt_rev", "rev")).when(outcome == "FAILED", F.col("rev"))
    return claims.select("item_no", "identity", lane.alias("lane"), tomb.alias("tombstone"), base.alias("compared_rev"))


def swept(waiting: DataFrame, terminals: DataFrame, free_slots: int) -> DataFrame:
    """What a sweep does with waiting items (item_no, run_id) by their run's last terminal: item_no, action.

    run-done retires as done, a halt that failed as failed; other halts leave the item, but the first ``free_slots``
    capacity parks by item_no resume. Without a terminal the item stays.
    """
    rows = waiting.join(terminals, "run_id", "left")
    cls = exit_class(F.coalesce("exit_code", F.lit(1)))
    action = F.when(F.col("terminal") == "run-done", "done").when((F.col("terminal") == "run-halt") & (cls["outcome"] == "FAILED"), "failed").otherwise("leave")
    found = rows.select("item_no", action.alias("_a"), ((F.col("terminal") == "run-halt") & (cls["waiting_kind"] == "capacity")).alias("_cap"))
    resumed = first_items(found.filter("_cap"), free_slots).select("item_no", F.lit("resume").alias("_r"))
    return found.join(resumed, "item_no", "left").select("item_no", F.coalesce("_r", "_a").alias("action"))


def first_items(rows: DataFrame, n: int) -> DataFrame:
    """item_no of the first ``n`` rows by item_no. Slots may be as many as items, so ranks are counted over ranges: no task
    holds ``n`` rows.
    """
    if n <= 0:
        return rows.select("item_no").limit(0)
    return ranked(rows, "item_no")[0].filter(F.col("_r") <= n).select("item_no")


def lease_ttl(configured: Column, concurrency: Column) -> Column:
    """Seconds of a lease: 0 is off (null), more is that many, -1 is the default where more than one works."""
    return F.when(configured == 0, None).when(configured > 0, configured).when(concurrency > 1, F.lit(DEFAULT_LEASE_S)).cast("int")


def with_leases(claims: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    rows = claims.join(leases, "item_no", "left")
    return rows.withColumn("age_s", age_s(F.col("claimed_at"), now)).withColumn("expired", F.col("age_s") > F.col("ttl_s"))


def lease_status(claims: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """One row: leases, the oldest age, expired ones whose holder lives, and claims without a lease."""
    rows = with_leases(claims, leases, now)
    return rows.agg(
        F.count("claimed_at").alias("lease_count"),
        F.max("age_s").alias("oldest_s"),
        F.count_if(F.col("expired") & F.col("holder_alive")).alias("expired_live"),
        F.count_if(F.col("claimed_at").isNull()).alias("missing_lease"),
    )


def reaped(claims: DataFrame, leases: DataFrame, pointers: DataFrame, now: Column) -> DataFrame:
    """item_no and what becomes of its claim: ``stuck`` without a lease, ``held`` while it is not expired, ``flag`` if
    its holder lives, else ``waiting`` where a run can be resumed and ``requeue`` where none ever ran.
    """
    rows = with_leases(claims, leases, now).join(pointers.select("item_no", "run_dir"), "item_no", "left")
    verdict = (
        F.when(F.col("claimed_at").isNull(), "stuck")
        .when(~F.coalesce("expired", F.lit(False)), "held")
        .when(F.coalesce("holder_alive", F.lit(False)), "flag")
        .when(F.col("run_dir").isNotNull(), "waiting")
        .otherwise("requeue")
    )
    return rows.select("item_no", verdict.alias("action"))


def double_live(items: DataFrame) -> DataFrame:
    """Identities that stand in more than one live lane."""
    live = items.filter(F.col("lane").isin(*LIVE)).groupBy("identity").agg(F.count_distinct("lane").alias("lanes"), F.count("*").alias("items"))
    return live.filter("lanes > 1")


def audit(items: DataFrame, pointers: DataFrame, leases: DataFrame, reservations: DataFrame, now: Column) -> DataFrame:
    """Violations of the queue's invariants: item_no (null for an identity), identity, issue.

    Pointers without item, items without pointer (not in ``done``), claims without reservation, identities in two live
    lanes. Claims are left alone while their lease's holder lives or they are younger than GRACE_S.
    """
    laned = items.filter(F.col("lane").isin("claim", "waiting", "failed", "done"))
    stray = pointers.select("item_no", "lane").join(laned.select("item_no", "lane"), ["item_no", "lane"], "left_anti")
    stray = stray.select("item_no", F.lit(None).cast("string").alias("identity"), F.lit("pointer without item").alias("issue"))
    held = leases.filter("holder_alive").select("item_no", F.lit(True).alias("_held"))
    fresh = age_s(F.col("updated_at"), now) < GRACE_S
    settled = laned.join(held, "item_no", "left").filter((F.col("lane") != "claim") | ~(F.coalesce("_held", F.lit(False)) | fresh))
    bare = settled.filter("lane <> 'done'").join(pointers.select("item_no", "lane"), ["item_no", "lane"], "left_anti")
    bare = bare.select("item_no", "identity", F.lit("item without pointer").alias("issue"))
    free = settled.filter("lane = 'claim'").join(reservations.select("identity"), "identity", "left_anti")
    free = free.select("item_no", "identity", F.lit("claim without reservation").alias("issue"))
    double = double_live(items).select(F.lit(None).cast("long").alias("item_no"), "identity", F.lit("identity in two live lanes").alias("issue"))
    return stray.unionByName(bare).unionByName(free).unionByName(double)


def quarantined(items: DataFrame, issues: DataFrame) -> DataFrame:
    """The items that an audit's issues move aside, with all their issues: nothing is deleted, and no item moves twice."""
    own = issues.filter("item_no IS NOT NULL AND issue <> 'pointer without item'").select("item_no", "issue")
    shared = issues.filter("item_no IS NULL").select("identity", "issue")
    by_identity = items.filter(F.col("lane").isin(*LIVE)).join(shared, "identity").select("item_no", "issue")
    moved = own.unionByName(by_identity).groupBy("item_no").agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("issues"))
    return items.select("item_no", "lane").join(moved, "item_no")


def stranded(items: DataFrame) -> DataFrame:
    """Deferred items whose identity is not live any more: they go to the inbox, unless their name stands there."""
    waits = items.filter("lane = 'deferred'").join(live_identities(items), "identity", "left_anti")
    there = items.filter("lane = 'inbox'").select("name", F.lit(True).alias("_there")).distinct()
    rows = waits.join(there, "name", "left")
    return rows.select("item_no", "identity", F.when(F.col("_there"), "keep").otherwise("promote").alias("action"))


def orphan_reservations(reservations: DataFrame, items: DataFrame, now: Column, grace_s: int = GRACE_S) -> DataFrame:
    """Reservations of at least ``grace_s`` whose identity no live item holds."""
    old = reservations.filter(age_s(F.col("reserved_at"), now) >= grace_s)
    return old.join(live_identities(items), "identity", "left_anti").select("identity")


def lane_depths(items: DataFrame, pointers: DataFrame) -> DataFrame:
    """By priority: items of every lane, those in flight, and the waiting ones by what their pointer's exit says."""
    lanes = ("inbox", "claim", "waiting", "failed", "done", "deferred")
    told = pointers.filter("lane = 'waiting'").select("item_no", exit_class(F.coalesce("exit_code", F.lit(1)))["waiting_kind"].alias("kind"))
    rows = items.join(told, "item_no", "left")
    kinds = [F.count_if((F.col("lane") == "waiting") & (F.col("kind") == k)).alias(k) for k in ("needs_human", "blocked", "capacity")]
    rows = rows.groupBy("prio").agg(*[F.count_if(F.col("lane") == x).alias(x) for x in lanes], *kinds)
    return rows.withColumn("inflight", F.col("claim") + F.col("waiting"))


def cap_reason(depths: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``depths`` with the first full cap in the fixed order needs_human, blocked, capacity, inflight, or null."""
    full = F.lit(None).cast("string")
    for name in ("inflight", "capacity", "blocked", "needs_human"):
        if name in caps:
            full = F.when(F.col(name) >= caps[name], name).otherwise(full)
    return depths.withColumn("full", full)


def retryable(items: DataFrame, pointers: DataFrame, reservations: DataFrame) -> DataFrame:
    """Every failed item and whether it may be tried again: item_no, verdict.

    Without a legible pointer to a run there is nothing to resume; an identity that is reserved, stands in a live lane
    or has a comparably newer deferred item, and one that a comparably newer done item supersedes, is refused.
    """
    failed = items.filter("lane = 'failed'").withColumn("_key", rev_key(F.col("rev")))
    run = pointers.filter("lane = 'failed'").select("item_no", "run_dir")
    top = lambda lane, name: items.filter(F.col("lane") == lane).groupBy("identity").agg(F.max(rev_key(F.col("rev"))).alias(name))
    owned = live_identities(items).unionByName(reservations.select("identity")).distinct().withColumn("_owned", F.lit(True))
    rows = failed.join(run, "item_no", "left").join(owned, "identity", "left").join(top("deferred", "_deferred"), "identity", "left").join(top("done", "_done"), "identity", "left")
    newer = lambda c: F.coalesce(F.col(c) > F.col("_key"), F.lit(False))
    verdict = (
        F.when(F.col("run_dir").isNull(), "no run").when(newer("_done"), "superseded").when(F.coalesce("_owned", F.lit(False)) | newer("_deferred"), "owned").otherwise("retry")
    )
    return rows.select("item_no", "identity", verdict.alias("verdict"))


def failed_listing(items: DataFrame, pointers: DataFrame) -> DataFrame:
    """Failed items with the run their pointer names, by source and name; a torn pointer says so."""
    told = pointers.filter("lane = 'failed'").select("item_no", F.when(~F.col("legible"), "(unreadable pointer)").otherwise(F.col("run_dir")).alias("run_dir"))
    return items.filter("lane = 'failed'").join(told, "item_no", "left").select("source", "name", "item_no", "run_dir").orderBy("source", "name", "item_no")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def changed(declared: DataFrame, installed: DataFrame, key: str, value: str) -> DataFrame:
    """key and whether it was added, removed or changed from installed to declared."""
    d, i = declared.select(key, F.col(value).alias("_d"), F.lit(1).alias("_in")), installed.select(key, F.col(value).alias("_i"), F.lit(1).alias("_was"))
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_in").isNull(), "removed").when(~F.col("_d").eqNullSafe(F.col("_i")), "changed")
    return d.join(i, key, "full").select(key, kind.alias("change")).filter("change is not null")
