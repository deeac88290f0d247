"""Ordered folds and gauges over trails.

A run's events count in the order of its file, which is ``line_no``: times may run backwards or be null. Folds are
aggregates by that order, so they combine before the shuffle. Parks, offsets and the circuit need a window by run: a
run's events are one writer's, so they are bounded by what one process can do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import decided_class, exit_class
from millrace.sources.scratch import stored

TERMINAL = ("run-done", "run-halt")


def latest() -> Column:
    return F.col("line_no")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def whole_seconds(at: Column) -> Column:
    """Seconds since 1970 of a time to the nearest millisecond (half of one counts up), without what is left of a second."""
    return F.floor((F.unix_micros(at.cast("timestamp")) + 500) / 1_000_000)


def window_runs(trail: DataFrame, start: Column, manifests: DataFrame | None = None) -> DataFrame:
    """All events of the runs that have any event, or were created by their manifest, at or after ``start``."""
    inside = trail.filter(F.col("ev_at") >= start).select("run_id")
    if manifests is not None:
        inside = inside.unionByName(manifests.filter(F.try_to_timestamp(F.col("created_at").cast("string")) >= start).select("run_id"))
    return trail.join(inside.distinct(), "run_id", "left_semi")


def run_status(trail: DataFrame, now: Column, grace_s: int | None = None) -> DataFrame:
    """One row per run: the last terminal with its exit code, the last open gate, the derived status, and since when.

    A run whose last event looks alive is stale beyond ``grace_s``; without a grace, or where its time can't be read,
    it counts as running. Later events do not undo a terminal, but they do decide the status.
    """
    last = F.max_by(F.struct("event", "ev_at"), latest())
    terminal = F.max_by(F.struct("event", "exit_code"), F.when(F.col("event").isin(*TERMINAL), latest()))
    gate = F.max_by("node", F.when(F.col("event") == "gate-pending", latest()))
    rows = trail.groupBy("run_id").agg(last.alias("l"), terminal.alias("t"), gate.alias("last_gate"), F.count("*").alias("n_events"))
    age = whole_seconds(now) - whole_seconds(F.col("l.ev_at"))
    stale = F.lit(False) if grace_s is None else F.coalesce(age > grace_s, F.lit(False))
    status = (
        F.when(F.col("l.event") == "gate-pending", "gate")
        .when(F.col("l.event") == "run-halt", "halted")
        .when(F.col("l.event") == "run-done", "done")
        .when(stale, "stale")
        .otherwise("running")
    )
    kind = F.when(F.col("t.event") == "run-halt", exit_class(F.coalesce("t.exit_code", F.lit(1)))["waiting_kind"])
    return rows.select("run_id", status.alias("status"), F.col("t.event").alias("terminal"), F.col("t.exit_code").alias("exit_code"), kind.alias("waiting_kind"), "last_gate", F.col("l.ev_at").alias("last_at"), "n_events")


def inbox_cards(trail: DataFrame, manifests: DataFrame, now: Column, grace_s: int | None = None) -> DataFrame:
    """Runs with a manifest that wait for someone, oldest first: a gate or a halt that needs a human can be answered,
    other waiting halts can't. Ages are whole seconds from the last event, 0 where its time can't be read.
    """
    rows = run_status(trail, now, grace_s).join(manifests.select("run_id", "pipeline"), "run_id")
    kind = F.when((F.col("status") == "gate") | (F.col("waiting_kind") == "needs_human"), "answerable").when(F.col("waiting_kind").isNotNull(), "waiting_other")
    age = F.coalesce(F.greatest(F.lit(0), whole_seconds(now) - whole_seconds(F.col("last_at"))), F.lit(0))
    return rows.select("run_id", "pipeline", kind.alias("kind"), age.alias("age_s"), "last_gate").filter("kind IS NOT NULL").orderBy(F.desc("age_s"), "run_id")


def node_latest(trail: DataFrame) -> DataFrame:
    """Every node's last event, its line, and the line where the node came first (the order to show them in)."""
    return trail.groupBy("run_id", "node").agg(F.max_by("event", latest()).alias("event"), F.max("line_no").alias("line_no"), F.min("line_no").alias("first_line"))


def gates(trail: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per run and gate that was asked, answered or has a decision file.

    pending is the first time it was asked; decided the last answer's, or else the file's, or else the file's mtime;
    decided_by the last answer's, or else a verified file's; ``evidence`` tells whether anything was decided.
    """
    named = trail.filter(F.coalesce(F.col("node"), F.lit("")) != "")
    asked, told = F.col("event") == "gate-pending", F.col("event") == "gate-answered"
    rows = named.filter(asked | told).groupBy("run_id", F.col("node").alias("gate")).agg(
        F.min_by("ev_at", F.when(asked & F.col("ev_at").isNotNull(), latest())).alias("pending"),
        F.max_by("ev_at", F.when(told & F.col("ev_at").isNotNull(), latest())).alias("answered"),
        F.max_by("decided_by", F.when(told & F.col("decided_by").isNotNull(), latest())).alias("answered_by"),
    )
    if files is None:
        return rows.select("run_id", "gate", "pending", F.col("answered").alias("decided"), F.col("answered_by").alias("decided_by"), F.col("answered").isNotNull().alias("evidence"))
    kept = files.select("run_id", "gate", F.coalesce("decided_at", "mtime").alias("_at"), F.when(F.col("verified"), F.col("decided_by")).alias("_by"), F.lit(True).alias("_file"))
    both = rows.join(kept, ["run_id", "gate"], "full")
    return both.select(
        "run_id",
        "gate",
        "pending",
        F.coalesce("answered", "_at").alias("decided"),
        F.coalesce("answered_by", "_by").alias("decided_by"),
        (F.col("answered").isNotNull() | F.coalesce("_file", F.lit(False))).alias("evidence"),
    )


def gate_latencies(found: DataFrame) -> DataFrame:
    """``gates`` with latency in seconds; gates without a side or decided before they were asked are left out."""
    return found.withColumn("latency_s", seconds_between(F.col("pending"), F.col("decided"))).filter("latency_s >= 0")


def ranked(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """``value`` of ``rows`` with its rank ``_r`` from 1, and one row of n and mean, without bringing the values together.

    Values are range-sorted, equal ones by a number of their own, so ties are no hot range either; a partition's place in
    the order comes from the partitions' sizes (a row for each). All is read from one stored table, so ``rows`` are
    evaluated once.
    """
    ranged = rows.select(value, F.monotonically_increasing_id().alias("_t")).repartitionByRange(value, "_t")
    placed = stored(ranged.withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"))
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(value, "_t")) + F.col("_base")
    return placed.join(F.broadcast(bases), "_p").select(value, rank.alias("_r")), total


def picked_ranks(rows: DataFrame, value: str, shares: dict[str, tuple[int, ...]]) -> DataFrame:
    """One row: n, mean, and for each name the mean of the values at the given ranks (see ``ranked``).

    ``shares`` gives, as SQL over n, the ranks (from 1) to average.
    """
    places, total = ranked(rows, value)
    places = places.join(F.broadcast(total))
    wanted = {name: F.col("_r").isin(*[F.expr(r) for r in ranks]) for name, ranks in shares.items()}
    picked = places.agg(*[F.avg(F.when(hit, F.col(value))).alias(name) for name, hit in wanted.items()])
    return total.join(F.broadcast(picked))


def gate_latency(trail: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: number, mean, interpolated median and nearest-rank 90th percentile of gate latencies.

    Distinct latencies are as many as answers, so the exact percentiles are picked by rank from a range-sorted table.
    """
    return latency_gauge(gates(trail, files))


def latency_gauge(found: DataFrame) -> DataFrame:
    """``gate_latency`` of gates that are known."""
    ranks = {"med": ("(n + 1) div 2", "n div 2 + 1"), "p90": ("cast(ceil(n * 90 / 100) as bigint)",)}
    told = picked_ranks(gate_latencies(found).select("latency_s"), "latency_s", ranks)
    return told.select(F.col("n").alias("n_gates"), *[F.round(c, 3).alias(f"{c}_s") for c in ("mean", "med", "p90")])


def last_terminal(trail: DataFrame) -> DataFrame:
    """run_id, terminal and exit_code of the runs that have a terminal event."""
    ends = trail.filter(F.col("event").isin(*TERMINAL))
    return ends.groupBy("run_id").agg(F.max_by(F.struct("event", "exit_code"), latest()).alias("t")).select("run_id", F.col("t.event").alias("terminal"), "t.exit_code")


def done_runs(trail: DataFrame) -> DataFrame:
    return last_terminal(trail).filter("terminal = 'run-done'").select("run_id")


def human_share(trail: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: gates of completed runs by who decided last, and the human share of human and machine.

    A decision by someone unknown or by a file that is not verified is ``other``; a gate that was only asked is none.
    """
    return share_gauge(gates(trail, files), done_runs(trail))


def share_gauge(found: DataFrame, done: DataFrame) -> DataFrame:
    """``human_share`` of gates that are known, in the completed runs ``done``."""
    decided = found.filter(F.col("evidence") | F.col("decided_by").isNotNull()).join(done, "run_id", "left_semi")
    counts = decided.agg(*[F.count_if(decided_class(F.coalesce("decided_by", F.lit("?"))) == c).alias(c) for c in ("human", "machine", "other")])
    return counts.withColumn("share", F.round(F.try_divide(F.col("human"), F.col("human") + F.col("machine")), 6))


def step_rates(trail: DataFrame) -> DataFrame:
    """By node: passes, fails, passes with artifacts, retries and the success rates (null without either).

    A retry fails, and so does a step-fail with reasons; only a step-done that names artifacts passes its validators.
    """
    is_ = F.col("event").__eq__
    failed = is_("retry") | (is_("step-fail") & (F.coalesce(F.size("reasons"), F.lit(0)) > 0))
    rows = trail.groupBy(F.coalesce("node", F.lit("?")).alias("node")).agg(
        F.count_if(is_("step-done")).alias("passes"),
        F.count_if(failed).alias("fails"),
        F.count_if(is_("step-done") & (F.size("artifacts") > 0)).alias("validated"),
        F.count_if(is_("retry")).alias("retries"),
    )
    rate = lambda n: F.round(F.try_divide(F.col(n), F.col(n) + F.col("fails")), 6)
    return rows.withColumn("rate", rate("passes")).withColumn("validator_rate", rate("validated"))


def blocked_parks(trail: DataFrame, now: Column) -> DataFrame:
    """Every halt with exit 9 and a readable time: resolved by the run's next line, if that has a readable time, or else
    open until ``now``; seconds are never below zero.
    """
    w = Window.partitionBy("run_id").orderBy("line_no")
    halts = trail.withColumn("next_at", F.lead("ev_at").over(w)).filter("event = 'run-halt' AND exit_code = 9 AND ev_at IS NOT NULL")
    until = F.coalesce("next_at", now.cast("timestamp_ntz"))
    return halts.select("run_id", "line_no", F.col("next_at").isNotNull().alias("resolved"), F.greatest(F.lit(0.0), seconds_between(F.col("ev_at"), until)).alias("seconds"))


def blocked_snapshot(trail: DataFrame, now: Column) -> DataFrame:
    """One row: open parks, the oldest of them, resolved parks (not runs), their sum and mean."""
    p = blocked_parks(trail, now)
    return p.agg(
        F.count_if(~F.col("resolved")).alias("open_parks"),
        F.round(F.max(F.when(~F.col("resolved"), F.col("seconds"))), 3).alias("oldest_s"),
        F.count_if("resolved").alias("resolved_parks"),
        F.round(F.sum(F.when(F.col("resolved"), F.col("seconds"))), 3).alias("total_park_s"),
        F.round(F.avg(F.when(F.col("resolved"), F.col("seconds"))), 3).alias("mean_park_s"),
    )


def open_ages(trail: DataFrame, now: Column) -> DataFrame:
    """The ages of open parks, oldest first: one row a park."""
    return blocked_parks(trail, now).filter(~F.col("resolved")).select("run_id", "line_no", F.round("seconds", 3).alias("age_s")).orderBy(F.desc("age_s"), "run_id", "line_no")


def circuit(trail: DataFrame, threshold: int = 3) -> DataFrame:
    """Per run: dark failures since the last success (waiting halts and lit failures change nothing) and whether the circuit is open.

    ``dark`` tells dark events; a trail without that column is of dark runs only, and null is lit.
    """
    dark = F.coalesce("dark", F.lit(False)) if "dark" in trail.columns else F.lit(True)
    ends = trail.filter(F.col("event").isin(*TERMINAL))
    success = ends.filter("event = 'run-done'").groupBy("run_id").agg(F.max("line_no").alias("_done"))
    failed = (F.col("event") == "run-halt") & ~F.coalesce(F.col("exit_code"), F.lit(1)).isin(0, 6, 8, 9) & dark
    behind = F.col("_done").isNull() | (F.col("line_no") > F.col("_done"))
    rows = ends.join(success, "run_id", "left").groupBy("run_id").agg(F.count_if(failed & behind).alias("failures"))
    return rows.withColumn("is_open", F.col("failures") >= threshold)


def worst_exit(trail: DataFrame) -> DataFrame:
    return trail.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("exit_code") != 0, F.col("exit_code"))), F.lit(0)).alias("worst"))


def with_manifest(trail: DataFrame, manifests: DataFrame) -> DataFrame:
    """``trail`` with pipeline and origin; "?" and "(none)" where the manifest names none. Runs without manifest stay."""
    named = manifests.select("run_id", F.coalesce("pipeline", F.lit("?")).alias("pipeline"), F.coalesce(F.nullif("origin", F.lit("")), F.lit("(none)")).alias("origin"))
    return trail.join(named, "run_id", "left").withColumn("pipeline", F.coalesce("pipeline", F.lit("?"))).withColumn("origin", F.coalesce("origin", F.lit("(none)")))


def throughput(trail: DataFrame, manifests: DataFrame, by: str) -> DataFrame:
    """Runs with a manifest whose last terminal is run-done or run-halt, by ``pipeline`` or ``origin``."""
    ends = with_manifest(last_terminal(trail).join(manifests.select("run_id"), "run_id", "left_semi"), manifests)
    return ends.groupBy(by).agg(F.count_if(F.col("terminal") == "run-done").alias("completed"), F.count_if(F.col("terminal") == "run-halt").alias("halted"))


def per_day_rate(trail: DataFrame, now: Column, start: Column | None = None, done: DataFrame | None = None) -> DataFrame:
    """One row: completed runs, the window's days and the rate. The window reaches from ``start``, or else the first
    run-done of a completed run, to ``now``; the rate is null below one day or without completed runs.
    """
    done = trail.join(done_runs(trail) if done is None else done, "run_id", "left_semi")
    begun = F.min(F.when(F.col("event") == "run-done", F.col("ev_at"))) if start is None else F.first(start.cast("timestamp_ntz"))
    rows = done.agg(F.count_distinct("run_id").alias("completed"), begun.alias("_from"))
    begin = F.col("_from") if start is None else start
    rows = rows.withColumn("days", F.greatest(F.lit(0.0), seconds_between(begin, now) / 86400.0)).drop("_from")
    rate = F.when((F.col("days") >= 1) & (F.col("completed") > 0), F.round(F.col("completed") / F.col("days"), 6))
    return rows.select("completed", F.round("days", 6).alias("days"), rate.alias("per_day"))


def board(trail: DataFrame, manifests: DataFrame, files: DataFrame, now: Column, start: Column | None = None, broken: DataFrame | None = None) -> DataFrame:
    """The gauge board: one row. Runs with a manifest count; with ``start`` those in its window, with all their events.

    ``broken`` (run_id) are the runs whose manifest can't be read. What several gauges read is stored once: the columns
    of the events, the last terminals and the gates.
    """
    parts = _gauges(trail, manifests, files, now, start)
    out = manifests.agg(F.count("*").alias("runs_scanned")).join(F.broadcast(skipped_runs(trail, manifests, broken).agg(F.count("*").alias("runs_skipped"))))
    for part in parts[:-1]:  # rows of one line each
        out = out.join(F.broadcast(part))
    step = F.round(F.try_divide(F.col("passes"), F.col("passes") + F.col("fails")), 6)
    return out.withColumn("step_rate", step).withColumn("retries_per_run", F.round(F.try_divide(F.col("retries"), F.col("completed")), 6))


def _gauges(trail: DataFrame, manifests: DataFrame, files: DataFrame, now: Column, start: Column | None) -> tuple:
    known = trail.join(manifests.select("run_id"), "run_id", "left_semi")
    seen = known if start is None else window_runs(known, start, manifests)
    seen = stored(seen.select("run_id", "line_no", "ev_at", "event", "node", "exit_code", "decided_by", "reasons", "artifacts"), "seen")
    totals = step_rates(seen).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("passes", "fails", "validated", "retries")])
    last = stored(last_terminal(seen), "terminals")
    done = last.filter("terminal = 'run-done'").select("run_id")
    ends = last.agg(F.count_if(F.col("terminal") == "run-halt").alias("halted"))
    runs = seen.select("run_id").distinct()
    found = stored(gates(seen, files.join(runs, "run_id", "left_semi")), "gates")
    in_window = runs.agg(F.count("*").alias("runs_in_window"))
    return totals, ends, in_window, per_day_rate(seen, now, start, done), latency_gauge(found), share_gauge(found, done), blocked_snapshot(seen, now), (seen, last)


#: Fixed values of the report: its version, and the gauges that tell of now and not of the window.
REPORT_VERSION, SNAPSHOT = 2, ("open_parks", "oldest_s", "ages_s", "triggers")


def report(row: DataFrame) -> DataFrame:
    """``board`` as one stable JSON text: keys in order, the window's gauges apart from the snapshot, nulls kept."""
    shown = lambda names: F.struct(*sorted(names))
    here = [c for c in SNAPSHOT if c in row.columns]
    body = F.struct(F.lit(REPORT_VERSION).alias("schema_version"), shown(here).alias("snapshot"), shown(set(row.columns) - set(here)).alias("window"))
    return row.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def full_report(trail: DataFrame, manifests: DataFrame, files: DataFrame, now: Column, start: Column | None = None, broken: DataFrame | None = None, triggers: DataFrame | None = None, page_ages: int = 10_000) -> DataFrame:
    """The whole board as stable JSON texts (page, report): all gauges, completed runs by pipeline and by origin and retries
    by node as maps in key order, the ages of open parks, oldest first, and the snapshots of triggers.

    Page 0 is the board, with the first ``page_ages`` ages; the other ages follow in pages of that size, which hold nothing
    else. So no age is left out, and no text grows with the parks. The pages are stored.

    ``triggers`` is a row each: name, and columns of its depths, leases and circuit. Maps have a key for every pipeline,
    origin, node and trigger there is, so they are for boards that people read.
    """
    *gauges, (seen, last) = _gauges(trail, manifests, files, now, start)
    ended = with_manifest(last, manifests).filter("terminal = 'run-done'")
    row = manifests.agg(F.count("*").alias("runs_scanned")).join(F.broadcast(skipped_runs(trail, manifests, broken).agg(F.count("*").alias("runs_skipped"))))
    maps = [(ended.groupBy("pipeline").agg(F.count("*").alias("v")), "pipeline", "by_pipeline"), (ended.groupBy("origin").agg(F.count("*").alias("v")), "origin", "by_origin")]
    maps.append((step_rates(seen).filter("retries > 0").select("node", F.col("retries").alias("v")), "node", "by_node"))
    if triggers is not None:
        maps.append((triggers.select("name", F.struct(*sorted(set(triggers.columns) - {"name"})).alias("v")), "name", "triggers"))
    for rows, key, name in maps:
        row = row.join(F.broadcast(rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias(name))))
    places, _ = ranked(blocked_parks(seen, now).filter(~F.col("resolved")).select((-F.round("seconds", 3)).alias("_a")), "_a")
    page = F.floor((F.col("_r") - 1) / page_ages).cast("int")
    pages = places.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(-F.col("_a")), False).alias("ages_s"))
    ages = pages.filter("page = 0").agg(F.coalesce(F.first("ages_s"), F.array().cast("array<double>")).alias("ages_s"))
    for part in (*gauges, ages):
        row = row.join(F.broadcast(part))
    later = pages.filter("page > 0").select("page", F.to_json(F.struct("page", F.lit(REPORT_VERSION).alias("schema_version"), F.struct("ages_s").alias("snapshot"))).alias("report"))
    return stored(report(row).select(F.lit(0).alias("page"), "report").unionByName(later), "report")


def skipped_runs(trail: DataFrame, manifests: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Runs that have a trail but no manifest that can be read, and those of ``broken`` (run_id) manifests, trail or not."""
    had = trail.select("run_id") if broken is None else trail.select("run_id").unionByName(broken.select("run_id"))
    return had.distinct().join(manifests.select("run_id"), "run_id", "left_anti")


def learning_warnings(trail: DataFrame, manifests: DataFrame, broken: DataFrame) -> DataFrame:
    """run_id and why its learnings are missing or have no pipeline, a row each: a manifest's run without a trail is
    skipped; a trail whose manifest can't be read, or that has none, is told without a pipeline.
    """
    with_trail = trail.select("run_id").distinct().withColumn("_t", F.lit(True))
    torn = broken.select("run_id").distinct().withColumn("_b", F.lit(True))
    rows = with_trail.join(manifests.select("run_id", F.lit(True).alias("_m")), "run_id", "full").join(torn, "run_id", "full")
    why = F.when(F.col("_t").isNull(), "skipped: no trail").when(F.col("_m").isNull() & F.col("_b"), "no pipeline: manifest can't be read").when(F.col("_m").isNull(), "no pipeline: no manifest")
    return rows.select("run_id", why.alias("warning")).filter("warning IS NOT NULL")


def learnings(trail: DataFrame, manifests: DataFrame, tag: str | None = None, start: Column | None = None) -> DataFrame:
    """What runs have learnt, by the raw text of its time, run and seq; pipeline is null where no manifest names one.

    ``tag`` must match; with ``start`` only readable times at or after it count.
    """
    rows = trail.filter("event = 'learn'")
    rows = rows if tag is None else rows.filter(F.col("tag") == tag)
    rows = rows if start is None else rows.filter(F.col("ev_at") >= start)
    named = rows.join(manifests.select("run_id", "pipeline"), "run_id", "left")
    return named.select("run_id", "pipeline", "node", F.coalesce("at_raw", F.lit("")).alias("at_raw"), "tag", "note", F.coalesce("seq", F.lit(0)).alias("seq")).orderBy("at_raw", "run_id", "seq")


def tags(found: DataFrame) -> DataFrame:
    """The distinct tags that are not empty, in order."""
    return found.filter("tag <> ''").select("tag").distinct().orderBy("tag")


def prefix_length(rows: DataFrame, key: str, number: str, valid: Column | None = None, cap: int | None = None) -> DataFrame:
    """The largest N such that 1..N are all present, at most ``cap``; with ``valid`` all rows of each must be valid."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    some = rows.groupBy(key, number).agg(F.bool_and(ok).alias("_ok"))
    w = Window.partitionBy(key).orderBy(number)
    ranked = some.filter(F.col(number) >= 1).withColumn("_good", F.when(F.col("_ok"), 1)).withColumn("r", F.count("_good").over(w))
    best = F.coalesce(F.max(F.when(F.col("_ok") & (F.col("r") == F.col(number)), F.col("r"))), F.lit(0))
    found = ranked.groupBy(key).agg(best.cast("int").alias("prefix"))
    found = some.select(key).distinct().join(found, key, "left").withColumn("prefix", F.coalesce("prefix", F.lit(0)))
    return found if cap is None else found.withColumn("prefix", F.least(F.lit(cap), "prefix"))


def last_of_each(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key; Spark keeps ``n`` a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def trail_context(trail: DataFrame, events: int = 12, learnings: int = 5) -> DataFrame:
    """Every run's last events and last learnings (kind ``event`` and ``learning``), each numbered from 1 in the order of
    the file; a learning among the last events counts for both.
    """
    out = []
    for kind, rows, n in (("event", trail, events), ("learning", trail.filter("event = 'learn'"), learnings)):
        last = last_of_each(rows, "run_id", ["line_no"], n)
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("line_no"))
        out.append(last.withColumn("kind", F.lit(kind)).withColumn("place", place))
    return out[0].unionByName(out[1])


def keep_plan(runs: DataFrame, now: Column, keep_last: int | None, keep_days: int | None, needs_human_too: bool = False) -> DataFrame:
    """Retention: run_id, pipeline, verdict and why, by run; nothing is deleted here.

    Protection comes first: pinned, waiting (a halt that waits; one that needs a human only without
    ``needs_human_too``), running, locked. A run without a creation time can't be judged and is skipped. Then a run
    stays if it is among its pipeline's newest ``keep_last`` (protected ones count) or no older than ``keep_days``;
    without both rules all stay. Only ``keep_last`` rows a pipeline and task are shuffled for the ranks.
    """
    rank = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("created_at"), F.desc("run_id")))
    newest = runs.filter("created_at IS NOT NULL").select("run_id", "pipeline", "created_at").withColumn("_r", rank).filter(F.col("_r") <= (keep_last or 0))
    rows = runs.join(newest.select("run_id", F.lit(True).alias("_new")), "run_id", "left")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    kind = exit_class(F.col("last_exit"))["waiting_kind"]
    waits = kind.isin("capacity", "blocked") | ((kind == "needs_human") & F.lit(not needs_human_too))
    by_last = F.coalesce("_new", F.lit(False)) if keep_last is not None else F.lit(False)
    by_days = age <= keep_days * 86400 if keep_days is not None else F.lit(False)
    rules = "+".join(name for name, n in (("keep-days", keep_days), ("keep-last", keep_last)) if n is not None)
    verdict = (
        F.when(F.col("pinned"), "pinned")
        .when(F.coalesce(waits, F.lit(False)), "waiting")
        .when(F.col("status") == "running", "running")
        .when(F.col("locked"), "locked")
        .when(F.lit(not rules), "retained")
        .when(F.col("created_at").isNull(), "skipped")
        .when(by_last | by_days, "retained")
        .otherwise("delete")
    )
    return rows.select("run_id", "pipeline", verdict.alias("verdict")).withColumn("reason", F.when(F.col("verdict") == "delete", rules))


def gc_candidates(plan: DataFrame) -> DataFrame:
    """What a plan would delete, by run."""
    return plan.filter("verdict = 'delete'").select("run_id", "pipeline", "reason").orderBy("run_id")
