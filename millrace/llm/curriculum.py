r"""Mixing sources to target weights along a curriculum. DataFrame functions only.

Targets: the sources, by code point with null last, weigh WEIGHTS in turn and share the words of all documents; a
target stops at EPOCHS times its source's words and the excess is shared again by weight. That has a closed form: with
the sources in ascending order of EPOCHS * words / weight, the stopped ones are a prefix.

Positions: a source's weight follows a schedule over training time 0 to 1, piecewise linear. Its integral, scaled to
the target, is the source's cumulative demand in words. The documents of a source stand one behind the other, by a
hash of their id and size, epoch after epoch; the demand is inverted at the middle of each copy and gives the copy's time. Its
position is the whole mix's cumulative demand by that time, in words: equal stretches of position ask for equally many
words, and the sources' shares in them follow their schedules. Documents are range-sorted by position.

Running totals within a source go over BUCKETS ranges of the hash, so a source with a third of all documents is dealt
to as many tasks as any other. Sources may be as many as documents: their order, and the running totals of what they
stop at, go over ranges of sorted tables.

Defined results: a null text has no words and is taken 0 times, like any document without words, and has no position;
null is a source; rows with equal ids are told apart by size and text; an empty table gives an empty result; other
columns, whatever their names, pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN, table, written

WEIGHTS, EPOCHS = (5, 2, 1), 3
#: One schedule for each of WEIGHTS: (time, factor) knots. Heavy sources fade out, light ones fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: The hash of an id and a size is md5; its first three digits are the bucket, so rows without an id are dealt as well.
BUCKETS = 16**3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, which are numbered ``_p``."""
    return written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), name)


def with_bases(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``placed`` with each of ``sums`` over all ranges before a row's own, and over all (``<name>_all``): a running total is
    the first and a window within the range. Only one row a range is put in order in one task and broadcast.
    """
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_p").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    both = [c for k in sums for c in (F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(k), F.sum(k).over(Window.partitionBy()).alias(f"{k}_all"))]
    return placed.join(F.broadcast(ranges.select("_p", *both)), "_p")


def targets(sized: DataFrame, source: str = "source") -> DataFrame:
    """One row per source: source_size, weight class and target."""
    by_name = [F.col(source).asc_nulls_last()]
    sums = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    named = with_bases(in_ranges(sums, by_name, "sources"), {"_first": F.lit(1)})
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_p").orderBy(*by_name)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("_class") + 1).cast("long")
    weighed = named.withColumn("_class", (place % len(WEIGHTS)).cast("int")).select(source, "source_size", "_class", weight.alias("_w"), (F.col("source_size") * EPOCHS).alias("_cap"))
    full_at = F.col("_cap") / F.col("_w")
    by_cap = [full_at.asc(), *by_name]
    placed = in_ranges(weighed, by_cap, "capped")
    capped = with_bases(placed, {"_caps": F.col("_cap"), "_ws": F.col("_w"), "_words": F.col("source_size")})
    within = Window.partitionBy("_p").orderBy(*by_cap).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda total, one: F.col(total) + F.coalesce(F.sum(one).over(within), F.lit(0))
    level = (F.col("_words_all") - before("_caps", "_cap")).cast("double") / (F.col("_ws_all") - before("_ws", "_w"))
    found = capped.withColumn("_level", level).withColumn("_stops", (F.col("_w") * F.col("_level") > F.col("_cap")).cast("int"))
    # the level at the first source that does not stop holds for it and all behind it
    open_level = found.agg(F.min_by("_level", F.struct("_stops", full_at, F.col(source).isNull(), F.col(source)))).first()[0]
    return placed.select(source, "source_size", "_class", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(open_level).cast("double")).alias("target"))


def inverted(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which ``share`` (0 to 1) of the schedule's integral is reached."""
    area = [(b[1] + a[1]) * (b[0] - a[0]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, done, out = sum(area), 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1), one in zip(schedule, schedule[1:], area, strict=False):
        need = share * F.lit(whole) - F.lit(done)  # the part of this segment's area that is asked for
        slope = (w1 - w0) / (t1 - t0)
        grown = need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * (2 * slope))) - w0) / slope
        done += one
        pieces.append((share * F.lit(whole) <= F.lit(done), F.lit(t0) + grown))
    for reached, time in reversed(pieces):
        out = F.when(reached, time).otherwise(out)
    return F.least(F.lit(schedule[-1][0]), F.greatest(F.lit(schedule[0][0]), out))


def integral(time: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The share of the schedule's integral that is reached by ``time``: the inverse of ``inverted``."""
    whole = sum((b[1] + a[1]) * (b[0] - a[0]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    out = F.lit(0.0)
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        t = F.least(F.lit(t1 - t0), F.greatest(F.lit(0.0), time - F.lit(t0)))
        out = out + t * (F.lit(w0) + t * F.lit((w1 - w0) / (t1 - t0) / 2))
    return out / F.lit(whole)


def assigned(sized: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``sized`` (id, source, size, tie) with source_size, target, class, demands and ``_at``, the words before it."""
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    keyed = sized.withColumn("_h", F.md5(name.cast("binary")))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, 3)).withColumn("_null", F.col(source).isNull()).withColumn("_s", F.coalesce(source, F.lit("")))
    key = ["_null", "_s", "_b"]
    sums = keyed.groupBy(*key).agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("_null", "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(sized, source)
    # what the sources of each class ask for in all: one number a schedule
    asked = goal.agg(*[F.coalesce(F.sum(F.when(F.col("_class") == k, F.col("target"))), F.lit(0.0)).alias(f"_d{k}") for k in range(len(SCHEDULES))]).first()
    goal = goal.select("*", *[F.lit(float(x)).alias(c) for c, x in asked.asDict().items()])
    goal = goal.withColumn("_null", F.col(source).isNull()).withColumn("_s", F.coalesce(source, F.lit(""))).drop(source)
    bases = sums.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n").join(goal, ["_null", "_s"])
    within = Window.partitionBy(*key).orderBy("_h", doc_id, "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(bases, key).withColumn("_at", F.col("_before") + F.col("_in")).drop("_before", "_in", "_null", "_s", "_b", "tie")


def words_of_epoch(epoch: Column) -> Column:
    """Words of a document that the mix takes in one epoch."""
    left = F.col("target").cast("long") - epoch * F.col("source_size") - F.col("_at")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def position(epoch: Column, words: Column) -> Column:
    """Training position, in words of the whole mix, of a document's copy."""
    share = (epoch * F.col("source_size") + F.col("_at") + words / F.lit(2.0)) / F.col("target")
    time = inverted(share, SCHEDULES[-1])
    for k, schedule in enumerate(SCHEDULES[:-1]):
        time = F.when(F.col("_class") == k, inverted(share, schedule)).otherwise(time)
    return sum((F.col(f"_d{k}") * integral(time, schedule) for k, schedule in enumerate(SCHEDULES)), F.lit(0.0))


def quotas(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: id, size, source_size, target, taken and the position of its first copy (null: none)."""
    sized = written(docs.select(doc_id, source, n_words(text).alias("size"), F.xxhash64(text).alias("tie")), "sizes")
    rows = assigned(sized, doc_id, source)
    taken = sum((words_of_epoch(F.lit(e)) for e in range(EPOCHS)), F.lit(0))
    first = words_of_epoch(F.lit(0))
    out = rows.withColumn("taken", taken.cast("long")).withColumn("position", F.when(first > 0, F.round(position(F.lit(0), first), 3)))
    return out.select(doc_id, "size", "source_size", "target", "taken", "position").repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id)


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents in training order, as often as the mix takes them; a cut copy counts if half of it is taken."""
    # row numbers depend on how files are cut, so they are made once and written with the documents
    keys = [F.col(doc_id).alias("_id"), F.col(source).alias("_source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie")]
    whole = written(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row"), *keys), "numbered")
    copies = (
        assigned(whole.select("_row", "_id", "_source", "size", "tie"), "_id", "_source")
        .withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("_words", words_of_epoch(F.col("_epoch")))
        .filter((F.col("_words") > 0) & (2 * F.col("_words") >= F.col("size")))
        .select("_row", position(F.col("_epoch"), F.col("_words")).alias("_position"), "_epoch")
    )
    ordered = whole.select("_doc", "_row", "_id", "tie").join(copies, "_row").repartitionByRange("_position", "_id", "tie")
    return ordered.sortWithinPartitions("_position", "_id", "tie", "_epoch").select("_doc.*")


def op4_curriculum(spark, sf_dir):
    return quotas(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS w, source_size * {EPOCHS} AS cap FROM s),
l AS (SELECT *, ((SELECT sum(size) FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT level FROM l ORDER BY (w * level > cap), cap / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, w, least(cap::DOUBLE, w * (SELECT level FROM f)) AS target FROM l),
q AS (SELECT coalesce(sum(target) FILTER (w = 5), 0) AS d0, coalesce(sum(target) FILTER (w = 2), 0) AS d1, coalesce(sum(target) FILTER (w = 1), 0) AS d2 FROM t),
p AS (SELECT d.doc_id, size, source_size, target, w,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - before)) AS first FROM p),
-- the schedules are straight lines a + b x, with integral a x + b x x / 2 (of 1 in all), which a root inverts
u AS (SELECT *, CASE w WHEN 5 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE w WHEN 5 THEN -1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b, (before + first / 2) / target AS share FROM o),
x AS (SELECT *, CASE WHEN b = 0 THEN share ELSE (sqrt(greatest(0, a * a + 2 * b * share)) - a) / b END AS x FROM u)
SELECT doc_id, size, source_size, target,
  ({" + ".join(f"greatest(0, least(size, floor(target)::BIGINT - {e} * source_size - before))" for e in range(EPOCHS))})::BIGINT AS taken,
  CASE WHEN first > 0 THEN round(d0 * (1.5 * x - 0.5 * x * x) + d1 * x + d2 * (0.5 * x + 0.5 * x * x), 3) END AS position
FROM x, q
"""
