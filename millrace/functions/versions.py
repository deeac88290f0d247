"""Versions and requirements as columns: versions have a key that sorts, requirements are intervals of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import stored

# The grammar of versions, the rank of pre-releases, and the operators of clauses (longer ones first).
VERSION = r"^v?([0-9]+(?:\.[0-9]+)*)(?:(a|b|rc)([0-9]+))?(?:\.post([0-9]+))?(?:\.dev([0-9]+))?$"
PRE = {"a": 0, "b": 1, "rc": 2}
OPERATORS = ("==", "!=", ">=", "<=", "~=", ">", "<")
CLAUSE = r"^(==|!=|>=|<=|~=|>|<)?\s*(.*?)(\.\*)?$"


def _numbers(*values: Column | int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in values])


def _release(text: Column) -> Column:
    """A release's numbers without zeros at the end, so that 1.0 and 1 are one; null for numbers beyond a long."""
    numbers = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
    last = F.aggregate(F.sequence(F.lit(1), F.size(numbers)), F.lit(0), lambda s, k: F.when(F.element_at(numbers, k) != 0, k).otherwise(s))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), F.slice(numbers, F.lit(1), last))


def version_key(text: Column) -> Column:
    """Struct (release, pre, post, dev) of arrays of numbers that sorts as versions do: a pure dev release comes before the
    pre-releases, those before the final one, that before its post releases. Null for what is no version.
    """
    t = F.trim(text)
    part = lambda k: F.nullif(F.regexp_extract(t, VERSION, k), F.lit(""))
    rank = F.lit(None).cast("int")
    for name, value in PRE.items():
        rank = F.when(part(2) == name, value).otherwise(rank)
    number = lambda k: part(k).try_cast("bigint")
    pre = F.when(part(2).isNotNull(), _numbers(0, rank, number(3))).when(part(4).isNull() & part(5).isNotNull(), _numbers(-1, 0, 0)).otherwise(_numbers(1, 0, 0))
    post = F.when(part(4).isNotNull(), _numbers(1, number(4))).otherwise(_numbers(0, 0))
    dev = F.when(part(5).isNotNull(), _numbers(0, number(5))).otherwise(_numbers(1, 0))
    release = _release(part(1))
    return F.when(t.rlike(VERSION) & release.isNotNull(), F.struct(release.alias("release"), pre.alias("pre"), post.alias("post"), dev.alias("dev")))


def _lowest(release: Column) -> Column:
    """A key under all of a release's."""
    return F.struct(release.alias("release"), _numbers(-2, 0, 0).alias("pre"), _numbers(0, 0).alias("post"), _numbers(0, 0).alias("dev"))


def _raised(release: Column) -> Column:
    """The release after all that start with ``release``: its last number plus one."""
    return F.concat(F.slice(release, F.lit(1), F.size(release) - 1), F.array(F.element_at(release, -1) + 1))


def clauses(spec: Column) -> Column:
    """The clauses of a requirement, an array of (op, low, high, low_in, high_in): intervals of keys, a null bound being
    none; ``!=`` tells what lies outside. Null where one clause is malformed, or there is none.
    """

    def one(clause: Column) -> Column:
        c = F.trim(clause)
        op = F.coalesce(F.nullif(F.regexp_extract(c, CLAUSE, 1), F.lit("")), F.lit("=="))
        text, wild = F.trim(F.regexp_extract(c, CLAUSE, 2)), F.regexp_extract(c, CLAUSE, 3) != ""
        key = version_key(text)
        numbers = F.transform(F.split(F.regexp_extract(text, VERSION, 1), r"\."), lambda x: x.try_cast("bigint"))
        stem = F.slice(numbers, F.lit(1), F.size(numbers) - 1)  # what ~= keeps
        good = (c != "") & key.isNotNull() & (~wild | op.isin("==", "!=")) & ((op != "~=") | (F.size(numbers) >= 2))
        bare = F.when(F.size(stem) > 0, stem).otherwise(numbers)
        none = F.lit(None).cast(KEY)
        low = F.when(wild, _lowest(_stripped(numbers))).when(op.isin("==", "!=", ">=", ">", "~="), key).otherwise(none)
        high = F.when(wild, _lowest(_raised(numbers))).when(op == "~=", _lowest(_raised(bare))).when(op.isin("==", "!=", "<=", "<"), key).otherwise(none)
        low_in, high_in = op != ">", ~(wild | op.isin("~=", "<"))
        return F.when(good, F.struct(F.when(op == "!=", op).otherwise("==").alias("op"), low.alias("low"), high.alias("high"), low_in.alias("low_in"), high_in.alias("high_in")))

    found = F.transform(F.split(spec, ","), one)
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def _stripped(release: Column) -> Column:
    last = F.aggregate(F.sequence(F.lit(1), F.size(release)), F.lit(0), lambda s, k: F.when(F.element_at(release, k) != 0, k).otherwise(s))
    return F.slice(release, F.lit(1), last)


KEY = "struct<release:array<bigint>,pre:array<bigint>,post:array<bigint>,dev:array<bigint>>"


def _inside(c: Column, key: Column) -> Column:
    above = c["low"].isNull() | (key > c["low"]) | (c["low_in"] & (key == c["low"]))
    below = c["high"].isNull() | (key < c["high"]) | (c["high_in"] & (key == c["high"]))
    return above & below


def satisfied(spec: Column, version: Column) -> Column:
    """Whether a version meets every clause of a requirement; null where either is malformed."""
    both = F.array(F.struct(version_key(version).alias("key"), clauses(spec).alias("told")))  # bound to names

    def one(x: Column) -> Column:
        key, told = x["key"], x["told"]
        meets = F.forall(told, lambda c: F.when(c["op"] == "!=", ~_inside(c, key)).otherwise(_inside(c, key)))
        return F.when(key.isNotNull() & told.isNotNull(), meets)

    return F.transform(both, one)[0]


def matches(requirements: DataFrame, versions: DataFrame) -> DataFrame:
    """The pairs of ``requirements`` (spec) and ``versions`` (version) that meet, with all columns of both.

    Texts that recur are read and compared once: what is matched are distinct requirements and distinct versions, and the
    pairs that meet are joined with the rows. A requirement is one interval of keys: the greatest lower and the least upper
    bound of its clauses. It is filed under every first number that some version has within its bounds, and meets only
    versions with that number there; then the clauses decide. Malformed ones meet nothing.
    """
    texts = stored(versions.select("version").distinct(), "versions")
    keyed = texts.withColumn("_key", version_key(F.col("version"))).filter("_key IS NOT NULL")
    keyed = keyed.withColumn("_major", F.coalesce(F.try_element_at("_key.release", F.lit(1)), F.lit(0)))
    majors = keyed.select("_major").distinct()
    some = requirements.select("spec").distinct().withColumn("_c", clauses(F.col("spec"))).filter("_c IS NOT NULL")
    own = F.filter("_c", lambda c: c["op"] == "==")
    first = lambda key: F.coalesce(F.try_element_at(key["release"], F.lit(1)), F.lit(0).cast("bigint"))
    low = F.array_max(F.transform(own, lambda c: F.when(c["low"].isNotNull(), first(c["low"]))))
    high = F.array_min(F.transform(own, lambda c: F.when(c["high"].isNotNull(), first(c["high"]))))
    bounds = some.select("spec", "_c", low.alias("_low"), high.alias("_high"))
    # distinct requirements beside distinct first numbers: both are few next to the rows, and each spec looks up its own
    spans = majors.agg(F.sort_array(F.collect_set("_major")).alias("_majors"))  # one row; first numbers only
    within = F.filter("_majors", lambda m: (F.coalesce(m >= F.col("_low"), F.lit(True))) & (F.coalesce(m <= F.col("_high"), F.lit(True))))
    near = bounds.join(F.broadcast(spans)).select("spec", "_c", F.explode(within).alias("_major")).join(keyed, "_major")
    meets = F.forall("_c", lambda c: F.when(c["op"] == "!=", ~_inside(c, F.col("_key"))).otherwise(_inside(c, F.col("_key"))))
    pairs = stored(near.filter(meets).select("spec", "version"), "pins")
    return versions.join(pairs, "version").join(requirements, "spec").select(*requirements.columns, *versions.columns)
