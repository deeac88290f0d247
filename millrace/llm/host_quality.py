"""Quality rules judged by host.

Every document is measured, the failures of each rule are summed by host, the hosts' failure rates are shrunk with a
beta prior fitted to all hosts by moments, and the host's verdict is joined back: on a *strict* host a document that
fails any rule goes; elsewhere only the base rules reject. A document that fails no rule is always kept. The prior's
mean and spread are those of the hosts' own rates: the binomial noise of counting few documents is taken off the
observed variance. A host is strict when its shrunk rate for a rule lies STRICT_SPREADS of these above the mean, so
the bar comes from the corpus; where hosts differ by no more than chance, none is strict. In tables of documents the
host is the ``source`` column; any column of domains will do.

Defined results: a null text has no words and fails the base rules; documents without a host are judged alone; equal
rows get equal results; an empty table gives an empty result; other columns, whatever their names, pass through
``judge`` untouched (the added columns are listed in ADDED and must not occur in the input).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import SPACES, join_per_key, tidy, written
from millrace.llm.encode import steps

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"

#: Rules as SQL over the measures; a document that breaks one of BASE_RULES is rejected on every host.
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
SOFT_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "long_words": "word_chars > 12 * n_words",
    "dup_lines": "20 * n_dup_lines > n_words",
    "some_repeats": "100 * n_repeat_words > 25 * n_words",
}
RULES = BASE_RULES | SOFT_RULES
#: A host is strict when its shrunk failure rate for one of the rules is this many of the prior's standard deviations
#: above the prior's mean.
STRICT_SPREADS = 2.0
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0
ADDED = [*MEASURES, "base_failed", "host_strict", "kept"]

_STRUCT = pa.struct([(m, pa.int64()) for m in MEASURES])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:  # the codes of three words would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + a[2:]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= twice
    return int(mark.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measured(text: pa.Array) -> pa.Array:
    rows = [measure_text(t) for part in steps(text) for t in part.to_pylist()]  # a few texts unpacked at a time
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(MEASURES)
    tidy()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_STRUCT))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of ``text`` and base_failed."""
    out = docs.withColumn("_m", measured(F.col(text))).select("*", *[F.col(f"_m.{m}").alias(m) for m in MEASURES]).drop("_m")
    return out.withColumn("base_failed", F.expr(" OR ".join(f"({r})" for r in BASE_RULES.values())))


def strict_hosts(measures: DataFrame, host: str) -> tuple[DataFrame, int]:
    """One row per non-null host: its documents (n_host) and host_strict; and the number of all documents.

    Only sums over hosts reach the driver: one row, whatever the input.
    """
    sums = (
        measures.filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("n_host"), *[F.count_if(F.expr(r)).alias(f"f_{k}") for k, r in RULES.items()])
    )
    sums = written(sums, "host-rules")
    total = sums.agg(F.sum("n_host").alias("n"), *[F.sum(f"f_{k}").alias(k) for k in RULES]).first()
    n = total["n"] or 0
    mean = {k: (total[k] or 0) / n if n else 0.0 for k in RULES}
    spread = sums.agg(
        F.count("*").alias("hosts"),
        *[F.sum(F.col("n_host") * F.pow(F.col(f"f_{k}") / F.col("n_host") - F.lit(mean[k]), 2.0)).alias(k) for k in RULES],
    ).first()
    strict = F.lit(False)
    for k, m in mean.items():
        # the noise of counting adds m (1 - m) / n_host to a host's variance: weighed by n_host, that is once for every host
        v = ((spread[k] or 0.0) - spread["hosts"] * m * (1 - m)) / n if n else 0.0
        strength = min(MAX_STRENGTH, max(MIN_STRENGTH, m * (1 - m) / v - 1)) if v > 0 else MAX_STRENGTH
        bar = m + STRICT_SPREADS * math.sqrt(m * (1 - m) / (strength + 1))
        strict = strict | ((F.col(f"f_{k}") + F.lit(m * strength)) / (F.col("n_host") + F.lit(strength)) > F.lit(bar))
    return sums.select(host, "n_host", strict.alias("host_strict")), n


def judge(measures: DataFrame, hosts: DataFrame, total: int, host: str) -> DataFrame:
    """Join the hosts' verdicts back to documents with measures: adds host_strict and kept."""
    out = join_per_key(measures, hosts, host, "n_host", total).drop("n_host")
    strict = F.coalesce("host_strict", F.lit(False))
    soft = F.expr(" OR ".join(f"({r})" for r in SOFT_RULES.values()))
    return out.withColumn("host_strict", strict).withColumn("kept", ~F.col("base_failed") & ~(strict & soft))


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per document, without its text: id, host and the columns of ADDED."""
    rows = written(with_measures(docs.select(doc_id, host, text), text).drop(text), "quality")
    hosts, total = strict_hosts(rows, host)
    return judge(rows, hosts, total, host)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The documents are written once with their measures, so that no text is measured twice: hosts read the measures
    alone, the verdicts are joined to the stored rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), host, text)  # columns of any name come through
    rows = written(with_measures(rows, text).drop(text), "measured")
    hosts, total = strict_hosts(rows, host)
    return judge(rows, hosts, total, host).filter("kept").select("_doc.*")


def op1_host_quality(spark, sf_dir):
    from millrace.llm.common import table

    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


_any = " OR ".join(f"({r})" for r in SOFT_RULES.values())
_shrunk = " OR ".join(f"(f_{k} + m_{k} * s_{k}) / (n_host + s_{k}) > m_{k} + {STRICT_SPREADS} * sqrt(m_{k} * (1 - m_{k}) / (s_{k} + 1))" for k in RULES)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM l)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, len(l.w) AS n_words,
    coalesce(list_sum(list_transform(l.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(d.t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(d.t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
h AS (SELECT source, count(*) AS n_host, {", ".join(f"count(*) FILTER ({r}) AS f_{k}" for k, r in RULES.items())} FROM m WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(n_host) AS n, {", ".join(f"sum(f_{k}) / sum(n_host) AS m_{k}" for k in RULES)} FROM h),
v AS (SELECT {", ".join(f"(sum(n_host * (f_{k} / n_host - m_{k}) ** 2) - count(*) * any_value(m_{k} * (1 - m_{k}))) / any_value(n) AS v_{k}, any_value(m_{k}) AS m_{k}" for k in RULES)} FROM h, a),
p AS (SELECT {", ".join(f"m_{k}, CASE WHEN v_{k} > 0 THEN least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, m_{k} * (1 - m_{k}) / v_{k} - 1)) ELSE {MAX_STRENGTH} END AS s_{k}" for k in RULES)} FROM v),
s AS (SELECT source, {_shrunk} AS host_strict FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({" OR ".join(f"({r})" for r in BASE_RULES.values())}) AS base_failed,
  NOT ({" OR ".join(f"({r})" for r in BASE_RULES.values())}) AND NOT (coalesce(host_strict, false) AND ({_any})) AS kept
FROM m LEFT JOIN s USING (source)
"""
