"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule has a regular expression, the literal tokens that every URL it matches must hold, and a verdict. The tokens of
all URLs are counted for the rules' tokens only; each rule is filed under the one that fewest URLs hold. A URL's
tokens fetch their rules, and only those regular expressions run. The rule of highest rank wins; where none fits, the
verdict is allow. Rules are a table of any size (by default some 1500 patterns of spam): the index is joined, so Spark
broadcasts it below its threshold and shuffles it beyond; its tokens alone are broadcast up to FEW_TOKENS, which is
checked. Tokens with more than HEAVY_SHARE of all URL tokens are at most 1 / HEAVY_SHARE; their URLs are dealt to SALTS
tasks each, and their rules, copied as often, go along.

Expressions see the host and the path with a ``#`` between, which neither can hold. Host rules (host, path) fit a host,
its subdomains and paths that start with theirs; they are compiled to the same kind of rule and rank before patterns,
longest first.

Defined results: a rule without tokens is an error, since no URL would fetch it; of rules with one rank the last by name
and pattern wins; null and URLs without ``://`` have an empty host and path and no rule; equal URLs get equal verdicts
on rows of their own; an empty table gives an empty result; only the id and the URL are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

TOKEN = "[a-z0-9]+"
#: Share of all URL tokens from which one is heavy, and the tasks that a heavy token's URLs are dealt to.
HEAVY_SHARE, SALTS = 1 / 1000, 32
#: Tokens of rules up to which they are broadcast: a few MB.
FEW_TOKENS = 100_000
RULES_SCHEMA = "name string, pattern string, tokens array<string>, verdict string, rank long"


@dataclass(frozen=True)
class Rule:
    name: str | None  # reported where the rule decides; patterns report none
    pattern: str  # of the lower-case host, a #, and the path
    tokens: tuple[str, ...]  # all of them are in every URL that matches
    verdict: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """``host`` and its subdomains, paths that start with ``path``. Tokens at the path's open end are not literal."""
    pattern = rf"^(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}"
    closed = path if path.endswith("/") else path[: path.rfind("/") + 1]
    return Rule(host + path, pattern, tuple(re.findall(TOKEN, host + closed.lower())), verdict, 1_000_000 + len(host + path))


def pattern_rule(pattern: str, tokens: Iterable[str], verdict: str = "block", rank: int = 0) -> Rule:
    return Rule(None, pattern, tuple(tokens), verdict, rank)


HOST_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)
#: Words in a host's labels that mark spam, each with what must stand beside it.
WORD_RULES = (
    pattern_rule(r"^[^#]*(?:^|[.-])spam[.-]", ["spam"]),
    pattern_rule(r"^[^#]*(?:^|[.-])cheap-[a-z]+\.", ["cheap"]),
    pattern_rule(r"^[^#]*(?:^|[.-])pills[.-]", ["pills"]),
    pattern_rule(r"^[^#]*(?:^|[.-])casino[.-]", ["casino"]),
    pattern_rule(r"^[^#]*(?:^|[.-])xxx[.-]", ["xxx"]),
    pattern_rule(r"^[^#]*(?:^|[.-])click-bait[.-]", ["click", "bait"]),
)
#: What spam offers, and how; last labels of hosts that go with it.
OFFERS = ("best", "buy", "cheap", "discount", "fast", "free", "hot", "instant", "online", "real", "top", "win")
GOODS = (
    "bets", "bitcoin", "bonus", "cash", "casino", "cialis", "credit", "dating", "diet", "escort", "followers", "forex", "jackpot", "loans",
    "lottery", "meds", "payday", "pharma", "pills", "poker", "porn", "replica", "slots", "streams", "tickets", "viagra", "watches",
)
ENDS = ("bid", "click", "download", "loan", "men", "party", "racing", "review", "top", "xyz")


def offer_rules() -> tuple[Rule, ...]:
    """A rule for every pair of an offer and goods, either first, in a host's label or a path's segment, and for goods in
    a host with one of ENDS: some 1500, all of which share their tokens with others, so which one is rarest matters.
    """
    out = []
    for one, other in ((x, y) for o in OFFERS for g in GOODS for x, y in ((o, g), (g, o))):
        out.append(pattern_rule(rf"^[^#]*(?:^|[.-]){one}-{other}[.-]", [one, other]))
        out.append(pattern_rule(rf"#.*/{one}[-_]{other}(?:[-_/.]|$)", [one, other]))
    out += [pattern_rule(rf"^[^#]*(?:^|[.-]){g}[.-](?:[^#]*\.)?{end}#", [g, end]) for g in GOODS for end in ENDS]
    return tuple(out)


PATTERN_RULES = (*WORD_RULES, *offer_rules())


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path: up to ``/ ? #`` and up to ``? #``, after the first ``://``."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.substring_index(F.col(url), "://", 1))
    after = F.expr(f"substring({url}, length(_before) + 4)")
    host = F.translate(F.regexp_extract("_after", r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("_after", r"(?s)^[^/?#]*([^?#]*)", 1)
    return (
        pages.withColumn("_before", rest)
        .withColumn("_after", F.coalesce(after, F.lit("")))
        .withColumn("host", host)
        .withColumn("path", path)
        .drop("_before", "_after")
    )


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows; a table of the same columns may be read from anywhere instead."""
    return spark.createDataFrame([(r.name, r.pattern, list(r.tokens), r.verdict, r.rank) for r in rules], RULES_SCHEMA)


def token_index(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, name, pattern, verdict, rank): every rule once, under its token that the fewest URLs hold.

    ``counts``: (token, n) of the URLs' tokens; a token that no URL holds counts 0.
    """
    some = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("rule without tokens: "), "pattern")).cast("array<string>"))
    filed = rules.distinct().withColumn("token", F.explode(some))
    counted = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("name", "pattern", "verdict", "rank").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def verdicts(pages: DataFrame, rules: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule and verdict. ``rules``: see RULES_SCHEMA; by default the rules above."""
    rules = rules if rules is not None else rule_table(pages.sparkSession, (*HOST_RULES, *PATTERN_RULES))
    # row numbers of one evaluation: written, since the tokens' counts and the verdicts read them both
    rows = written(with_parts(pages.select(page_id, url), url).select(F.monotonically_increasing_id().alias("_row"), page_id, "host", "path"), "urls")
    text = F.concat("host", F.lit("#"), "path")
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})")))
    tokens = rows.select(F.explode(found).alias("token"))
    wanted = written(rules.select(F.explode("tokens").alias("token")).distinct(), "rule-tokens")
    few = wanted.count() <= FEW_TOKENS
    # few of the rules' tokens are broadcast, so that a hot token's URLs stay where they are; more of them are looked up
    # behind the counts, which combine before their shuffle, and among the salted tokens below
    kept = (lambda rows: rows.join(F.broadcast(wanted), "token", "left_semi")) if few else (lambda rows: rows)
    counts = kept(tokens).groupBy("token").agg(F.count("*").alias("n"))
    counts = written(counts if few else counts.join(wanted, "token", "left_semi"), "token-counts")
    limit = max(1, int((counts.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE))
    heavy = counts.filter(F.col("n") > limit).select("token", F.lit(True).alias("_heavy"))  # at most 1 / HEAVY_SHARE rows
    index = token_index(counts, rules).join(F.broadcast(heavy), "token", "left")
    index = index.withColumn("_salt", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_heavy")
    held = kept(rows.withColumn("token", F.explode(found))).join(F.broadcast(heavy), "token", "left")
    salted = held.withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).otherwise(0))
    fetched = salted.join(index, ["token", "_salt"])
    best = F.max_by(F.struct("name", "verdict"), F.struct("rank", "name", "pattern"))
    hits = fetched.filter(F.expr("concat(host, '#', path) rlike pattern")).groupBy("_row").agg(best.alias("_best"))
    judged = rows.join(hits, "_row", "left")
    return judged.select(page_id, "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


def op9_url_rules(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "pages"))


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_O, _G = "|".join(OFFERS), "|".join(GOODS)
#: The same as PATTERN_RULES in few expressions.
_PATTERNS = (*(r.pattern for r in WORD_RULES), rf"^[^#]*(?:^|[.-])(?:(?:{_O})-(?:{_G})|(?:{_G})-(?:{_O}))[.-]", rf"#.*/(?:(?:{_O})[-_](?:{_G})|(?:{_G})[-_](?:{_O}))(?:[-_/.]|$)", rf"^[^#]*(?:^|[.-])(?:{_G})[.-](?:[^#]*\.)?(?:{'|'.join(ENDS)})#")
ORACLE_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
patterns(pattern) AS (VALUES {", ".join(f"({_sql_text(p)})" for p in _PATTERNS)}),
m AS (SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM h JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path) GROUP BY r),
s AS (SELECT DISTINCT r FROM h JOIN patterns ON regexp_matches(h.host || '#' || h.path, pattern))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN s.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN m USING (r) LEFT JOIN s USING (r)
"""
