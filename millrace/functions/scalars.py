"""Scalar functions on columns; all but ``step_sentinel`` stay in the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The waiting exit codes and their kinds.
WAITING = {6: "needs_human", 8: "capacity", 9: "blocked"}
HUMAN, MACHINE = ("tty", "external"), ("default", "flag")
# Fixed value: the grammar of item names; the id ends in a letter or digit, and the last ``-r`` starts the revision.
ITEM_NAME = r"^p([0-9])-([a-z][a-z0-9]*)-([a-z0-9](?:[a-z0-9._-]*[a-z0-9])?)-r([a-z0-9][a-z0-9._-]*)\.json$"
NAME_MAX = 255


def slug(url: Column) -> Column:
    """Host of a URL (or the bare text) without user, port, www. and its last label, other characters as single dashes."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.lower(F.regexp_extract(place, r"^(?:.*@)?([^:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(host, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dash(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("-"), x)).otherwise("")


def short(x: Column, n: int) -> Column:
    """The first n characters; with negative n all but the last -n."""
    return F.substring(x, 1, n) if n >= 0 else F.left(x, F.greatest(F.lit(0), F.length(x) + n))


def rev_token(at: Column, version: Column) -> Column:
    """``r``, the epoch second on 11 digits and the version on 6; null where either does not fit."""
    second = F.unix_seconds(at.cast("timestamp"))
    fits = (second >= 0) & (second < 10**11) & (version >= 0) & (version < 10**6)
    return F.when(fits, F.concat(F.lit("r"), F.lpad(second.cast("string"), 11, "0"), F.lpad(version.cast("string"), 6, "0")))


def safe_item_id(x: Column) -> Column:
    """Lower case; other characters and every run of separators become a dash; null where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._-]+", "-"), "[._-]{2,}", "-")
    return F.nullif(F.regexp_replace(clean, "^[._-]+|[._-]+$", ""), F.lit(""))


def safe_source(x: Column) -> Column:
    clean = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.when(clean.rlike("^[a-z]"), clean)


def clamp_prio(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(9), x.cast("int")))


def item_name(prio: Column, source: Column, item: Column, rev: Column) -> Column:
    return F.concat(F.lit("p"), clamp_prio(prio).cast("string"), F.lit("-"), safe_source(source), F.lit("-"), safe_item_id(item), F.lit("-"), rev, F.lit(".json"))


def parse_item_name(name: Column) -> Column:
    """Struct of prio, source, id and rev (the last ``-r`` starts it); null for names that do not parse."""
    part = lambda k: F.regexp_extract(name, ITEM_NAME, k)
    good = name.rlike(ITEM_NAME) & (F.length(name) <= NAME_MAX)
    return F.when(good, F.struct(part(1).cast("int").alias("prio"), part(2).alias("source"), part(3).alias("id"), part(4).alias("rev")))


def rev_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for revisions of digits, by value; equal texts are 0; null where they can't be compared."""
    digits = a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
    x, y = (F.regexp_replace(v, "^0+(?=.)", "") for v in (a, b))
    by_value = F.when(F.length(x) != F.length(y), F.signum(F.length(x) - F.length(y))).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(digits, by_value.cast("int")).when(a == b, 0)


def rev_key(rev: Column) -> Column:
    """Sorts revisions of digits by value; null for others."""
    x = F.regexp_replace(rev, "^0+(?=.)", "")
    return F.when(rev.rlike("^[0-9]+$"), F.struct(F.length(x).alias("digits"), x.alias("text")))


def exit_class(code: Column) -> Column:
    """Struct (outcome, waiting_kind): 0 is done, three codes wait, anything else has failed."""
    kind = F.lit(None).cast("string")
    for n, name in WAITING.items():
        kind = F.when(code == n, name).otherwise(kind)
    outcome = F.when(code == 0, "DONE").when(code.isin(*WAITING), "WAITING").otherwise("FAILED")
    return F.struct(outcome.alias("outcome"), kind.alias("waiting_kind"))


def decided_class(by: Column) -> Column:
    return F.when(by.isin(*HUMAN), "human").when(by.isin(*MACHINE) | by.startswith("lane:"), "machine").otherwise("other")


def parse_duration(x: Column) -> Column:
    """Seconds (long) of texts like 90, 30m or 1h30m; null for others, and where a long can't hold them."""
    number = lambda text: F.when(text != "", text).otherwise("0").try_cast("bigint")
    part = lambda unit: number(F.regexp_extract(x, f"([0-9]+){unit}", 1))
    units = F.try_add(F.try_add(F.try_multiply(part("h"), F.lit(3600).cast("bigint")), F.try_multiply(part("m"), F.lit(60).cast("bigint"))), part("s"))
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")).when(x.rlike("^([0-9]+h)?([0-9]+m)?([0-9]+s)?$") & (x != ""), units)


def format_at(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 90, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 5400, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
    )


def idempotency_key(pipeline: Column, params: dict[str, Column], day: Column) -> Column:
    """``sha256:`` and the hash of compact JSON with sorted keys."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pairs = [F.concat(F.lit(("," if i else "") + f'"{k}":'), quoted(v)) for i, (k, v) in enumerate(sorted(params.items()))]
    text = F.concat(F.lit('{"day":'), quoted(day), F.lit(',"params":{'), *pairs, F.lit('},"pipeline":'), quoted(pipeline), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def redacted(text: Column, secrets: list[str], mark: str = "***") -> Column:
    """Literal secrets replaced, longest first."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit(mark))
    return text


def redacted_list(texts: Column, secrets: list[str]) -> Column:
    return F.transform(texts, lambda t: redacted(t, secrets))


def redacted_map(entries: Column, secrets: list[str]) -> Column:
    """Keys and values replaced; of keys that become equal the last one stays, as where a mapping is filled in order."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.struct(redacted(e["key"], secrets).alias("key"), redacted(e["value"], secrets).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


#: Helpers of templates, and roots whose values have names of their own.
HELPERS = ("slug", "dash", "short")
ROOTS = ("params", "dims", "cursor", "artifact", "gate")
PLACEHOLDER = r"\{([^{}]*)\}"


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each {name} replaced; a name that ``values`` lacks is an error at once.

    Names may have a root (``params.x``, ``artifact:x``); a helper may stand around a name: ``slug(params.x)``,
    ``dash(params.x)``, ``short(params.x, 3)``.
    """
    pieces = re.split(PLACEHOLDER, template)
    return F.concat(*[_value(p.strip(), values) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def _value(body: str, values: dict[str, Column]) -> Column:
    call = re.fullmatch(r"(\w+)\((.*)\)", body)
    if not call or call[1] not in HELPERS:
        return values[body]
    name, _, n = (x.strip() for x in call[2].partition(","))
    if call[1] == "short":
        return short(values[name], int(n))
    return {"slug": slug, "dash": dash}[call[1]](values[name])


def scanned(template: Column) -> Column:
    """The placeholders of a template, not resolved: an array of (kind, raw, ref_type, ref_name); a kind is helper,
    reference or value.
    """
    helper = rf"^({'|'.join(HELPERS)})\(.*\)$"

    def one(raw: Column) -> Column:
        body = F.trim(raw)
        kind = F.when(body.rlike(helper), "helper").when((body == "run_dir") | body.contains(":"), "reference").otherwise("value")
        ref = F.when((kind == "reference") & (body == "run_dir"), body).when(kind == "reference", F.trim(F.substring_index(body, ":", 1)))
        rest = F.when((kind == "reference") & body.contains(":"), F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1)))
        return F.struct(kind.alias("kind"), body.alias("raw"), ref.alias("ref_type"), rest.alias("ref_name"))

    return F.transform(F.regexp_extract_all(template, F.lit(PLACEHOLDER)), one)


def error_tail(text: Column, lines: int = 20, chars: int = 2000) -> Column:
    """The last lines of a trimmed text, then their last characters; null where nothing is left."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.split(trimmed, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - lines + 1), F.lit(lines)), "\n")
    return F.nullif(F.substring(tail, -chars, chars), F.lit(""))


def idempotency_marker(source: Column, item: Column, rev: Column, kind: str = "delivery", prefix: str = "run") -> Column:
    """A tag of an item's revision that finds an earlier effect; anything but letters, digits, - and _ is a dash."""
    plain = F.regexp_replace(rev, "^r", "")
    text = F.concat(F.lit(f"{prefix}-{kind}-"), source, F.lit("-"), item, F.lit("-r"), plain)
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-")


def write_back(lookup: Column) -> Column:
    """What to do by what a look-up found: never create on doubt; an unknown outcome is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown look-up result: "), F.coalesce(lookup, F.lit("null")))).cast("string")
    return F.when(lookup == "absent", "create").when(lookup == "present", "reuse").when(lookup == "uncertain", "block").otherwise(wrong)


def source_status(checked: Column, upstream: Column, closed: Column) -> Column:
    """closed, changed or current; without an upstream revision nothing has changed."""
    return F.when(closed, "closed").when(F.coalesce(upstream != checked, F.lit(False)), "changed").otherwise("current")


def glob_pattern(glob: str) -> str:
    """A shell pattern (*, ?, [abc], [!abc]) over a whole text as a regular expression of Java's."""
    out, i = [], 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if glob[i] == "[" else -1
        if end > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" if body[0] == "!" else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body.removeprefix("!")) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def guards_matched(tool: Column, command: Column, guards: list[tuple[str, str, str]]) -> Column:
    """The names of the guards (name, tool, command pattern) that a call falls under, in order; an empty tool or pattern
    fits everything.
    """
    hits = []
    for name, own, glob in guards:
        hit = (tool == own if own else F.lit(True)) & (command.rlike(glob_pattern(glob)) if glob else F.lit(True))
        hits.append(F.when(hit, name))
    return F.array_compact(F.array(*hits))


#: What a log says where a login is missing; the last bytes of a log that are searched.
AUTH_SIGNS = ("not logged in", "please run", "/login", "invalid api key", "unauthorized", "authentication", "no credentials", "log in to")
AUTH_TAIL = 8192


def auth_failure(log: Column, code: Column, signs: tuple[str, ...] = AUTH_SIGNS) -> Column:
    """Whether a failed command's log ends in the signs of a missing login: such a step is blocked, not failed."""
    tail = F.lower(F.substring(log, -AUTH_TAIL, AUTH_TAIL))
    found = F.lit(False)
    for sign in signs:
        found = found | tail.contains(sign)
    return F.coalesce((code != 0) & found, F.lit(False))


def cursor_text(updated_at: Column, item: Column) -> Column:
    """A cursor as compact JSON."""
    return F.to_json(F.struct(updated_at.alias("updated_at"), item.alias("id")))


def cursor_of(text: Column) -> Column:
    """Struct (updated_at, id) of a cursor's text; null where it is no such object."""
    found = F.from_json(text, "updated_at string, id string")
    return F.when(found["updated_at"].isNotNull() & found["id"].isNotNull(), found)


def next_cursor(current: Column, scratch: Column) -> Column:
    """Struct of the cursor after a step, as text, and a warning, if any: an empty or unchanged scratch moves nothing, and
    what is no cursor (a JSON object of two texts) moves nothing either but is told.
    """
    v = F.try_parse_json(scratch)
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    empty, good = F.trim(F.coalesce(scratch, F.lit(""))) == "", text("updated_at").isNotNull() & text("id").isNotNull()
    warning = F.when(~empty & v.isNull(), "scratch is no JSON; the cursor stays").when(~empty & ~good, "scratch is no cursor; the cursor stays")
    moved = F.when(~empty & good, cursor_text(text("updated_at"), text("id"))).otherwise(current)
    return F.struct(moved.alias("cursor"), warning.alias("warning"))


def overlap_since(updated_at: Column, seconds: int = 60) -> Column:
    """The lower bound of the next fetch, as text: ``seconds`` before the mark; a mark that can't be read is the bound."""
    at = F.try_to_timestamp(F.trim(updated_at)) - F.expr(f"INTERVAL {seconds} SECONDS")
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), updated_at)


#: The keys under which a receipt may state its revision, in order.
RECEIPT_KEYS = ("rev", "checked_rev", "delivered_rev", "receipt_rev")


def receipt_rev(*bodies: Column) -> Column:
    """The first revision that receipts (JSON texts, in order) state under one of RECEIPT_KEYS: a text that is not
    empty or a whole number. Torn receipts are passed over; null where none states one.
    """
    found = []
    for body in bodies:
        v = F.try_parse_json(body)
        for key in RECEIPT_KEYS:
            one = F.try_variant_get(v, f"$.{key}", "variant")
            kind = F.schema_of_variant(one)
            found.append(F.when(kind.isin("STRING", "BIGINT"), F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))))
    return F.coalesce(*found)


@F.pandas_udf(T.StringType())
def step_sentinel(texts: pd.Series) -> pd.Series:
    """The last valid ``<<<STEP {json}`` object of each text, as compact JSON. Braces inside strings need a real JSON
    decoder, so this is the one function that leaves the JVM.
    """
    return texts.map(last_step)


def last_step(text: str | None) -> str | None:
    decoder = json.JSONDecoder()
    for m in reversed(list(re.finditer(r"<<<STEP\b", text or ""))):
        try:
            found, _ = decoder.raw_decode(text, re.compile(r"\s*").match(text, m.end()).end())
        except ValueError:
            continue
        if isinstance(found, dict) and _is_step(found):
            return json.dumps(found, separators=(",", ":"), ensure_ascii=False)
    return None


def _is_step(d: dict) -> bool:
    """Fixed shape of a step's object: every key may be missing (but a learning's note), none may be of another type."""
    texts = lambda x: isinstance(x, list) and all(isinstance(t, str) for t in x)
    learned = d.get("learnings", [])
    return (
        d.get("status", "done") in ("done", "skipped", "blocked")
        and isinstance(d.get("summary", ""), str)
        and len(d.get("summary", "")) <= 2000
        and texts(d.get("artifacts", []))
        and texts(d.get("blockers", []))
        and isinstance(d.get("metrics", {}), dict)
        and isinstance(learned, list)
        and all(isinstance(x, dict) and isinstance(x.get("note"), str) and isinstance(x.get("tag", ""), str) for x in learned)
    )
