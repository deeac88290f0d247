"""Registered queries of scalar functions, plans and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import calendar as C
from millrace.functions import scalars as S
from millrace.functions import versions
from millrace.operators import folds, plans
from millrace.registry import query
from millrace.sources import files
from millrace.sources import views as V
from millrace.streaming import follow as stream

_SAFE = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9._-]+', '-', 'g'), '[._-]{{2,}}', '-', 'g'), '^[._-]+|[._-]+$', '', 'g')"
_NAME = f"'p' || (p_partkey % 10) || '-part-' || {_SAFE.format('p_name')} || '-r' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.json'"


@query("", f"SELECT p_partkey, {_NAME} AS name FROM part")
def item_names(spark, d):
    rev = F.concat(F.lit("r"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return V.table(spark, d, "part").select("p_partkey", S.item_name(F.col("p_partkey") % 10, F.lit("Part"), F.col("p_name"), rev).alias("name"))


@query("", f"""SELECT p_partkey, CAST(regexp_extract(name, '{S.ITEM_NAME}', 1) AS INTEGER) AS prio, regexp_extract(name, '{S.ITEM_NAME}', 3) AS id,
  regexp_extract(name, '{S.ITEM_NAME}', 4) AS rev FROM (SELECT p_partkey, {_NAME} AS name FROM part)""")
def parse_names(spark, d):
    return item_names(spark, d).withColumn("n", S.parse_item_name(F.col("name"))).select("p_partkey", "n.prio", "n.id", "n.rev")


@query("", f"SELECT doc_id, nullif({_SAFE.format('t')}, '') AS id, CASE WHEN regexp_matches(s, '^[a-z]') THEN s END AS source FROM (SELECT doc_id, text AS t, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM documents)")
def safe_ids(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.safe_item_id(F.col("text")).alias("id"), S.safe_source(F.col("text")).alias("source"))


@query("", "SELECT o_orderkey, 'r' || lpad(CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR), 11, '0') || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS token FROM orders")
def rev_tokens(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.rev_token(F.col("o_orderdate"), F.col("o_orderkey") % 1000000).alias("token"))


@query("", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^(?:.*@)?([^:]*)', 1)),
  '^www\.', ''), '\.[^.]*$', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")
def slug_urls(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("", "SELECT p_partkey, p_name[1:4] AS head, p_name[1:greatest(0, length(p_name) - 3)] AS body, '-' || p_brand AS tail FROM part")
def short_dash(spark, d):
    n = F.col("p_name")
    return V.table(spark, d, "part").select("p_partkey", S.short(n, 4).alias("head"), S.short(n, -3).alias("body"), S.dash(F.col("p_brand")).alias("tail"))


@query("", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS shown, CASE WHEN s < 90 THEN s || 's' WHEN s < 5400 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' END AS age, s AS seconds
FROM (SELECT *, o_orderkey % 20000 AS s FROM orders)""")
def times_and_ages(spark, d):
    """Times as text, ages as people read them, and durations read back to seconds."""
    s = F.col("o_orderkey") % 20000
    text = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.floor(s % 3600 / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))
    return V.table(spark, d, "orders").select("o_orderkey", S.format_at(F.col("o_orderdate")).alias("shown"), S.age_text(s).alias("age"), S.parse_duration(text).cast("long").alias("seconds"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN date_trunc('day', o_orderdate) END AS ev_at FROM orders""")
def parsed_times(spark, d):
    """Times with a zone, without one, dates alone, and texts that are no time."""
    t, n = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(n == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(n == 2, F.date_format(t, "yyyy-MM-dd")).otherwise("soon")
    return V.table(spark, d, "orders").select("o_orderkey", files.parse_at(text).alias("ev_at"))


@query("", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dims_lookup(spark, d):
    regions = V.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return plans.with_dims(V.table(spark, d, "nation"), regions, "n_regionkey").select("n_nationkey", "n_name", "r_name")


_KEY = """'{{"day":"' || strftime(o_orderdate, '%Y%m%d') || '","params":{{"customer":"' || o_custkey || '"}},"pipeline":"' || o_orderpriority || '"}}'""".replace("{{", "{").replace("}}", "}")


def _keyed(spark, d):
    o = V.table(spark, d, "orders")
    return o.withColumn("key", S.idempotency_key(F.col("o_orderpriority"), {"customer": F.col("o_custkey").cast("string")}, F.date_format("o_orderdate", "yyyyMMdd")))


@query("", f"SELECT o_orderkey, 'sha256:' || sha256({_KEY}) AS key FROM orders")
def idempotency(spark, d):
    return _keyed(spark, d).select("o_orderkey", "key")


@query("", f"""SELECT key, min(struct_pack(open := (status <> 'F')::INTEGER, run_id := o_orderkey))['run_id'] AS run_id, CASE WHEN count(*) FILTER (status = 'F') > 0 THEN 'done' ELSE 'open' END AS status
FROM (SELECT 'sha256:' || sha256({_KEY.replace("strftime(o_orderdate, '%Y%m%d')", "strftime(o_orderdate, '%Y')")}) AS key, o_orderkey, o_orderstatus AS status FROM orders) GROUP BY key""")
def idempotent_runs(spark, d):
    o = V.table(spark, d, "orders")
    key = S.idempotency_key(F.col("o_orderpriority"), {"customer": F.col("o_custkey").cast("string")}, F.date_format("o_orderdate", "yyyy"))
    return plans.idempotent_runs(o.select(key.alias("key"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status")))


SECRETS = ["example", "www.", "example.com"]


@query("", "SELECT page_id, replace(replace(replace(url, 'example.com', '***'), 'example', '***'), 'www.', '***') AS url FROM pages")
def redact_urls(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.redacted(F.col("url"), SECRETS).alias("url"))


@query("", "SELECT page_id, [u, 'x'] AS urls, map_keys(m)[1] AS key, map_values(m)[1] AS value FROM (SELECT page_id, u, MAP {u: 'at ' || u} AS m FROM (SELECT page_id, replace(replace(replace(url, 'example.com', '***'), 'example', '***'), 'www.', '***') AS u FROM pages))")
def redact_nested(spark, d):
    """Lists, and the keys and values of maps."""
    m = S.redacted_map(F.create_map(F.col("url"), F.concat(F.lit("at "), "url")), SECRETS)
    rows = V.table(spark, d, "pages").select("page_id", S.redacted_list(F.array(F.col("url"), F.lit("x")), SECRETS).alias("urls"), m.alias("m"))
    return rows.select("page_id", "urls", F.map_keys("m")[0].alias("key"), F.map_values("m")[0].alias("value"))


@query("", "SELECT n_nationkey, 'run ' || n_name || ' in ' || n_regionkey || '-' || n_name[1:3] || '.' AS line FROM nation")
def template_render(spark, d):
    values = {"params.name": F.col("n_name"), "dims.region": F.col("n_regionkey").cast("string")}
    return V.table(spark, d, "nation").select("n_nationkey", S.rendered("run {params.name} in {dims.region}-{short(params.name, 3)}.", values).alias("line"))


@query("", """SELECT n_nationkey, unnest([1, 2, 3, 4]) AS n, unnest(['value', 'helper', 'reference', 'reference']) AS kind, unnest(['params.' || n_name, 'slug(params.x)', 'artifact: a', 'run_dir']) AS raw,
  unnest([NULL, NULL, 'artifact', 'run_dir']) AS ref_type, unnest([NULL, NULL, 'a', NULL]) AS ref_name FROM nation""")
def template_scan(spark, d):
    text = F.concat(F.lit("x {params."), "n_name", F.lit("} {slug(params.x)} { artifact: a } {run_dir} {"))
    rows = V.table(spark, d, "nation").select("n_nationkey", F.posexplode(S.scanned(text)).alias("n", "p"))
    return rows.select("n_nationkey", (F.col("n") + 1).alias("n"), "p.kind", "p.raw", "p.ref_type", "p.ref_name")


@query("", r"""SELECT doc_id, nullif(array_to_string(l[-20:], chr(10))[-2000:], '') AS tail FROM (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM documents)""")
def error_tails(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.error_tail(F.col("text")).alias("tail"))


@query("", """SELECT o_orderkey, 'run-delivery-order-' || o_orderkey || '-r' || replace(o_orderpriority[1:1] || '.' || o_custkey, '.', '-') AS marker, ['create', 'reuse', 'block'][o_orderkey % 3 + 1] AS action,
  CASE WHEN o_orderkey % 5 = 0 THEN 'closed' WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 THEN 'changed' ELSE 'current' END AS status FROM orders""")
def write_backs(spark, d):
    n = F.col("o_orderkey")
    rev = F.concat(F.when(n % 2 == 0, "r").otherwise(""), F.substring("o_orderpriority", 1, 1), F.lit("."), F.col("o_custkey").cast("string"))
    upstream = F.when(n % 7 == 0, None).when(n % 2 == 0, "2").otherwise("1")
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        S.idempotency_marker(F.lit("order"), n.cast("string"), rev).alias("marker"),
        S.write_back(V.pick(("absent", "present", "uncertain"), n % 3)).alias("action"),
        S.source_status(F.lit("1"), upstream, n % 5 == 0).alias("status"),
    )


_SIGNS = ", ".join(f"'{x}'" for x in S.AUTH_SIGNS)
_LOG = f"""(SELECT doc_id, CASE WHEN doc_id % 32 < 8 THEN text || chr(10) || upper([{_SIGNS}][doc_id % 32 + 1]) WHEN doc_id % 32 < 16 THEN [{_SIGNS}][doc_id % 8 + 1] || chr(10) || text ELSE text END AS log FROM documents)"""


@query("", f"""SELECT doc_id, doc_id % 3 <> 0 AND regexp_matches(lower(right(log, {S.AUTH_TAIL})), '{"|".join(S.AUTH_SIGNS)}') AS auth FROM {_LOG}""")
def auth_failures(spark, d):
    """Documents as logs of failed and (every third) finished commands. Each sign of a missing login stands at the end of
    some, in capitals, and at the head of others, where only short logs still show it.
    """
    n = F.col("doc_id")
    behind = F.concat("text", F.lit("\n"), F.upper(V.pick(S.AUTH_SIGNS, n % 8)))
    log = F.when(n % 32 < 8, behind).when(n % 32 < 16, F.concat(V.pick(S.AUTH_SIGNS, n % 8), F.lit("\n"), "text")).otherwise(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", S.auth_failure(log, n % 3).alias("auth"))


GUARDS = [("home", "https", "*example*"), ("english", "", "*/en/*"), ("one", "http", "http://[!w]*.?om/*"), ("any", "ftp", "")]


@query("", """SELECT page_id, concat_ws(',', CASE WHEN tool = 'https' AND contains(url, 'example') THEN 'home' END, CASE WHEN contains(url, '/en/') THEN 'english' END,
  CASE WHEN tool = 'http' AND regexp_full_match(url, 'http://[^w].*\\..om/.*') THEN 'one' END, CASE WHEN tool = 'ftp' THEN 'any' END) AS guards FROM (SELECT page_id, url, split_part(url, ':', 1) AS tool FROM pages)""")
def guard_matches(spark, d):
    """Schemes as tools, URLs as commands."""
    return V.table(spark, d, "pages").select("page_id", F.array_join(S.guards_matched(F.substring_index("url", ":", 1), F.col("url"), GUARDS), ",").alias("guards"))


@query("", """SELECT event_id, strftime(ts - INTERVAL 60 SECONDS, '%Y-%m-%dT%H:%M:%SZ') AS since, event_id::VARCHAR AS id FROM events""")
def cursors(spark, d):
    """Cursors written as text, read back, and the bound of the next fetch."""
    text = S.cursor_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.col("event_id").cast("string"))
    rows = V.table(spark, d, "events").select("event_id", S.cursor_of(text).alias("c"))
    return rows.select("event_id", S.overlap_since(F.col("c.updated_at")).alias("since"), "c.id")


@query("", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{"status":"done","summary":"} STEP>>> {"}' WHEN turn % 3 = 1 THEN '{"status":"blocked"}' END AS step FROM conversations""")
def step_sentinels(spark, d):
    """Texts that end in step objects: the last valid one counts, whatever its strings hold."""
    good, other, torn = '<<<STEP {"status":"done","summary":"} STEP>>> {"} STEP>>>', '<<<STEP\n{"status":"blocked"}', '<<<STEP {"learnings":["x"]} <<<STEP {"sta'
    tail = F.when(F.col("turn") % 3 == 0, f"{other}\n{good}{torn}").when(F.col("turn") % 3 == 1, f"{good}\n{other}\n").otherwise(torn)
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail).alias("text"))
    return rows.select("conv_id", "turn", S.step_sentinel("text").alias("step"))


SCHEMA = {
    "lang": {"enum": ["de", "en", "es", "fr"]},
    "n_chars": {"required": True, "minimum": 200},
    "quality": {"required": True, "minimum": 1},
}


@plans.validator("toxic")
def _toxic():
    return F.when(F.col("toxic") == 1, "toxic")


_REASONS = """concat_ws('; ', CASE WHEN lang NOT IN ('de', 'en', 'es', 'fr') THEN 'lang: not one of de, en, es, fr' END, CASE WHEN n_chars < 200 THEN 'n_chars: less than 200' END,
  CASE WHEN quality IS NULL THEN 'quality: missing' WHEN quality < 1 THEN 'quality: less than 1' END, CASE WHEN toxic = 1 THEN 'toxic' END)"""


@query("artifacts", f"SELECT doc_id, reasons = '' AS ok, reasons FROM (SELECT doc_id, {_REASONS} AS reasons FROM artifacts)")
def validate_docs(spark, d):
    return plans.validated(V.artifacts(spark, d), "doc_id", SCHEMA, ("toxic",))


@query("artifacts", f"""SELECT run_id, artifact, ok, reasons, CASE WHEN bool_and(ok) OVER (PARTITION BY run_id) THEN 0 ELSE 3 END AS exit_code FROM (
SELECT source AS run_id, doc_id AS artifact, reasons = '' AS ok, reasons FROM (SELECT source, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE {_REASONS} END AS reasons FROM artifacts WHERE doc_id % 4 <> 3))""")
def revalidate_runs(spark, d):
    """Sources as runs, documents as the artifacts of their finished steps; some have gone missing since."""
    a = V.artifacts(spark, d)
    step = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    nodes = a.select(F.col("source").alias("run_id"), step.alias("step"), F.when(F.col("doc_id") % 4 == 3, "halted").otherwise("done").alias("status"))
    made = a.select(step.alias("step"), F.col("doc_id").alias("artifact"))
    told = plans.validated(a.filter("doc_id % 9 <> 0"), "doc_id", SCHEMA, ("toxic",)).join(a.select("doc_id", F.col("source").alias("run_id")), "doc_id")
    return plans.revalidated(nodes, made, told.withColumnRenamed("doc_id", "artifact"))


@query("steps", "SELECT pipeline, step, needs FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps p WHERE p.pipeline = s.pipeline AND p.produces = s.needs AND p.grp < s.grp)")
def needs_produces(spark, d):
    return plans.unmet_needs(V.steps(spark, d))


@query("steps", "SELECT pipeline, grp, produces, count(DISTINCT step) AS steps FROM steps GROUP BY ALL HAVING count(DISTINCT step) > 1")
def disjoint_produces(spark, d):
    return plans.clashing_products(V.steps(spark, d))


@query("", """SELECT l_orderkey, coalesce(max(r) FILTER (r = l_linenumber), 0)::INTEGER AS prefix FROM (SELECT l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey""")
def cycle_prefix(spark, d):
    return folds.prefix_length(V.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("", """SELECT l_orderkey, least(4, coalesce(min(r) FILTER (NOT ok OR l_linenumber <> r) - 1, max(r), 0))::INTEGER AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r
FROM (SELECT l_orderkey, l_linenumber, bool_and(l_quantity >= 5) AS ok FROM lineitem GROUP BY ALL)) GROUP BY l_orderkey""")
def loop_cycles(spark, d):
    """Cycles that are done without a gap, all of whose artifacts are valid, up to the loop's cap."""
    return folds.prefix_length(V.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") >= 5, 4)


@query("", "SELECT count(*) AS emitted, (SELECT count(*) FROM events WHERE value < 5) AS skipped, max(event_id) AS top FROM events WHERE value >= 5")
def poll_report(spark, d):
    """A fetch with bad rows in it: what came, what was left, and the cursor."""
    good, bad = stream.isolated(V.table(spark, d, "events"), {"value": {"minimum": 5}})
    rows = stream.poll_report(good, bad, "ts", "event_id")
    return rows.select("emitted", "skipped", F.col("cursor.id").cast("long").alias("top"))


#: Expressions, and what they mean: minutes, hours, days, months and weekdays (Sunday is 0; None: any).
_ALL = {"minute": range(60), "hour": range(24), "month": range(1, 13)}
CRONS = [
    ("*/15 9-17 * * mon-fri", dict(minute=range(0, 60, 15), hour=range(9, 18), dow=range(1, 6))),
    ("0 0 29 2 *", dict(minute=[0], hour=[0], dom=[29], month=[2])),
    ("@weekly", dict(minute=[0], hour=[0], dow=[0])),
    ("5,10-20/5 3 1,15 * 7", dict(minute=[5, 10, 15, 20], hour=[3], dom=[1, 15], dow=[0])),
    ("0 12 13 * fri", dict(minute=[0], hour=[12], dom=[13], dow=[5])),
    ("30/20 * 31 JAN-dec/2 *", dict(minute=[30, 50], dom=[31], month=range(1, 13, 2))),
    ("@reboot", None),
    ("0 0 30 2 *", None),
    ("60 * * * *", None),
    ("* * * * * *", None),
    ("59 23 * * 6/2", dict(minute=[59], hour=[23], dow=[6])),
    ("@hourly", dict(minute=[0])),
]


def _cron_rows() -> str:
    """The meanings as rows of SQL."""
    listed = lambda x: "NULL" if x is None else "[" + ", ".join(map(str, x)) + "]"
    return ", ".join(f"({n}, {', '.join(listed(m.get(k, _ALL.get(k))) for k in ('minute', 'hour', 'dom', 'month', 'dow'))})" for n, (_, m) in enumerate(CRONS) if m)


@query("", f"""WITH spec(n, minutes, hours, dom, months, dow) AS (VALUES {_cron_rows()}),
o AS (SELECT o_orderkey, (o_orderkey % {len(CRONS)})::INTEGER AS n, o_orderdate + to_minutes((o_orderkey * 7919 % 1440)::INTEGER) AS after FROM orders),
days AS (SELECT o_orderkey, after, minutes, hours, d FROM o JOIN spec USING (n), LATERAL (SELECT unnest(generate_series(date_trunc('day', after), date_trunc('day', after) + INTERVAL 2000 DAYS, INTERVAL 1 DAY)) AS d)
  WHERE list_contains(months, month(d)) AND CASE WHEN dom IS NULL AND dow IS NULL THEN true WHEN dow IS NULL THEN list_contains(dom, day(d)) WHEN dom IS NULL THEN list_contains(dow, dayofweek(d))
    ELSE list_contains(dom, day(d)) OR list_contains(dow, dayofweek(d)) END QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d) <= 2),
fires AS (SELECT o_orderkey, min(d + to_hours(h::INTEGER) + to_minutes(m::INTEGER)) AS next_at FROM (SELECT o_orderkey, after, d, h, unnest(minutes) AS m FROM (SELECT *, unnest(hours) AS h FROM days))
  WHERE d + to_hours(h::INTEGER) + to_minutes(m::INTEGER) > after GROUP BY o_orderkey)
SELECT o_orderkey, next_at FROM o LEFT JOIN fires USING (o_orderkey)""")
def cron_next(spark, d):
    """When schedules fire next: by bits here, by going through the days and minutes in SQL."""
    n, minutes = F.col("o_orderkey"), (F.col("o_orderkey") * 7919 % 1440).cast("int")
    expr = V.pick(tuple(x for x, _ in CRONS), n % len(CRONS))
    after = F.col("o_orderdate") + F.make_dt_interval(mins=minutes)
    return V.table(spark, d, "orders").select("o_orderkey", C.next_fire(C.parse_cron(expr), after).alias("next_at"))


#: Requirements, and the same as a condition on the key k of versions with three numbers.
_K = lambda *k: "[" + ", ".join(map(str, k)) + "]"
REQUIRES = [
    (">=0.1,<1.2", f"k >= {_K(0, 1, 0, 1, 0, 0, 0, 0, 1, 0)} AND k < {_K(1, 2, 0, 1, 0, 0, 0, 0, 1, 0)}"),
    ("==1.*", "k[1] = 1"),
    ("!=1.2.*", "NOT (k[1] = 1 AND k[2] = 2)"),
    ("~=1.2", f"k >= {_K(1, 2, 0, 1, 0, 0, 0, 0, 1, 0)} AND k[1] = 1"),
    ("~=1.2.1", f"k >= {_K(1, 2, 1, 1, 0, 0, 0, 0, 1, 0)} AND k[1] = 1 AND k[2] = 2"),
    ("1.2", f"k = {_K(1, 2, 0, 1, 0, 0, 0, 0, 1, 0)}"),
    ("<2.0,!=1.3.1", f"k < {_K(2, 0, 0, 1, 0, 0, 0, 0, 1, 0)} AND k <> {_K(1, 3, 1, 1, 0, 0, 0, 0, 1, 0)}"),
    (">1.1.0rc1", f"k > {_K(1, 1, 0, 0, 2, 1, 0, 0, 1, 0)}"),
    ("<= 1.2.0.post2", f"k <= {_K(1, 2, 0, 1, 0, 0, 1, 2, 1, 0)}"),
    ("=1.2", "NULL"),
    (">=1.*", "NULL"),
    ("~=1", "NULL"),
]
_SUFFIX, _SUFFIX_KEY = ("", "rc1", ".post2", ".dev3", "a1", ".post1.dev4"), ((1, 0, 0, 0, 0, 1, 0), (0, 2, 1, 0, 0, 1, 0), (1, 0, 0, 1, 2, 1, 0), (-1, 0, 0, 0, 0, 0, 3), (0, 0, 1, 0, 0, 1, 0), (1, 0, 0, 1, 1, 0, 4))


def _versions(spark, d):
    n = F.col("o_orderkey")
    version = F.concat_ws(".", n % 3, F.floor(n / 3) % 5, F.floor(n / 15) % 4)
    return V.table(spark, d, "orders").select("o_orderkey", F.concat(version, V.pick(_SUFFIX, F.floor(n / 60) % 6)).alias("version"))


_VERSIONS = f"""v AS (SELECT o_orderkey, list_concat([o_orderkey % 3, o_orderkey // 3 % 5, o_orderkey // 15 % 4], [{", ".join(_K(*k) for k in _SUFFIX_KEY)}][o_orderkey // 60 % 6 + 1]) AS k,
  concat(o_orderkey % 3, '.', o_orderkey // 3 % 5, '.', o_orderkey // 15 % 4, [{", ".join(f"'{x}'" for x in _SUFFIX)}][o_orderkey // 60 % 6 + 1]) AS version FROM orders)"""


@query("", f"WITH {_VERSIONS} SELECT o_orderkey, version, CASE o_orderkey // 360 % {len(REQUIRES)} {' '.join(f'WHEN {n} THEN {c}' for n, (_, c) in enumerate(REQUIRES))} END AS ok FROM v")
def version_clauses(spark, d):
    spec = V.pick(tuple(x for x, _ in REQUIRES), F.floor(F.col("o_orderkey") / 360) % len(REQUIRES))
    return _versions(spark, d).select("o_orderkey", "version", versions.satisfied(spec, F.col("version")).alias("ok"))


@query("", f"WITH {_VERSIONS}, r(pin, spec) AS (VALUES {', '.join(f"({n}, '{x}')" for n, (x, _) in enumerate(REQUIRES))}) SELECT pin, o_orderkey FROM v, r WHERE CASE pin {' '.join(f'WHEN {n} THEN {c}' for n, (_, c) in enumerate(REQUIRES))} END")
def version_pins(spark, d):
    """All versions that meet each of the pins."""
    pins = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(REQUIRES)], "pin int, spec string")
    return versions.matches(pins, _versions(spark, d)).select("pin", "o_orderkey")


@query("", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"updated_at":"' || strftime(ts, '%Y') || '","id":"' || event_id || '"}' ELSE 'c0' END AS cursor,
  CASE event_id % 5 WHEN 2 THEN 'scratch is no JSON; the cursor stays' WHEN 3 THEN 'scratch is no cursor; the cursor stays' WHEN 4 THEN 'scratch is no cursor; the cursor stays' END AS warning FROM events""")
def cursor_commits(spark, d):
    """Cursors, empty scratches, torn ones, lists, and objects whose values are no texts."""
    n = F.col("event_id")
    good = S.cursor_text(F.date_format("ts", "yyyy"), n.cast("string"))
    scratch = F.when(n % 5 == 0, good).when(n % 5 == 1, "  ").when(n % 5 == 2, '{"updated_at": "x').when(n % 5 == 3, "[1]").otherwise('{"updated_at":"x","id":7}')
    return V.table(spark, d, "events").select("event_id", S.next_cursor(F.lit("c0"), scratch).alias("c")).select("event_id", "c.*")
