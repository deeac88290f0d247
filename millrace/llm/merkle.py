"""A Merkle manifest: one tree a source, one over their roots, and a proof for every document.

Leaves are hashed in the scan and range-sorted by source and id; a leaf's index in its source is its place in the sorted
table less the place where its source begins. Every sorted partition climbs its leaves with a stack: BASE neighbours of one run
are carried into their parent, as digits carry when one counts, and each node is recorded; peaks whose run reaches into
other partitions stay open. Open peaks, a few for each level and partition, are merged by blocks of SPAN_LEVELS levels
at a time with the same stack, so that no task gets more of a hot source than BASE ** SPAN_LEVELS nodes; a run at a
source's end is hashed as short as it is, without padding. For the proofs every partition asks for the few nodes beside
its own, reads its node records and walks up from each leaf. The tree over the sources' roots is made the same way.

A proof is the text of all siblings' digests from the leaf's run to the root, left to right, and two digits a level: how
many siblings stand before and after. ``folded`` recomputes a root from a leaf and its proof.

Defined results: null fields are hashed as ``-``; a null source is a tree of its own, before all others; rows without an
id come first in their source; rows with equal ids stand by their leaf, and repeated rows are leaves of their own with
equal digests but proofs of their own; a lone leaf is its source's root; a manifest of one document has an empty proof; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import fold, table, tidy, written

BASE, SPAN_LEVELS, PART_ROWS = 3, 6, 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def field(x: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the bytes of its text, counted."""
    text = x.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def width(size: int, level: int) -> int:
    """Nodes of a level."""
    return -(-size // BASE**level)


def climbed(nodes: list[tuple[int, int, bytes]], size: int) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, bytes]]]:
    """New nodes and what stays open of neighbouring ``nodes`` (level, index, digest) of a tree of ``size`` leaves, in order."""
    stack: list[tuple[int, int, bytes]] = []
    made = []

    def carry(n: int) -> None:
        level, index, _ = stack[-1]
        parent = (level + 1, index // BASE, digest("".join(d.hex() for _, _, d in stack[-n:])))
        del stack[-n:]
        stack.append(parent)
        made.append(parent)

    def together(n: int) -> bool:
        """Whether the last n peaks are one run's nodes."""
        level, index, _ = stack[-1]
        return len(stack) >= n and all(stack[-1 - k][:2] == (level, index - k) for k in range(1, n))

    for node in nodes:
        stack.append(node)
        while stack[-1][1] % BASE == BASE - 1 and together(BASE):
            carry(BASE)
    if stack and (stack[-1][1] + 1) * BASE ** stack[-1][0] >= size:  # the tree's end: its last runs may be short
        while (w := width(size, stack[-1][0])) > 1 and stack[-1][1] == w - 1 and together(n := (w - 1) % BASE + 1):
            carry(n)
    return made, stack


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (tree, digest, item and the columns of ``order``; a stored table) in order, and the spans of their partitions.

    The first has part and place; the second, a row a tree and partition, where the part's leaves of the tree begin
    (first: place, base: index), how many they are (n) and the tree's size.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    keys = ["tree", *order, "_n"]
    ranged = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    out = written(ranged.select("tree", "digest", "item", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "leaves")
    spans = out.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")  # at most as many rows as there are partitions
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return out, written(spans.withColumn("base", F.coalesce(before, F.lit(0))).withColumn("size", F.sum("n").over(own)), "spans")


NODE = "tree string, size long, level int, `index` long, digest binary"


def node_rows(tree: str, size: int, nodes: list[tuple[int, int, bytes]], **more) -> list[dict]:
    return [{"tree": tree, "size": size, "level": k, "index": i, "digest": d, **more} for k, i, d in nodes]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def recorded(leaves: DataFrame, spans: DataFrame) -> DataFrame:
    """Node records of every partition, its leaves (with their item) among them; ``open`` tells nodes without a parent here."""
    kind = leaves.schema["item"].dataType.simpleString()
    ddl = f"part int, {NODE}, item {kind}, open boolean"
    schema = arrow_schema(ddl)

    def run(key, rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("place"), []
        digests, items = rows.column("digest").to_pylist(), rows.column("item").to_pylist()
        a = 0
        for s in spans.sort_by("first").to_pylist():
            b, base = a + s["n"], s["base"]
            nodes = [(0, base + k, d) for k, d in enumerate(digests[a:b])]
            made, peaks = climbed(nodes, s["size"])
            peaks = {p[:2] for p in peaks}
            for node, item in [*zip(nodes, items[a:b], strict=True), *((n, None) for n in made)]:
                out.append((key[0].as_py(), s["tree"], s["size"], *node, item, node[:2] in peaks))
            a = b
        tidy()
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return written(leaves.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(run, ddl), "records")


def merged(open_: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """All nodes that merging makes of open ones, and the trees' roots (tree, digest)."""
    ddl = NODE + ", made boolean, open boolean"
    schema = arrow_schema(ddl)

    def run(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["index"] * BASE ** r["level"])
        size, tree = rows[0]["size"], rows[0]["tree"]
        made, peaks = climbed([(r["level"], r["index"], r["digest"]) for r in rows], size)
        left, new = {p[:2] for p in peaks}, {m[:2] for m in made}
        old = [p for p in peaks if p[:2] not in new]
        out = [r | {"open": (r["level"], r["index"]) in left} for r in node_rows(tree, size, made, made=True)]
        return pa.Table.from_pylist(out + node_rows(tree, size, old, made=False, open=True), schema=schema)

    levels, found = 0, []
    while not found or BASE**levels < largest:
        levels += SPAN_LEVELS
        # of nodes no longer than the block; longer ones can only meet in later rounds
        start = F.expr(f"cast(`index` * cast(power({BASE}, level) as decimal(38,0)) as decimal(38,0))")
        block = F.floor(start / F.lit(str(BASE**levels)).cast("decimal(38,0)")).cast("long")
        step = open_.select("tree", "size", "level", "index", "digest", block.alias("_block")).groupBy("tree", "_block").applyInArrow(lambda key, t: run(t.drop_columns("_block")), ddl)
        step = written(step, "merged")
        found.append(step.filter("made"))
        open_ = step.filter("open")
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made, open_.select("tree", "digest")


def asked(spans: DataFrame) -> DataFrame:
    """(part, tree, level, index): the nodes beside a partition's own that its proofs need, a few for each level."""

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                lo, hi, level = s["base"], s["base"] + s["n"], 0
                while (w := width(s["size"], level)) > 1:
                    step = BASE**level
                    for run_ in {lo // step // BASE, (hi - 1) // step // BASE}:
                        for i in range(run_ * BASE, min(w, run_ * BASE + BASE)):
                            if i * step < lo or min(s["size"], (i + 1) * step) > hi:
                                out.append((s["part"], s["tree"], level, i))
                    level += 1
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["part", "tree", "level", "index"])

    return spans.mapInArrow(run, "part int, tree string, level int, `index` long")


def proofs(records: DataFrame, spans: DataFrame, made: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, item, leaf, subroot, root, proof, turns) of every leaf; digests are texts.

    ``above``: what continues each tree's proofs: tree, subroot, root (texts), proof, turns.
    """
    nodes = records.filter("open").select("tree", "level", "index", "digest").unionByName(made.select("tree", "level", "index", "digest"))
    beside = asked(spans).join(nodes, ["tree", "level", "index"])
    context = spans.select("part", "tree", "size").join(above, "tree")
    right = beside.unionByName(context, allowMissingColumns=True)
    right = right.toDF(*[f"_{c}" for c in right.columns])  # columns of their own: both sides read the records
    kind = records.schema["item"].dataType.simpleString()
    ddl = f"tree string, item {kind}, leaf string, subroot string, root string, proof string, turns string"
    schema = arrow_schema(ddl)

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        known: dict[str, dict[tuple[int, int], str]] = {}
        told = {}
        for r in others.rename_columns([c[1:] for c in others.column_names]).to_pylist():
            if r["root"] is None:
                known.setdefault(r["tree"], {})[r["level"], r["index"]] = r["digest"].hex()
            else:
                told[r["tree"]] = r
        leaves = []
        own = own.select(["tree", "level", "index", "digest", "item"])
        for tree, level, index, value, item in zip(*(c.to_pylist() for c in own.columns), strict=True):
            known.setdefault(tree, {})[level, index] = value.hex()
            if level == 0:
                leaves.append((tree, index, item))
        out, last, tree = [], {}, None
        for t, i, item in sorted(leaves, key=lambda x: x[:2]):
            if t != tree:
                tree, here, last, ctx = t, known[t], {}, told[t]
                widths = [ctx["size"]]
                while widths[-1] > 1:
                    widths.append(-(-widths[-1] // BASE))

            def up(level: int, index: int) -> tuple[str, str]:
                """Proof and turns from a node on; of each level the last one is remembered, since leaves come in order."""
                if widths[level] == 1:
                    return ctx["proof"], ctx["turns"]
                if level and last.get(level, (None,))[0] == index:
                    return last[level][1]
                first = index - index % BASE
                end = min(first + BASE, widths[level])
                proof, turns = up(level + 1, index // BASE)
                got = "".join(here[level, k] for k in range(first, end) if k != index) + proof, f"{index - first}{end - 1 - index}{turns}"
                if level:
                    last[level] = (index, got)
                return got

            out.append((t, item, here[0, i], ctx["subroot"], ctx["root"], *up(0, i)))
        tidy()
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return records.groupBy("part").cogroup(right.groupBy("_part")).applyInArrow(run, ddl)


@F.arrow_udf(T.StringType())
def folded(leaf: pa.Array, proof: pa.Array, turns: pa.Array) -> pa.Array:
    """The root that a leaf's digest (a text) and a proof give."""
    out = []
    for h, p, t in zip(leaf.to_pylist(), proof.to_pylist(), turns.to_pylist(), strict=True):
        at = 0
        for k in range(0, len(t), 2):
            mid, end = at + 64 * int(t[k]), at + 64 * (int(t[k]) + int(t[k + 1]))
            h = hashlib.sha256((p[at:mid] + h + p[mid:end]).encode()).hexdigest()
            at = end
        out.append(h)
    return pa.array(out, pa.string())


def grown(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trees of ``rows`` (see ``placed``): node records of the partitions, spans, nodes that merging made, and roots."""
    leaves, spans = placed(rows, order)
    records = recorded(leaves, spans)
    largest = spans.agg(F.max("size")).first()[0] or 1
    made, roots = merged(records.filter("open"), largest)
    return records, spans, made, roots


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, altered (the leaf of ``altered``, a text, in place of the text where that is
    not null), subroot, root, proof and turns; digests are texts.
    """
    others = [F.col(c) for c in FIELDS[:-1]]
    other = F.lit(None).cast("binary") if altered is None else F.when(altered.isNotNull(), leaf([*others, altered]))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # null before all texts
    rows = docs.select(tree.alias("tree"), "doc_id", leaf([*others, F.col("text")]).alias("digest"), other.alias("altered"))
    rows = written(rows.select("tree", "doc_id", "digest", F.struct("doc_id", "altered").alias("item")), "hashed")
    records, spans, made, roots = grown(rows, ["doc_id", "digest"])
    roots = written(roots, "roots")
    top = grown(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", F.struct("tree").alias("item")), ["source"])
    root = F.lower(F.hex("digest"))
    whole = top[3].select("tree", root.alias("subroot"), root.alias("root"), F.lit("").alias("proof"), F.lit("").alias("turns"))
    above = proofs(*top[:3], whole).select(F.col("item.tree").alias("tree"), F.col("leaf").alias("subroot"), "root", "proof", "turns")
    found = proofs(records, spans, made, written(above, "sources"))
    return found.select("item.doc_id", "leaf", F.lower(F.hex("item.altered")).alias("altered"), "subroot", "root", "proof", "turns")


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(fold(F.col("doc_id")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    # a null text stays null, and so does its leaf
    rows = manifest(docs, tampered).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), "proof", "turns"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    one = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x} END"
    return "sha256(" + " || ".join(one(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_walk(walk: str, start: str, beside: str) -> str:
    """Every row of ``start`` (r, t, i, h, f) walked up its tree: h as it is and f as it is told, each with its proof."""
    return f"""{walk}(r, t, level, i, proof, f) AS (SELECT r, t, 0, i, '', f FROM {start}
UNION ALL SELECT r, w.t, w.level + 1, w.i // 3, proof || before || after, sha256(before || f || after) FROM {walk} w JOIN {beside} b ON b.t = w.t AND b.level = w.level AND b.i = w.i)"""


def oracle_sql() -> str:
    """The same by recursion over levels, all of each at once."""
    crc = "xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT), lambda c, x: list_reduce(range(0, 8), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(c, x)), 4294967295::BIGINT), 4294967295)"
    grow = "SELECT t, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS w FROM {0}) WHERE w > 1 GROUP BY t, level, i // 3"
    beside = """(SELECT a.t, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM {0} a JOIN {0} p ON p.t = a.t AND p.level = a.level + 1 AND p.i = a.i // 3 JOIN {0} b ON b.t = a.t AND b.level = a.level AND b.i // 3 = a.i // 3 GROUP BY ALL)"""
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS t, {_sql_leaf("text")} AS h,
  {_sql_leaf("u")} AS f FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS u FROM documents)),
d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM l),
n(t, level, i, h) AS (SELECT t, 0, i, h FROM d UNION ALL {grow.format("n")}),
s AS MATERIALIZED (SELECT t AS source, '' AS t, arg_max(h, level) AS h, row_number() OVER (ORDER BY t) - 1 AS i FROM n GROUP BY n.t),
m(t, level, i, h) AS (SELECT t, 0, i, h FROM s UNION ALL {grow.format("m")}),
nb AS MATERIALIZED {beside.format("n")}, mb AS MATERIALIZED {beside.format("m")},
{_sql_walk("w1", "d", "nb")},
e AS MATERIALIZED (SELECT r, arg_max(proof, level) AS proof, arg_max(f, level) AS f FROM w1 GROUP BY r),
x AS MATERIALIZED (SELECT e.r, '' AS t, s.i, e.f, e.proof AS own, s.h AS subroot, d.doc_id, d.h AS leaf FROM e JOIN d USING (r) JOIN s ON s.source = d.t),
{_sql_walk("w2", "x", "mb")}
SELECT doc_id, leaf, subroot, root, sha256(own || y.proof) AS proof_sha256, y.f AS folded_root, y.f = root AS verified
FROM x JOIN (SELECT r, arg_max(proof, level) AS proof, arg_max(f, level) AS f FROM w2 GROUP BY r) y USING (r), (SELECT arg_max(h, level) AS root FROM m)"""


ORACLE_SQL = oracle_sql()
