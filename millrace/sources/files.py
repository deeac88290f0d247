"""Readers of trails, manifests, gate decisions, parameter sets and inboxes, with explicit schemas; nothing is inferred."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import redacted
from millrace.sources.scratch import stored

#: The texts of a manifest, and those that every manifest must have.
MANIFEST_TEXTS = ("run_id", "pipeline", "created_at", "status", "origin")
MANIFEST_REQUIRED = ("run_id", "pipeline", "created_at", "status")
GATE = "run_id string, gate string, choice string, `by` string, `at` string, verified boolean, mtime string, _bad string"

#: Fixed value: the file that says which layout an inbox has.
VERSION_MARKER = "ledger-version"


def parse_at(text: Column) -> Column:
    """UTC time of a text; null where it can't be read. A text without zone is UTC (with the session's zone UTC)."""
    return F.try_to_timestamp(text.cast("string")).cast("timestamp_ntz")


def parse_since(text: str) -> Column:
    """A bound that a user gave: what can't be read is an error."""
    return F.to_timestamp(F.lit(text)).cast("timestamp_ntz")


def found(spark: SparkSession, path: str) -> bool:
    """Whether anything stands under a path (or fits its pattern), in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row and value of the text files under ``path``; none where there is no such path.

    Files are split like any text; ``block`` is a split's place in its file and ``row`` grows within it.
    """
    if not found(spark, path):
        return spark.createDataFrame([], "file string, block long, row long, value string")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    return spark.read.text(path).select(*place, "value")


def kind_of(v: Column) -> Column:
    """The type of a variant's value; null for none."""
    return F.schema_of_variant(v)


def text_of(v: Column, key: str) -> Column:
    """A key's value where that is a text; null for numbers, lists and the like."""
    return F.when(kind_of(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def read_trail(spark: SparkSession, path: str) -> DataFrame:
    """One row per decodable JSON object of the trails under ``path``; none where there is no such path.

    ``line_no`` orders a run's rows as they stand in its file: the place of the block in the file, then the row in the
    block. Files are split like any text, so a long trail is read by many tasks; a run's lines must stand in one file.
    The run is the line's ``run_id``, or else the name of the file's folder. Blank, torn and non-object lines are
    skipped; a wrongly typed seq or time is null and its line stays.
    """
    return trail_rows(text_lines(spark, path))


def trail_rows(lines: DataFrame) -> DataFrame:
    """The events of trail lines (see ``text_lines``), of a table or a stream."""
    lines = lines.select("file", F.struct("block", "row").alias("line_no"), F.try_parse_json("value").alias("v"))
    rows = lines.filter(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    text = lambda key: F.try_variant_get("v", f"$.{key}", "string")
    strings = lambda key: F.try_variant_get("v", f"$.data.{key}", "array<string>")
    whole = lambda key: F.expr(f"try_cast(try_variant_get(v, '$.{key}', 'string') as bigint)")
    node = F.when(F.schema_of_variant(F.try_variant_get("v", "$.node", "variant")) == "STRING", text("node"))
    return rows.select(
        "file",
        F.coalesce(text("run_id"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).alias("run_id"),
        "line_no",
        whole("seq").alias("seq"),
        text("at").alias("at_raw"),
        parse_at(text("at")).alias("ev_at"),
        text("event").alias("event"),
        node.alias("node"),
        whole("cycle").alias("cycle"),
        F.try_variant_get("v", "$.data", "variant").alias("data"),
        whole("data.exit_code").cast("int").alias("exit_code"),
        F.nullif(text("data.by"), F.lit("")).alias("decided_by"),
        F.coalesce(strings("validator_reasons"), F.array_compact(F.array(F.nullif(text("data.validator_reasons"), F.lit(""))))).alias("reasons"),
        strings("artifacts").alias("artifacts"),
        text("data.tag").alias("tag"),
        text("data.note").alias("note"),
        F.coalesce(F.try_variant_get("v", "$.data.dark", "boolean"), F.lit(False)).alias("dark"),
    )


def since(trail: DataFrame, seq: int) -> DataFrame:
    """Rows behind an offset; a row without seq counts as 0."""
    return trail.filter(F.coalesce("seq", F.lit(0)) > seq)


def last_seq(trail: DataFrame) -> DataFrame:
    """run_id, last_seq: of the last line, not the largest; 0 where it has none."""
    return trail.groupBy("run_id").agg(F.coalesce(F.max_by("seq", "line_no"), F.lit(0)).cast("long").alias("last_seq"))


def read_manifests(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Run manifests, a JSON object a line. What should be a text and is none is null, and a manifest that can't be read
    or has no run_id is dropped; with ``strict`` a line that is no object, or lacks one of MANIFEST_REQUIRED as a text,
    ends the job.
    """
    rows = text_lines(spark, path).filter(F.trim("value") != "").select("value", F.try_parse_json("value").alias("v"))
    texts = [text_of(F.col("v"), c).alias(c) for c in MANIFEST_TEXTS]
    maps = [F.try_variant_get("v", f"$.{c}", "map<string,string>").alias(c) for c in ("params", "dims")]
    if not strict:
        return rows.select(*texts, *maps).filter("run_id IS NOT NULL")
    whole = F.coalesce(kind_of(F.col("v")).startswith("OBJECT"), F.lit(False))
    lacking = F.concat_ws(", ", *[F.when(text_of(F.col("v"), c).isNull(), c) for c in MANIFEST_REQUIRED])
    wrong = F.when(~whole, "malformed manifest").when(lacking != "", F.concat(F.lit("manifest without "), lacking))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.substring("value", 1, 200))).cast("string")).otherwise(F.col("value"))
    return rows.select(F.try_parse_json(checked).alias("v")).select(*texts, *maps)


def broken_manifests(spark: SparkSession, path: str) -> DataFrame:
    """run_id, file and value of the lines that ``read_manifests`` drops. The run is what the line still says, or else the
    file's folder where each run has a file of its own (``run.json``), or else null.
    """
    lines = text_lines(spark, path).filter(F.trim("value") != "")
    said = F.nullif(F.regexp_extract("value", r'"run_id"\s*:\s*"([^"]*)"', 1), F.lit(""))
    run = F.coalesce(said, F.nullif(F.regexp_extract("file", r"([^/]+)/run\.json$", 1), F.lit("")))
    return lines.filter(text_of(F.try_parse_json("value"), "run_id").isNull()).select(run.alias("run_id"), "file", "value")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """Gate decisions that are kept as files: run_id, gate, decided_by, verified, decided_at, mtime. A decision that is
    not verified stays, for it was made; who made it does not count.
    """
    if not found(spark, path):
        return spark.createDataFrame([], "run_id string, gate string, decided_by string, verified boolean, decided_at timestamp_ntz, mtime timestamp_ntz")
    reader = spark.read.schema(GATE).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    rows = reader.json(path).filter(F.col("_bad").isNull() & F.col("gate").isNotNull())
    return rows.select("run_id", "gate", F.col("by").alias("decided_by"), F.coalesce("verified", F.lit(False)).alias("verified"), parse_at(F.col("at")).alias("decided_at"), parse_at(F.col("mtime")).alias("mtime"))


def numbered(lines: DataFrame) -> DataFrame:
    """``text_lines`` with ``line_no`` from 1 in each file: the lines of the blocks before, added up, and the place in the
    block. A file is never read by one task only for that; its blocks are a row each.
    """
    lines = stored(lines, "lines")  # rows of one evaluation
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("_base") + F.col("row") - F.col("_first") + 1).alias("line_no"), "value")


def read_param_sets(spark: SparkSession, path: str) -> DataFrame:
    """line_no and params of a JSONL file that drives a batch. A line that is no object ends the job with its number,
    and so does a file without lines.
    """
    rows = numbered(text_lines(spark, path)).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    good = F.coalesce(kind_of(F.col("v")).startswith("OBJECT"), F.lit(False))
    message = F.concat(F.lit("not a JSON object: line "), F.col("line_no").cast("string"))
    out = rows.select("line_no", F.when(good, F.col("v")).otherwise(F.raise_error(message).cast("variant")).alias("params"))
    if rows.limit(1).count() == 0:
        raise ValueError(f"no parameter sets in {path}")
    return out


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch of the appends to a trail store that have ended, one row each."""
    if not found(spark, f"{path}/commits/*.json"):
        return spark.createDataFrame([], "batch string")
    return spark.read.schema("batch string").json(f"{path}/commits").filter("batch IS NOT NULL").distinct()


def append_trail(events: DataFrame, path: str, batch: str, secrets: list[str] | None = None) -> bool:
    """Append rows (run_id, line_no, at, event, node, data as text) to a trail store as JSON lines, under the name
    ``batch``; false, and nothing changes, where that has been appended already.

    Lines and each run's last seq are staged in folders of the batch, which a repeated call writes anew; then one line
    in the commit log makes them count. A call that failed before that leaves nothing that readers see. Secrets are
    replaced before anything is serialised. ``seq`` goes on from each run's last one; a run's rows of one call stand in
    one file, in order. A store has one writer at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", batch):
        raise ValueError(f"not a batch's name: {batch!r}")
    spark = events.sparkSession
    done = committed(spark, path)
    if done.filter(F.col("batch") == batch).count():
        return False
    last = spark.createDataFrame([], "run_id string, last_seq long")
    if found(spark, f"{path}/heads/*"):
        heads = spark.read.schema("run_id string, last_seq long, batch string").parquet(f"{path}/heads")
        last = heads.join(done, "batch", "left_semi").groupBy("run_id").agg(F.max("last_seq").alias("last_seq"))
    rows = events.withColumn("run_id", F.col("run_id").cast("string"))
    for c in ("event", "node", "data"):
        rows = rows.withColumn(c, redacted(F.col(c), secrets or []))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("line_no"))
    numbered_ = stored(rows.withColumn("_n", n).join(last, "run_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.col("_n")), "append")
    line = F.to_json(F.struct(F.lit(1).alias("v"), "seq", "at", "run_id", "event", "node", F.struct(F.col("data").alias("text")).alias("data")))
    lines = numbered_.select("run_id", "seq", line.alias("value")).repartition("run_id").sortWithinPartitions("run_id", "seq").select("value")
    lines.write.mode("overwrite").text(f"{path}/lines/batch={batch}")
    numbered_.groupBy("run_id").agg(F.max("seq").alias("last_seq")).write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{path}/commits")
    return True


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """What ended calls of ``append_trail`` wrote: later calls write other files, so a run's rows stand by ``seq``."""
    lines = text_lines(spark, f"{path}/lines")
    own = F.regexp_extract("file", r"/batch=([^/]+)/", 1)
    lines = lines.withColumn("batch", own).join(committed(spark, path), "batch", "left_semi").drop("batch")
    return trail_rows(lines).withColumn("line_no", F.col("seq")).withColumn("text", F.try_variant_get("data", "$.text", "string"))


def scan_inbox(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name, mtime, size of the files at the top of an inbox, by name: no folders, no dot-names, no version marker."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return candidates(rows)


def candidates(files: DataFrame) -> DataFrame:
    """The rows (name) that may be claimed, by name."""
    return files.filter(~F.col("name").startswith(".") & (F.col("name") != VERSION_MARKER)).orderBy("name")


def artifact_files(files: DataFrame, declared: DataFrame) -> DataFrame:
    """run_id, artifact and path of the ``files`` (run_id, path below the run's folder) that each run's ``declared``
    artifacts (run_id, artifact, path) name, by path; a plain path stays without a file (``present`` false), a pattern
    that nothing fits has no row.

    Patterns are a column: paths of the declaring run only are matched, by a join on the run, for which files are dealt out
    once. What recurs from run to run is matched once: distinct pairs of pattern and path are. Paths that could leave the folder end the job.
    """
    parts = F.filter(F.split("path", "/"), lambda p: ~p.isin("", "."))
    outside = F.when(F.col("path").startswith("/"), " (absolute): ").when(F.array_contains(parts, ".."), " (..): ").when(F.size(parts) == 0, " (empty): ")
    checked = F.when(outside.isNotNull(), F.raise_error(F.concat(F.lit("artifact path leaves the run's folder"), outside, "path")).cast("string")).otherwise(F.array_join(parts, "/"))
    checked = F.when(F.col("path").rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), checked).otherwise(F.col("path"))  # most have nothing to take out
    told = declared.select("run_id", "artifact", checked.alias("_p"), F.col("path").contains("*").alias("_glob"))
    told = told.withColumn("_p", F.when(F.col("_glob") & F.col("_p").endswith("**"), F.concat("_p", F.lit("/*"))).otherwise(F.col("_p")))
    plain = told.filter(~F.col("_glob")).select("run_id", "artifact", F.col("_p").alias("path"))
    there = files.select("run_id", "path", F.lit(True).alias("present")).repartition("run_id").distinct()
    single = plain.join(there, ["run_id", "path"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    pairs = told.filter("_glob").join(there, "run_id")
    hits = stored(pairs.select("_p", "path").distinct().filter(fits(F.col("path"), F.col("_p"))), "hits")
    many = pairs.join(hits, ["_p", "path"])
    return single.select("run_id", "artifact", "path", "present").unionByName(many.select("run_id", "artifact", "path", "present")).orderBy("run_id", "artifact", "path")


#: What a path pattern's signs stand for: fixed values of shell patterns.
PATH_SIGNS = re.compile(r"((?:^|(?<=/))\*\*/|\[!?[^\]/]+\]|\*+|\?|[^*?\[]+|\[)")


def path_pattern(glob: str) -> str:
    """A path pattern as a regular expression over whole paths."""

    def one(x: str) -> str:
        if x == "**/":
            return "(?:[^/]+/)*"
        if x.strip("*") == "":
            return "[^/]*"
        if x == "?":
            return "[^/]"
        if len(x) > 2 and x[0] == "[" and x[-1] == "]":
            return "[" + re.sub("^!", "^", re.sub(r"([\\\[&^])", r"\\\1", x[1:]))
        return re.sub(r"([^\w/])", r"\\\1", x, flags=re.ASCII) if x.isascii() else "".join(c if not c.isascii() or c.isalnum() or c in "_/" else "\\" + c for c in x)

    return "(?s)^" + "".join(one(x) for x in PATH_SIGNS.findall(glob)) + r"\z"


def fits(path: Column, glob: Column) -> Column:
    """Whether a path pattern fits a path, both columns: each of a batch's patterns is read once, and its paths are matched
    side by side.
    """

    def run(paths: pa.Array, globs: pa.Array) -> pa.Array:
        coded = globs.dictionary_encode()
        codes, out = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(paths), bool)
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for k, glob_ in enumerate(coded.dictionary.to_pylist()):
            rows = order[ends[k] : ends[k + 1]]
            hits = pc.match_substring_regex(paths.take(pa.array(rows)), path_pattern(glob_))
            out[rows] = hits.fill_null(False).to_numpy(zero_copy_only=False)
        return pa.array(out)

    return F.arrow_udf(run, "boolean")(path, glob)


def run_paths(spark: SparkSession, root: str) -> DataFrame:
    """run_id and path of all files below the runs' folders in ``root``; only names are read, no contents. Spark passes
    over files without bytes, and over names that start with a dot or an underscore.
    """
    if not found(spark, root):
        return spark.createDataFrame([], "run_id string, path string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.expr("regexp_replace(path, '^[a-z][a-z0-9+.-]*:(//[^/]*)?', '')"), F.lit("^" + re.escape(base) + "/"), F.lit(""))
    parts = listed.select(F.substring_index(below, "/", 1).alias("run_id"), below.alias("_below"))
    return parts.select("run_id", F.expr("substring(_below, length(run_id) + 2)").alias("path")).filter("path <> ''")


TAIL_BYTES = 4096  # fixed value: what is read of a log's end


def log_tails(spark: SparkSession, path: str, glob: str = "*", tail_bytes: int = TAIL_BYTES) -> DataFrame:
    """path, size, last_line, tail and bytes_read of the logs under ``path``: of each file its last bytes alone are read.

    last_line is the last line of these that is not blank, without blanks around it, "" for none; where the file is longer,
    the line that the cut goes through does not count. ``tail`` is the text of those bytes. A file that can't be read, or
    has gone meanwhile, has size 0 and no text; one without bytes is not listed by Spark and has no row. Files are opened by Arrow's file systems, in tasks.
    """
    schema = "path string, size long, last_line string, tail string, bytes_read long"
    if not found(spark, path):
        return spark.createDataFrame([], schema)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(batches):
        for batch in batches:
            rows = [_tail(p, n, tail_bytes) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "size", "last_line", "tail", "bytes_read"])

    return listed.select("path", "length").mapInArrow(run, schema)


def _tail(path: str, size: int, most: int) -> tuple[str, int, str, str, int]:
    try:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as f:
            size = f.size()
            start = max(0, size - most)
            f.seek(start)
            raw = f.read(size - start)
    except OSError:
        return path, 0, "", "", 0
    whole = raw.split(b"\n", 1)[1] if start and b"\n" in raw else b"" if start else raw
    lines = [x for x in (line.decode("utf-8", "replace").strip() for line in whole.splitlines()) if x]
    return path, size, lines[-1] if lines else "", raw.decode("utf-8", "replace"), len(raw)
