"""Token ids as ORC: range-sorted by document id, run-length encoded, with row indexes and Bloom filters.

``write_tokens`` gives every task one range of ids and writes one row per document, in ascending order: its ids, how
many there are, the document's place among its task's ids, and the task. ORC stores integers as run-length encoded
streams in stripes; each stripe and each row group keeps the smallest and largest document id, and a Bloom filter of
them, so that ``read_tokens(..., doc_ids)`` skips what can't match and Spark reads stripes in parallel. ``starts``
turns places within tasks into places within the whole: it sums the tasks (one small row each), never the documents.

Defined results: a null or empty text is the end id alone; rows with the same id follow one another by the hash of
their text, then by text; a null id comes first; an empty table gives an empty file; no other column is read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import shared_dir, table, tidy
from millrace.llm.encode import encoder, steps

SCHEMA = "part int, doc_id long, local_start long, n_tokens int, ids array<int>"
STRIPE_BYTES, ROWS_PER_INDEX, BLOOM_FPP = 16 << 20, 1000, 0.01


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode (doc_id, text) rows of ``docs`` into ORC files under ``path``."""

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        make = encoder(vocabulary, end_id)
        for batch in batches:
            done = 0
            for texts in steps(batch.column("text")):
                ids, offsets = make.encode(texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        batch.column("doc_id").slice(done, n),
                        pa.array(at + offsets[:-1].astype(np.int64)),
                        pa.array(np.diff(offsets).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                done, at = done + n, at + int(offsets[-1])
        tidy()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows written; with ``doc_ids`` only those, by stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def starts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``: the number of ids before the document, over all documents in order.

    The tasks' totals are summed in one window: a row for every file written, not for every document.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
    bounds = ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())


def op2_token_orc(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}.orc"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    # the digest is taken before the join, so that no ids are shuffled
    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
    return starts(rows).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
