"""Centroid clustering in exact integers, with Hamerly's bounds.

A component x becomes floor(SCALE * x). Vectors stand in blocks of BLOCK rows, which are written once, bucketed by the
block's number; what a round learns of them is written beside, bucketed alike: each vector's cluster, one upper bound of
the distance to its centroid and one lower bound of the distance to the second nearest. So a round joins both without a
shuffle, loosens the bounds by how far the centroids have drifted, keeps a vector where the upper bound stays under the
lower one, and scans all centroids in exact integers for the others. A block also tells what its moved vectors add to
the sums of their new clusters and take from the old ones; the driver gets those added up, a few hundred numbers
whatever the input, and divides in whole numbers of any size.

Bounds are floats that are rounded away from the vector at every step, so they never decide what the integers would not.
Squares of components up to EXACT sum up under 2 ** 53, so products of float matrices are exact there; blocks with larger
components are computed in Python's integers.

Defined results: vectors that are null, of another length than DIMS or hold null or non-finite components take no part;
repeated rows and equal ids are vectors of their own; ids that are null are clustered as well, but start a centroid
only behind all others; ties of the starting hash go by the vector; with fewer than k vectors there are as many
centroids; a distance that a long can't hold is null, and so are the sums it is part of; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, table, tidy

DIMS, CLUSTERS, ROUNDS, SALT, SCALE = 64, 8, 10, 3, 1024
BLOCK = 1024  # vectors of a row
BUCKET_LEAST, BUCKET_MOST = 4, 4096  # blocks of a bucket
EXACT = 1 << 22
LIMB = 48  # bits of the digits that large sums travel in
ROUNDING = 1e-12
STATE = "block long, cluster binary, upper binary, lower binary, scans long, sums array<long>"


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == DIMS) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def whole(x: float) -> int:
    """floor(SCALE * x) of a finite double of any size: SCALE is a power of two, so nothing is rounded."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """block, vec_ids and x: int32 texts of the scaled components, or the doubles as they came where one is beyond EXACT."""

    def run(batches):
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                wide = bool((np.abs(part) > EXACT / SCALE).any())
                text = part.astype("<f8").tobytes() if wide else np.floor(SCALE * part).astype("<i4").tobytes()
                yield pa.RecordBatch.from_pydict({"vec_ids": pa.array([batch.column("vec_id")[a : a + BLOCK].to_pylist()], pa.list_(pa.int64())), "x": pa.array([text], pa.binary()), "wide": [wide]})
            tidy()

    rows = vectors.mapInArrow(run, "vec_ids array<long>, x binary, wide boolean")
    return rows.withColumn("block", F.monotonically_increasing_id())


def values(x: bytes, wide: bool) -> np.ndarray:
    """A block's scaled components: exact floats, or Python integers where ``wide``."""
    if not wide:
        return np.frombuffer(x, "<i4").astype(np.float64).reshape(-1, DIMS)
    return np.array([whole(v) for v in np.frombuffer(x, "<f8").tolist()], object).reshape(-1, DIMS)


def squares(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (vectors x centroids): int64, or Python integers where floats would not be exact."""
    if v.dtype != object and all(abs(c) <= EXACT for one in centroids for c in one):
        c = np.array(centroids, np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    v = v if v.dtype == object else v.astype(np.int64).astype(object)
    return np.stack([((v - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number), upper and lower bound of each vector, from a full scan."""
    d = squares(v, centroids)
    own = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    rows = np.arange(len(v))
    if d.dtype == object:  # beyond the floats that hold whole numbers: such vectors are scanned every time
        return own, np.full(len(v), np.inf), np.full(len(v), -np.inf)
    r = np.sqrt(d.astype(np.float64))
    upper = r[rows, own] * (1 + ROUNDING)
    r[rows, own] = np.inf
    return own, upper, r.min(1) * (1 - ROUNDING)


def drifts(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    """How far each centroid went, rounded up; infinity where a float can't hold it."""
    far = (math.isqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) << 40) + 1 for x, y in zip(old, new, strict=True))
    return np.array([float(r) / 2.0**20 * (1 + ROUNDING) if r < 1 << 1000 else math.inf for r in far])


def moved_sums(v: np.ndarray, was: np.ndarray, now: np.ndarray, k: int) -> list[int]:
    """Counts and component sums by cluster that vectors bring (now) and take along (was, -1: from nowhere), flat, in digits of LIMB bits."""
    moved = was != now
    total = np.zeros((k, DIMS + 1), v.dtype)
    for at, sign in ((now[moved], 1), (was[moved], -1)):
        for c in np.unique(at[at >= 0]).tolist():
            hit = v[moved][at == c]
            total[c, 0] += sign * len(hit)
            total[c, 1:] += sign * hit.sum(0)
    if total.dtype != object:
        return total.astype(np.int64).ravel().tolist()
    flat, out = [int(x) for x in total.ravel()], []
    while not out or any(flat):
        out += [(abs(x) & ((1 << LIMB) - 1)) * (1 if x > 0 else -1) for x in flat]
        flat = [(abs(x) >> LIMB) * (1 if x > 0 else -1) for x in flat]
    return out


def start(vectors: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The k vectors with the smallest hash of salt and id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("_key", key).orderBy(F.asc_nulls_last("_key"), "embedding").limit(k).collect()
    return [[whole(x) for x in r["embedding"]] for r in rows]


def bucketed(df: DataFrame, buckets: int, path: str, kind: str) -> tuple[str, DataFrame]:
    """Write ``df`` bucketed by block as a table without a name that stays, and read it back."""
    name = f"millrace_{kind}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", f"{path}/{kind}-{uuid.uuid4().hex}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return name, df.sparkSession.table(name)


def assigned(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: int = SALT) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance) of every vector, the final centroids, and how many vectors each round has scanned."""
    spark = vectors.sparkSession
    good = kept(vectors)
    centroids = start(good, k, salt)
    root = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    out, schema = f"{root}/assigned", "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], schema), [], []
    blocks = blocks_of(good)
    blocks.write.option("compression", "zstd").parquet(f"{root}/blocks")
    blocks = spark.read.schema(blocks.schema).parquet(f"{root}/blocks")
    n_blocks = blocks.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-n_blocks // BUCKET_MOST), min(n_blocks // BUCKET_LEAST, parallel))
    names = []
    try:
        name, blocks = bucketed(blocks.repartition(buckets, "block"), buckets, root, "vectors")
        names.append(name)
        state, drift, sums, scanned = None, None, [], []
        for step in range(rounds + 1):
            rows = blocks.select("block", "x", "wide")
            rows = rows if state is None else rows.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
            rows = rows.mapInArrow(round_of(centroids, drift, step == rounds), STATE)
            name, state = bucketed(rows, buckets, root, "bounds")
            names.append(name)
            n, sums = added(sums, state, len(centroids))
            scanned.append(n)
            if step == rounds:
                break
            old, centroids = centroids, moved(centroids, sums)
            drift = drifts(old, centroids)
        last = blocks.join(state.select("block", "cluster").hint("merge"), "block").mapInArrow(rows_of(centroids), schema)
        last.write.option("compression", "zstd").parquet(out)
    finally:
        for name in names:  # their files stay in the shared folder
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.schema(schema).parquet(out), centroids, scanned


def round_of(centroids: list[list[int]], drift: np.ndarray | None, last: bool):
    """One round over blocks: loosened bounds, scans where they meet, and sums of the vectors that moved."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                v = values(r["x"], r["wide"])
                if drift is None:
                    was, open_ = np.full(len(v), -1), np.ones(len(v), bool)
                    own, upper, lower = was.copy(), np.zeros(len(v)), np.zeros(len(v))
                else:
                    was = np.frombuffer(r["cluster"], "<i4").astype(np.int64)
                    own, far = was.copy(), np.array([max([0.0, *np.delete(drift, c)]) for c in range(len(drift))])
                    upper = (np.frombuffer(r["upper"], "<f8") + drift[own]) * (1 + ROUNDING)
                    lower = np.frombuffer(r["lower"], "<f8") - far[own]
                    lower = lower - np.abs(lower) * ROUNDING
                    open_ = ~(upper < lower)
                if open_.any():
                    own[open_], upper[open_], lower[open_] = nearest(v[open_], centroids)
                sums = [] if last else moved_sums(v, was, own, len(centroids))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([r["block"]], pa.int64()),
                        "cluster": pa.array([own.astype("<i4").tobytes()], pa.binary()),
                        "upper": pa.array([upper.astype("<f8").tobytes()], pa.binary()),
                        "lower": pa.array([lower.astype("<f8").tobytes()], pa.binary()),
                        "scans": pa.array([int(open_.sum())], pa.int64()),
                        "sums": pa.array([sums], pa.list_(pa.int64())),
                    }
                )
            tidy()

    return run


def rows_of(centroids: list[list[int]]):
    """Blocks as rows of vectors with the exact squared distance to their centroid."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                v, own = values(r["x"], r["wide"]), np.frombuffer(r["cluster"], "<i4")
                d = np.zeros(len(v), object)
                for c in np.unique(own).tolist():
                    d[own == c] = squares(v[own == c], [centroids[c]])[:, 0]
                d = [int(x) if x < 1 << 63 else None for x in d]
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(r["vec_ids"], pa.int64()), "cluster": pa.array(own), "distance": pa.array(d, pa.int64())})

    return run


def added(sums: list[int], state: DataFrame, k: int) -> tuple[int, list[int]]:
    """How many vectors a round has scanned, and ``sums`` (counts and components by cluster) with what its blocks tell:
    one number a place comes to the driver.
    """
    width = k * (DIMS + 1)
    out, scans = list(sums) or [0] * width, 0
    told = state.select(F.posexplode(F.concat(F.array("scans"), "sums")).alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    for place, v in told.collect():
        if place:
            out[(place - 1) % width] += int(v) << (LIMB * ((place - 1) // width))
        else:
            scans = int(v)
    return scans, out


def moved(centroids: list[list[int]], sums: list[int]) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    rows = [sums[c * (DIMS + 1) : (c + 1) * (DIMS + 1)] for c in range(len(centroids))]
    return [[s // r[0] for s in r[1:]] if r[0] else old for old, r in zip(centroids, rows, strict=True)]


def centroid_digest(c: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: int = SALT) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia and the digest
    of its final centroid.
    """
    found, centroids, _ = assigned(vectors, k, rounds, salt)
    total = F.sum(F.col("distance").cast("decimal(28,0)"))
    sums = found.groupBy("cluster").agg(total.alias("_t"), F.count("*").alias("_n"), F.count("distance").alias("_d"))
    fitting = lambda n, d, t: F.when(n == d, t.try_cast("long"))
    everything = sums.agg(fitting(F.sum("_n"), F.sum("_d"), F.sum("_t")).alias("inertia"))
    sums = sums.withColumn("cluster_inertia", fitting(F.col("_n"), F.col("_d"), F.col("_t")))
    digests = vectors.sparkSession.createDataFrame([(c, centroid_digest(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # k rows and one row: bounded
    per_cluster = sums.drop("_t", "_n", "_d").join(F.broadcast(everything)).join(F.broadcast(digests), "cluster")
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_hamerly(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """The same by full scans in every round, for tables of ordinary components."""
    n = CLUSTERS
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT x, sha256('{SALT}:' || vec_id) AS h FROM v) ORDER BY h NULLS LAST, x LIMIT {n})",
    ]
    for k in range(ROUNDS + 1):
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := {d}, c := c)) AS m FROM v, c{k} c GROUP BY r)")
        if k < ROUNDS:
            s, m = "sum(val)", "count(*)"
            floor = f"((({s} - ((({s} % {m}) + {m}) % {m})) // {m}))::BIGINT"
            means = f"SELECT c, list(q ORDER BY i) AS x FROM (SELECT a.m['c'] AS c, i, {floor} AS q FROM a{k} a JOIN v USING (r), LATERAL (SELECT unnest(v.x) AS val, generate_subscripts(v.x, 1) AS i) GROUP BY ALL) GROUP BY c"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.x, o.x) AS x FROM c{k} o LEFT JOIN ({means}) u USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m['c']::INTEGER AS cluster, m['d']::BIGINT AS distance, (sum(m['d']) OVER (PARTITION BY m['c']))::BIGINT AS cluster_inertia, (sum(m['d']) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} f ON f.c = m['c']"""


ORACLE_SQL = oracle_sql()
