"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one node that knows the smallest ids of its copies; as many as a query can return are enough, and
they are found with salts, so a vector that a third of all rows hold is no hot key. Vectors of one length whose largest
components are of like size are a world; every query meets all worlds of its length. Nodes of a world are dealt to
shards of about SHARD_NODES, and every block of QUERY_BLOCK queries meets every shard, so n rows cost n * queries /
SHARD_NODES searches and each of the two is copied for every other: both are as large as a task can well hold. In a
shard every node, once, searches the graph greedily from the middle; what it meets on the way is pruned, so that of two
candidates in one direction the nearer stays unless the other is RELAXED times nearer to the node than to it; kept edges
are also offered backwards. Beam search runs a block of queries over a shard side by side. The shards' best are ranked
again in double precision on the original vectors.

Largest inner product becomes least distance by one more component, which gives all nodes the length of the longest.
Components are divided by the world's largest one first, so no square overflows and none vanishes beside a giant.

Defined results: vectors that are null, zero or hold null or non-finite components neither ask nor answer; a query's
own row is left out, its copies are not; vectors with unlike numbers of components never meet, so a query finds those of
its own kind; a product beyond a double is an infinity, and one of infinities that cancel out ranks as the least; ties
go to the smaller id; with fewer candidates than K a query gets all of them; rows with equal ids and vectors are one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_per_key, table, written

K, QUERY_EVERY = 20, 20
SHARD_NODES, QUERY_BLOCK = 16_384, 32_768
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXED, SEED = 32, 48, 128, 1.2, 5
BATCH, SLACK, SALTS = 256, 16, 64
BAND = 10  # powers of two that the largest components of one world's vectors may differ by


def usable(x: Column) -> Column:
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def distances(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``at`` (queries x candidates) of x to each query; all x have one length."""
    return -np.matmul(x[at], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, visited: bool = False):
    """The ``beam`` nearest nodes met by each query, nearest first; with ``visited`` all that were expanded too."""
    n, b = len(x), len(q)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    met = np.zeros((b, n + 1), bool)  # the last column takes the places without an edge
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = -(q @ x[entry])
    met[:, entry] = True
    walk: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(b)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        at = open_.argmin(1)
        go = np.isfinite(open_[np.arange(len(rows)), at])
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        here = ids[rows, at]
        done[rows, at] = True
        if visited:
            walk.append((rows, here))
        near = edges[here]
        place = np.where(near >= 0, near, n)
        new = (near >= 0) & ~met[rows[:, None], place]
        met[rows[:, None], place] = True
        d = np.where(new, distances(x, q[rows], np.maximum(near, 0)), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[rows], d], 1)
        best = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], 1), best, 1)
    order = np.argsort(dist, 1, kind="stable")
    ids = np.take_along_axis(np.where(np.isfinite(dist), ids, -1), order, 1)
    if not visited:
        return ids
    path = np.full((b, len(walk)), -1, np.int64)
    for k, (r, h) in enumerate(walk):
        path[r, k] = h
    return np.concatenate([ids, path], 1)


def pruned(x: np.ndarray, own: np.ndarray, cand: np.ndarray, relaxed: float) -> np.ndarray:
    """For nodes ``own`` at most DEGREE of their candidates (-1: none), nearest first, in different directions."""
    out = np.full((len(own), DEGREE), -1, np.int64)
    for a in range(0, len(own), BATCH):
        out[a : a + BATCH] = _pruned(x, own[a : a + BATCH], cand[a : a + BATCH], relaxed)
    return out


def _pruned(x: np.ndarray, own: np.ndarray, cand: np.ndarray, relaxed: float) -> np.ndarray:
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == own[:, None]] = -1
    vectors = x[np.maximum(cand, 0)]
    square = (x[0] ** 2).sum()  # of every node's length
    d = 2 * square - 2 * np.matmul(vectors, x[own][:, :, None])[:, :, 0]
    d = np.where(cand >= 0, np.maximum(d, 0), np.inf)
    # distances between candidates, relaxed: one product of matrices a node
    between = (relaxed**2) * np.maximum(2 * square - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0)
    out = np.full((len(own), DEGREE), -1, np.int64)
    b = np.arange(len(own))
    for k in range(DEGREE):
        at = d.argmin(1)
        some = np.isfinite(d[b, at])
        if not some.any():
            break
        out[some, k] = cand[b, at][some]
        d[between[b, at] <= d] = np.inf
        d[b, at] = np.inf
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (nodes x DEGREE, -1: none) and the entry node of a shard.

    Edges offered backwards are taken into SLACK more places as they come; a node is pruned again when these are full.
    """
    n = len(x)
    rng = np.random.default_rng(SEED)
    entry = int((x @ x.mean(0)).argmax())
    edges = np.full((n, DEGREE + SLACK), -1, np.int64)
    edges[:, :DEGREE] = rng.integers(0, n, (n, DEGREE))
    edges[edges == np.arange(n)[:, None]] = -1
    order = rng.permutation(n)
    for a in range(0, n, BATCH):
        own = order[a : a + BATCH]
        met = beam_search(x, edges, entry, x[own], min(BUILD_BEAM, n), visited=True)
        kept = pruned(x, own, np.concatenate([met, edges[own]], 1), RELAXED)
        edges[own] = -1
        edges[own, :DEGREE] = kept
        src, dst = np.repeat(own, DEGREE)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
        known = (edges[dst] == src[:, None]).any(1)
        src, dst = src[~known], dst[~known]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        if not len(dst):
            continue
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        times = np.diff(np.append(first, len(dst)))
        nodes = dst[first]
        filled = np.sort(edges[nodes], 1)[:, ::-1]  # free places last
        free = (filled < 0).sum(1)
        place = np.arange(len(dst)) - np.repeat(first, times) + np.repeat(edges.shape[1] - free, times)
        fits = np.repeat(times <= free, times)
        row = np.repeat(np.arange(len(nodes)), times)
        filled[row[fits], place[fits]] = src[fits]
        edges[nodes] = filled
        over = np.flatnonzero(times > free)
        # nodes with like numbers of offers go together, so that one hub does not widen all rows
        width = 1 << np.ceil(np.log2(times[over])).astype(int)
        for wide in np.unique(width):
            some = over[width == wide]
            offered = np.full((len(some), wide), -1, np.int64)
            offered[np.arange(wide) < times[some, None]] = src[np.isin(row, some)]
            kept = pruned(x, nodes[some], np.concatenate([filled[some], offered], 1), RELAXED)
            edges[nodes[some]] = -1
            edges[nodes[some], :DEGREE] = kept
    return pruned(x, np.arange(n), edges, RELAXED), entry


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the k + 1 smallest ids of their rows, ascending."""
    salted = vectors.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).dropDuplicates(["vec_id", "embedding"])
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("embedding", "_salt").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    return some.groupBy("embedding").agg(ids.alias("ids"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors`` for ``queries`` (both vec_id, embedding)."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    ask = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ask = ask.filter(usable(F.col("embedding")) & F.col("query_id").isNotNull()).dropDuplicates(["query_id", "embedding"])
    band = F.floor(F.log2("most") / BAND).cast("long")
    nodes = nodes_of(good, k).withColumn("length", F.size("embedding")).withColumn("most", F.array_max(F.transform("embedding", F.abs)))
    nodes = written(nodes.withColumn("world", F.col("length").cast("long") * 4096 + 2048 + band), "nodes")
    ask = written(ask.withColumn("length", F.size("embedding")), "queries")
    # each world's shards, largest component and longest vector over that
    total, asked = nodes.count(), ask.count()
    most = nodes.groupBy("world").agg(F.max("most").alias("unit"), F.count("*").alias("n"))
    own = join_per_key(nodes, written(most, "units"), "world", "n", total)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + (v / F.col("unit")) * (v / F.col("unit")))
    worlds = own.groupBy("world", "length", "unit", "n").agg(F.max(norm).alias("longest"))
    worlds = written(worlds.withColumn("shards", F.ceil(F.col("n") / SHARD_NODES).cast("int")), "worlds")
    n_shards = worlds.agg(F.sum("shards")).first()[0] or 1
    n_blocks = max(1, -(-asked // QUERY_BLOCK))

    def lifted(v: np.ndarray, unit: float, longest: float) -> np.ndarray:
        v = v / unit
        rest = np.sqrt(np.maximum(longest - (v * v).sum(1), 0))
        return np.concatenate([v, rest[:, None]], 1).astype(np.float32) / np.float32(np.sqrt(longest))

    def measure(shard: pa.Table) -> tuple[float, float]:
        return shard.column("unit")[0].as_py(), shard.column("longest")[0].as_py()

    def index(group: pa.Table) -> pa.Table:
        edges, entry = build(lifted(matrix(group.column("embedding")), *measure(group)))
        ends = np.arange(len(edges) + 1, dtype=np.int32) * DEGREE
        group = group.append_column("edges", pa.ListArray.from_arrays(pa.array(ends), pa.array(edges.ravel().astype(np.int32))))
        return group.append_column("node", pa.array(np.arange(len(edges), dtype=np.int32))).append_column("entry", pa.array(np.full(len(edges), entry, np.int32)))

    sharded = join_per_key(nodes.drop("most", "length"), worlds.drop("length"), "world", "n", total)
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), "shards").cast("int")).select("world", "shard", "ids", "embedding", "unit", "longest")
    # a number of partitions of its own, well over that of shards: adaptive execution puts none together, and few collide
    sharded = sharded.repartition(8 * n_shards, "world", "shard")
    graph = sharded.groupBy("world", "shard").applyInArrow(index, "world long, shard int, ids array<long>, embedding array<double>, unit double, longest double, edges array<int>, node int, entry int")
    graph = written(graph, "graph")

    def search(key, shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(shard) and len(asked):
            shard = shard.sort_by("node")
            v, ids = matrix(shard.column("embedding")), shard.column("ids").to_pylist()
            x, edges = lifted(v, *measure(shard)), matrix(shard.column("edges")).astype(np.int64)
            entry = shard.column("entry")[0].as_py()
            q, q_ids = matrix(asked.column("embedding")), asked.column("query_id").to_numpy()
            zero = np.zeros((BATCH, 1), np.float32)
            for a in range(0, len(q), BATCH):
                qs = q[a : a + BATCH]
                direction = qs / np.abs(qs).max(1, keepdims=True)
                direction = direction / np.sqrt((direction * direction).sum(1, keepdims=True))
                unit = np.concatenate([direction.astype(np.float32), zero[: len(qs)]], 1)
                found = beam_search(x, edges, entry, unit, max(min(SEARCH_BEAM, len(x)), 1))
                for one, i, near in zip(qs, q_ids[a : a + BATCH].tolist(), found, strict=True):
                    near = near[near >= 0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        products = np.nan_to_num(v[near] @ one, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    best = sorted((-s, c) for s, m in zip(products.tolist(), near.tolist(), strict=True) for c in ids[m] if c != i)[:k]
                    out += [(i, c, -s) for s, c in best]
        rows = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "vec_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64())})

    # every query meets every shard: blocks of queries are copied to the shards, shards to the blocks
    lengths = worlds.groupBy("length").agg(F.sum("n").alias("n"), F.collect_list(F.struct("world", "shards")).alias("worlds"))  # 4096 / BAND at most
    blocked = join_per_key(ask, lengths, "length", "n", total).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    blocked = blocked.select("query_id", "embedding", "block", F.explode("worlds").alias("w")).select("*", "w.*").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("world", "shard", "block")
    right = blocked.select("query_id", "embedding", "world", "shard", "block").groupBy("world", "shard", "block")
    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_graph_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))
