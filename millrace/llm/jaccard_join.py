"""Exact set-similarity self-join of documents on word n-grams, by a partition of the hashed universe.

*Sets.* A document's set holds its distinct shingles of N words (one shorter sequence if it has fewer words); texts
with equal sets are one node. *Size bands.* Band i reaches from L[i] to L[i + 1] - 1, where L[i + 1] is the first size
too large to be similar to L[i]; the smaller set of a similar pair and the larger lie in one band or in neighbours.
*Pigeonhole.* If the smaller set is of band i, a similar pair differs in at most H[i] shingles, so if the universe is
hashed into H[i] + 1 segments, the two sets agree in one of them. Every set files the hash of what it has in each
segment, for its band and the one below. *Allocation.* Empty segments agree for far too many sets. So a band also has
``a`` segments for which one-deletion neighbourhoods are filed (all but one of the segment's shingles); a set gains one
guaranteed difference from each of them and in return leaves out its empty segments. Sets with more empty segments than
that files them all. ``a`` is chosen band by band to make filed neighbourhoods and expected pairs of such sets cheapest
by the band's size. *Verification* compares the sets of words themselves; hashes only propose.

Filed hashes travel in blocks of their residue, in which a task finds equal ones: 4 bytes each (blocks grow in number,
not in size, so chance hits stay one in ten thousand) and 5 bytes of the set's key for each set and block; sets whose
5 bytes agree are a group of their own. Of the nodes that share a hash, those
with the one that shares most are compared first; nodes that links have joined by then need no comparison, and the
others are compared pair by pair. A pair is compared only if its sizes and parity sketches allow it: a sketch has
64 * LANES bits, each the parity of the shingles that hash to it, so two sketches differ in no more bits than their
sets in shingles. That bound is exact, so the components are, and thousands of near copies cost a few comparisons each.
Sets too large for such a sketch have wider ones, with about as many bits as shingles; only pairs that those allow as well
have their texts brought together.

Defined results: texts without words have an empty set, are their own component and link with nothing; repeated rows
link; rows with equal ids are one document; a null id links with nothing and has no component; an empty table gives an
empty result; other columns are not read (``keep_one`` returns them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_per_key, table, tidy, written
from millrace.llm.encode import steps

WORDS, NUM, DEN = 4, 85, 100
#: Hashes that a task sorts at once, and holds before it sends them; sets that a Python worker remembers as filed;
#: hashes of words it remembers.
BLOCK_HASHES, HELD_HASHES, REMEMBERED, KNOWN_WORDS = 1_000_000, 500_000, 200_000, 100_000
#: Bytes of text whose hashes a task files at a time: filing for two bands takes some 50 times that.
STEP_BYTES = 1_000_000
#: What a node of a needless group costs in filed hashes (300 bytes to 10), a pair that sketches rule out (0.1 to 1
#: microsecond), and each shingle of a pair that they can't (two texts travel).
MEMBER_COST, PAIR_COST, TEXT_COST = 30.0, 0.1, 1.2
#: Bits by which a set's first key is cut to 40 in filed hashes.
CUT = np.uint64(24)
#: Pairs whose texts a task unpacks at a time, and shingles of the sets it remembers between pairs.
PAIRS_AT_ONCE, KNOWN_SHINGLES = 32, 100_000
#: Members of a group that one task compares pair by pair.
CHUNK = 2048
#: Rounds of comparing with one node of a group before all open pairs are compared.
PIVOT_ROUNDS = 2
#: Longs of a parity sketch.
LANES = 8
SKETCH = [f"p{k}" for k in range(LANES)]
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_ODD = [U(int.from_bytes(hashlib.sha256(b"place %d" % i).digest()[:8], "little") | 1) for i in range(64)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def finished() -> None:
    """At a task's end: the Python worker goes on to other stages' tasks."""
    _words.clear()
    tidy()


def hashed_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of every text's set, one text behind the other, and their offsets."""
    out, sizes = [], []
    for t in texts.to_pylist():
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        n = len(w)
        if not n:
            sizes.append(0)
            continue
        h = np.fromiter(map(_words.__getitem__, w), U, n)
        if n < words:
            s = mix((h * np.array(_ODD[32 : 32 + n])).sum(dtype=U)[None] + U(n))
        else:
            s = h[: n - words + 1] * _ODD[0]
            for k in range(1, words):
                s = s + h[k : n - words + 1 + k] * _ODD[k]
            s = np.sort(mix(s))
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        sizes.append(len(s))
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 for an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    keys = np.zeros((2, len(offsets) - 1), U)
    if len(full):
        for k in range(2):
            keys[k, full] = mix(np.add.reduceat(mix(hashes ^ _ODD[40 + k]), offsets[full]))
    return keys[0], keys[1]


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches of the sets, as LANES longs each."""
    n = len(offsets) - 1
    bit = (mix(hashes ^ _ODD[45]) % U(64 * LANES)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * (64 * LANES) + bit, minlength=n * 64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").reshape(n, LANES)


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch of one set, with 64 * LANES bits or the next doubling that reaches its size."""
    bits = 64 * LANES
    while bits < len(hashes):
        bits *= 2
    at = (mix(hashes ^ _ODD[45]) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the wider is folded, which keeps parities true."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(a: str, b: str, num: int, den: int) -> Column:
    """Whether the sizes and sketches of two aliased rows allow similarity: |a ^ b| <= (den - num) / (den + num) * (|a| + |b|)."""
    small = F.least(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    large = F.greatest(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in SKETCH[1:]), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    return (small * den >= large * num) & (differ * (den + num) <= (small + large) * (den - num))


def bands(num: int, den: int, largest: int) -> list[int]:
    """L[0], L[1], ... beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * den // num + 1)
    return [*out, out[-1] * den // num + 1]


def segments(bounds: list[int], band: int, num: int, den: int) -> int:
    return (bounds[band + 1] - 1) * (den - num) // num + 1


def poisson_up_to(k: int, mean: float) -> float:
    """Probability of at most ``k`` where ``mean`` are expected."""
    if mean <= 0:
        return 1.0
    i = np.arange(k + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(i[1:]))])
    return float(np.exp(i * np.log(mean) - mean - log_factorial).sum())


def allocation(bounds: list[int], counts: dict[int, int], num: int, den: int) -> list[int]:
    """For each band, how many segments get one-deletion neighbourhoods: the number of least expected cost."""
    out = []
    for band in range(len(bounds) - 1):
        m = segments(bounds, band, num, den)
        n = counts.get(band, 0) + counts.get(band + 1, 0)
        per = bounds[band] / m  # shingles a segment, of the band's smallest sets
        p0, p1 = np.exp(-per), per * np.exp(-per)
        large = bounds[band + 1]
        apart = 32 * LANES * (1 - np.exp(-4 * large / (64 * LANES)))  # bits in which unlike sets' sketches differ
        pair = PAIR_COST if 0.8 * apart > 2 * large * (den - num) / (den + num) else TEXT_COST * large
        best, cost = 0, np.inf
        # large sets have many segments and so many empty ones: twice their mean and a wide margin is always enough
        for a in range(0, min(m, int(2 * m * p0 + 10 * np.sqrt(m * p0 + 1) + 16)) + 1, 1 + m // 4096):
            within = poisson_up_to(a, (m - a) * p0 + a * (p1 + 2 * p0))
            needless = n * max(0.0, 1 - within) * (a + 1)  # members of groups that share an empty segment
            c = n * a * (per + 1) + MEMBER_COST * needless + pair * needless**2 / (2 * m)
            if c < cost:
                best, cost = a, c
        out.append(best)
    return out


def filed(hashes, offsets, keys, bounds, extra, num, den) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that every set files and the set's number for each."""
    size = np.diff(offsets)
    own = np.searchsorted(bounds, size, "right") - 1
    mixed = mix(hashes ^ _ODD[50])
    sigs, docs = [], []
    seg_counts = np.array([segments(bounds, b, num, den) for b in range(len(bounds) - 1)], np.int64)
    extra = np.array(extra, np.int64)
    for below in (0, 1):
        band = own - below
        use = (size > 0) & (band >= 0)
        # a set larger than any partner of the band below has nothing to file there; one segment means equal sets
        use &= size * num <= (np.take(bounds, np.maximum(band, 0) + 1) - 1) * den
        use &= seg_counts[np.maximum(band, 0)] > 1
        pick = np.flatnonzero(use)
        if not len(pick):
            continue
        at = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in pick])
        doc = np.repeat(pick, size[pick])
        m, a = seg_counts[band[doc]], extra[band[doc]]
        seg = ((hashes[at] >> U(32)) * m.astype(U) >> U(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])]))
        count = np.diff(np.append(start, len(at)))
        total = np.add.reduceat(mixed[at], start)
        salt = (band[doc[start]].astype(U) << U(40)) + seg[start].astype(U)
        sigs.append(mix(total ^ mix(salt)))
        docs.append(doc[start])
        near = np.flatnonzero((seg < a) & (np.repeat(count, count) > 1))
        if len(near):
            of = np.repeat(np.arange(len(start)), count)[near]
            sigs.append(mix((total[of] - mixed[at[near]]) ^ mix(salt[of])))
            docs.append(doc[near])
        # sets with too few guaranteed differences file their empty segments as well
        has = np.bincount(doc[start], minlength=len(size))
        few = seg[start] < a[start]
        in_a = np.bincount(doc[start][few], minlength=len(size))
        single = np.bincount(doc[start][few & (count == 1)], minlength=len(size))
        for d in pick:
            md, ad = int(seg_counts[band[d]]), int(extra[band[d]])
            none_a = ad - in_a[d]
            if ad - (md - ad - (has[d] - in_a[d])) - single[d] - 2 * none_a < 0:
                mine = np.setdiff1d(np.arange(md), seg[doc == d])
                sigs.append(mix(mix((U(int(band[d])) << U(40)) + mine.astype(U))))
                docs.append(np.full(len(mine), d))
    return (np.concatenate(sigs), np.concatenate(docs)) if sigs else (np.zeros(0, U), np.zeros(0, np.int64))


def keyed_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the set's key (16 bytes), the key's first half and the set's sketch."""

    def run(batches):
        for batch in batches:
            done = 0
            for texts in steps(batch.column("text"), STEP_BYTES):
                h, o = hashed_sets(texts, words)
                k1, k2 = set_keys(h, o)
                both = np.stack([k1, k2], 1).astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(texts)),
                        pa.array(np.diff(o)),
                        pa.array([both[i : i + 16] for i in range(0, len(both), 16)], pa.binary()),
                        pa.array((k1 >> CUT).astype(np.int64)),
                        *[pa.array(lane) for lane in sketches(h, o).T],
                    ],
                    names=["doc_id", "n_shingles", "key", "half", *SKETCH],
                )
                done += len(texts)
        finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, half long, " + ", ".join(f"{p} long" for p in SKETCH))


def sharing(docs: DataFrame, sizes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Groups of nodes (first 40 bits of keys) that share a filed hash: arrays of at least two, each once a task."""
    largest = sizes.agg(F.max("n_shingles")).first()[0] or 0
    bounds = bands(num, den, largest)
    edges = F.array(*map(F.lit, bounds))
    band = F.size(F.filter(edges, lambda x: x <= F.col("n_shingles"))) - 1
    counts = {r["band"]: r["count"] for r in sizes.filter("n_shingles > 0").groupBy(band.alias("band")).count().collect()}
    extra = allocation(bounds, counts, num, den)
    expected = sum(n * 2 * (segments(bounds, b, num, den) + 5 * extra[b]) for b, n in counts.items())
    n_blocks = max(16, -(-expected // BLOCK_HASHES))
    limits = np.array(bounds, np.int64)

    def sent(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        """One row a block: its hashes by node, the nodes and how many hashes in a row are theirs (255 at most)."""
        block = (sig % U(n_blocks)).astype(np.int64)
        order = np.lexsort((node, block))
        short, node, block = (sig // U(n_blocks))[order].astype("<u4"), node[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (node[1:] != node[:-1])]))
        place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
        runs = np.flatnonzero(place % 255 == 0)
        times = np.diff(np.append(runs, len(node))).astype(np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(cut[1:], len(block))
        rows = [
            (int(block[a]), short[a:b].tobytes(), _five(node[runs[x:y]]), times[x:y].tobytes())
            for a, b, x, y in zip(cut, ends, np.searchsorted(runs, cut), np.searchsorted(runs, ends), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["block", "hashes", "nodes", "times"])

    def file(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for texts in steps(batch.column("text"), STEP_BYTES):
                h, o = hashed_sets(texts, words)
                k1, _ = set_keys(h, o)
                new = np.zeros(len(texts), bool)
                for i, k in enumerate(k1.tolist()):
                    if k not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(k)
                        new[i] = True
                keep = np.flatnonzero(new & (np.diff(o) > 0))
                if not len(keep):
                    continue
                size = np.diff(o)[keep]
                h = np.concatenate([h[o[d] : o[d + 1]] for d in keep])
                sig, doc = filed(h, np.concatenate([[0], np.cumsum(size)]), k1[keep], limits, extra, num, den)
                held.append((sig, (k1[keep] >> CUT)[doc]))
                if sum(len(x) for x, _ in held) >= HELD_HASHES:
                    yield sent(*map(np.concatenate, zip(*held, strict=True)))
                    held.clear()
        if sum(len(x) for x, _ in held):
            yield sent(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        finished()

    def match(group: pa.Table) -> pa.Table:
        columns = (group.column(c).to_pylist() for c in ("hashes", "nodes", "times"))
        hashes, nodes, times = map(b"".join, columns)
        sig, node = np.frombuffer(hashes, "<u4"), np.repeat(_from_five(nodes), np.frombuffer(times, np.uint8))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(start, len(sig)))
        found = {node[s : s + c].tobytes() for s, c in zip(start[count > 1], count[count > 1], strict=True)}
        lists = [np.frombuffer(x, np.int64) for x in sorted(found)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        return pa.table({"nodes": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    blocks = docs.select("doc_id", "text").mapInArrow(file, "block long, hashes binary, nodes binary, times binary")
    return blocks.groupBy("block").applyInArrow(match, "nodes array<long>").distinct()


def _five(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def shingle_set(text: str | None, words: int) -> set:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*[w[k:] for k in range(words)], strict=False))


def wide_sketches(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and wide of the sets that the narrow sketches are too short for. ``texts``: doc_id, text."""

    def run(batches):
        for batch in batches:
            done = 0
            for part in steps(batch.column("text"), STEP_BYTES):
                h, o = hashed_sets(part, words)
                size = np.diff(o)
                big = np.flatnonzero(size > 64 * LANES)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(part)).take(pa.array(big)),
                        pa.array(size[big]),
                        pa.array([wide_sketch(h[o[d] : o[d + 1]]) for d in big], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "wide"],
                )
                done += len(part)
        finished()

    return texts.mapInArrow(run, "doc_id long, n_shingles long, wide binary")


def sketched_alike(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs``, both with wide sketches, that these allow."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            keep = [(den + num) * sketch_distance(x, y) <= (den - num) * (n + m) for n, m, x, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(wide.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("wide").alias("x")), "a")
    both = one.join(wide.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("wide").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar, by their words. ``texts``: doc_id, text."""

    def run(batches):
        known: dict[int, set] = {}

        def of(i, text):
            if i not in known:
                new = shingle_set(text, words)
                while known and sum(map(len, known.values())) + len(new) > KNOWN_SHINGLES:
                    known.pop(next(iter(known)))
                known[i] = new
            return known[i]

        for batch in batches:
            keep = []
            for at in range(0, len(batch), PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                    s, t = of(a, x), of(b, y)
                    same = sum(map(t.__contains__, s))
                    keep.append(den * same >= num * (len(s) + len(t) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        known.clear()
        tidy()

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes that have an edge.

    Labels spread to neighbours and jump to their label's label, so a chain of n links takes about log2(n) rounds; a
    round is one join by node for each and one small table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = written(closer.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", "far").alias("label")), "labels")
        changed = new.filter("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def pairs_with(pivots: DataFrame, members: DataFrame, total: int, num: int, den: int) -> DataFrame:
    """Open pairs (see ``opened``) of each group's pivot with the group's other members. Pivots of the groups that
    hold more than a fixed share of all members are broadcast, so a hot group's members stay where they are.
    """
    named = {"node": "pivot", "label": "pivot_label", "n_shingles": "n_pivot", **{p: f"pivot_{p}" for p in SKETCH}}
    both = join_per_key(members, pivots.select("group", "size", *[F.col(c).alias(n) for c, n in named.items()]), "group", "size", total)
    x = F.struct(*[F.col(n).alias(c) for c, n in named.items()])
    y = F.struct(*named)
    return opened(both.filter("pivot is not null and pivot != node").select(x.alias("x"), y.alias("y")), num, den)


def pairs_within(members: DataFrame, num: int, den: int) -> DataFrame:
    """All open pairs (see ``opened``) of each group. A group of over CHUNK members is cut into chunks by hash, and
    each two chunks meet in a task of their own.
    """
    row = F.struct("node", "label", "n_shingles", *SKETCH)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("int")
    cut = members.select("group", chunks.alias("_chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("own"), row.alias("r"))
    others = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    left = others.filter("own <= other").select("group", F.col("own").alias("i"), F.col("other").alias("j"), F.col("r").alias("x"))
    right = others.filter("other <= own").select("group", F.col("other").alias("i"), F.col("own").alias("j"), F.col("r").alias("y"))
    met = left.join(right, ["group", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x.node") < F.col("y.node")))
    return opened(met, num, den)


def opened(met: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, large) of the rows x and y that are not yet of one component, and that sizes and sketches allow."""
    open_ = met.filter((F.col("x.label") != F.col("y.label")) & may_be_similar("x", "y", num, den))
    large = F.least("x.n_shingles", "y.n_shingles") > 64 * LANES
    return open_.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), large.alias("large")).distinct()


def similar_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id. Links are not returned: pairs already in one component are not compared."""
    keys = written(keyed_sets(docs, words), "sets")
    known = keys.filter("doc_id is not null and n_shingles > 0")
    once = [F.min(c).alias(c) for c in ("half", "n_shingles", *SKETCH)]
    nodes = written(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *once), "nodes")
    alike = nodes.groupBy("half").count().filter("count > 1").select(F.array("half").alias("nodes"))
    groups = sharing(docs, keys, words, num, den).unionByName(alike)
    groups = written(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    members = groups.select("group", F.explode("nodes").alias("half")).join(nodes.select("half", "node"), "half").select("group", "node").distinct()
    members = written(members, "membership")
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    # the node in most groups comes first; an original shares more with its copies than they with each other. Only
    # PIVOT_ROUNDS rows a group and task are shuffled for it
    order = Window.partitionBy("group").orderBy(F.desc("degree"), "node")
    ranked = members.join(degree, "node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOT_ROUNDS)
    pivots = written(ranked.select("group", "node", "rank").join(sizes, "group"), "pivots")
    in_groups = members.select("node").distinct()
    sketched = written(nodes.select("node", "n_shingles", *SKETCH).join(in_groups, "node", "left_semi"), "sketched")
    total = members.count()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(in_groups.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), "texts")
    wide = written(wide_sketches(texts, words), "wide")
    links, labels, tested = None, None, None
    for k in range(1, PIVOT_ROUNDS + 2):
        label = F.col("node") if labels is None else F.coalesce("label", "node")
        now = (sketched if labels is None else sketched.join(labels, "node", "left")).select("node", label.alias("label"), "n_shingles", *SKETCH)
        if k <= PIVOT_ROUNDS:
            rows = written(members.join(now, "node"), "members")
            pairs = pairs_with(pivots.filter(F.col("rank") == k).drop("rank").join(now, "node"), rows, total, num, den)
        else:
            # groups that have become one component are done
            rows = members.join(now, "node")
            left = rows.groupBy("group").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
            pairs = pairs_within(written(join_per_key(rows, left.select("group", "size"), "group", "size", total).filter("size is not null"), "members"), num, den)
        pairs = pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.limit(1).count() == 0:
            continue  # nodes of later ranks may still be alike: only the last round compares all open pairs
        tested = pairs if tested is None else tested.unionByName(pairs)
        allowed = written(sketched_alike(pairs.filter("large").select("a", "b"), wide, num, den), "allowed")
        likely = pairs.filter("not large").select("a", "b").unionByName(allowed)
        new = written(linked(likely, texts, words, num, den), "links")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    rep = nodes.select("node", "key", "copies")
    rep = rep.withColumn("component_id", F.col("node")) if labels is None else rep.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    with_set = join_per_key(known, rep.select("key", "component_id", "copies"), "key", "copies", known.count()).select("doc_id", "n_shingles", "component_id")
    # rows with equal ids are one document
    bare = keys.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return with_set.unionByName(bare)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that a smaller id of their component stands for, with the columns they came with."""
    found = similar_components(docs, words, num, den)
    gone = found.filter("component_id is not null and component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op10_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"))
