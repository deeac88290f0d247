"""Packing by non-negative least squares.

Each task packs its own documents, in blocks of a bounded number of ids, so nothing is shuffled and the order of the
input holds from block to block. A document longer than the window gives full windows first. The rest, one piece a
document, is counted by length in steps of GRAIN. The columns of the problem are the combinations of at most DEPTH
lengths that fill the window; repeat counts that match the histogram come from non-negative least squares (an active
set method: at most one column a bin is used), are rounded down and dealt out. What is left is packed greedily:
longest first into the fullest open sequence it fits, and where none has room the piece is cut to fill the fullest
ones. A block's last open sequence is cut into powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed as documents of their
own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table, tidy
from millrace.llm.encode import encoder, steps

WINDOW, GRAIN, DEPTH = 2048, 32, 3
#: Ids that a task holds at a time, about 50 MB.
BLOCK_IDS = 6_000_000
#: Sequence ids: the task's number, then its sequences.
TASK_BITS = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


@lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """All ways to fill ``bins`` with 2 to ``depth`` parts, as a matrix: how many of each part size every way uses."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for p in range(parts[-1] if parts else 1, left + 1):
                if p == left or (len(parts) + 1 < depth and left - p >= p):
                    extend((*parts, p), left - p)

    extend((), bins)
    out = np.zeros((bins, len(found)))
    for j, parts in enumerate(found):
        for p in parts:
            out[p - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: columns enter by steepest gradient and leave where they would turn negative."""
    x = np.zeros(a.shape[1])
    used: list[int] = []
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[used] = 0
        j = int(gain.argmax())
        if gain[j] <= 1e-6 * (1 + abs(b).max()):
            break
        used.append(j)
        while used:
            s = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s.min() > 0:
                break
            now = x[used]
            down = s <= 0
            t = (now[down] / np.maximum(now[down] - s[down], 1e-300)).min()
            now = now + t * (s - now)
            x[used] = now
            keep = now > 1e-9
            keep[down & (now <= now[down].min())] = False
            x[[u for u, k in zip(used, keep, strict=True) if not k]] = 0
            used = [u for u, k in zip(used, keep, strict=True) if k]
        x[used] = s if used else 0
    return x


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH):
    """Pack pieces of 1 to ``window`` - 1 ids: rows (piece, from, length, sequence, offset), sequences from 0."""
    bins = window // grain
    of = (lengths + grain - 1) // grain - 1  # a piece counts as the next multiple of the grain
    histogram = np.bincount(of, minlength=bins).astype(float)
    a = combinations(bins, depth)
    repeats = np.floor(nnls(a, histogram) + 1e-9).astype(int)
    stock = [np.flatnonzero(of == b)[::-1].tolist() for b in range(bins)]
    rows, left, n = [], [], 0
    for j in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
        sizes = [b for b in range(bins) for _ in range(int(a[b, j]))]
        for _ in range(int(repeats[j])):
            if any(len(stock[b]) < sizes.count(b) for b in set(sizes)):
                break  # rounding left too few of one size
            at = 0
            for b in sizes:
                i = stock[b].pop()
                rows.append((i, 0, int(lengths[i]), n, at))
                at += int(lengths[i])
            if at < window:
                left.append((window - at, n))
            n += 1
    rest = sorted((i for s in stock for i in s), key=lambda i: (-lengths[i], i))
    room = sorted(left)  # open sequences by the room they have
    for i in rest:
        at, size = 0, int(lengths[i])
        while size:
            k = bisect_left(room, (size, -1))
            if k == len(room) and room and room[-1][0] >= grain:
                k, take = len(room) - 1, room[-1][0]  # cut to fill the emptiest
            elif k == len(room):
                room.append((window, n))
                n, k, take = n + 1, len(room) - 1, size
            else:
                take = size
            free, seq = room.pop(k)
            rows.append((i, at, take, seq, window - free))
            at, size = at + take, size - take
            if free > take:
                insort(room, (free - take, seq))
    return cut_to_powers(rows, {seq: window - free for free, seq in room if free > grain * depth}, n)


def cut_to_powers(rows: list[tuple], short: dict[int, int], n: int) -> list[tuple]:
    """Cut sequences far from full (given with their lengths) into sequences whose lengths are powers of two."""
    out = [r for r in rows if r[3] not in short]
    for seq, length in short.items():
        bounds, at, ids = [], 0, []
        for bit in reversed(range(length.bit_length())):
            if length >> bit & 1:
                bounds.append((at, at + (1 << bit)))
                at += 1 << bit
        for k in range(len(bounds)):
            ids.append(seq if k == 0 else n)
            n += k > 0
        for i, start, size, _, offset in (r for r in rows if r[3] == seq):
            for (lo, hi), new in zip(bounds, ids, strict=True):
                a, b = max(lo, offset), min(hi, offset + size)
                if a < b:
                    out.append((i, start + a - offset, b - a, new, a - lo))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per piece of the (doc_id, text) rows of ``docs``, with its ids."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << TASK_BITS, 0
        make = encoder(vocabulary, end_id)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block():
            nonlocal n
            ids = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            doc = pa.concat_arrays([h[2] for h in held])
            held.clear()
            first = np.cumsum(size) - size
            full, tail = size // window, size % window
            d = np.repeat(np.arange(len(size)), full)
            k = np.arange(len(d)) - np.repeat(np.cumsum(full) - full, full)
            parts = [np.stack([d, k * window, np.full(len(d), window), n + np.arange(len(d)), np.zeros(len(d), np.int64)], 1)]
            n += len(d)
            some = np.flatnonzero(tail)
            if len(some):
                rows = np.array(pack_lengths(tail[some], window), np.int64)
                used = int(rows[:, 3].max()) + 1
                rows[:, 3] += n
                rows[:, 0] = some[rows[:, 0]]
                rows[:, 1] += full[rows[:, 0]] * window
                n += used
                parts.append(rows)
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]  # by document, so the ids are those held, in order
            bounds = np.concatenate([[0], np.cumsum(rows[:, 2])])
            for a in range(0, len(rows), 2000):
                r = rows[a : a + 2000]
                lo, hi = bounds[a], bounds[a + len(r)]
                at = first[r[:, 0]] + r[:, 1]
                crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(at.tolist(), r[:, 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(pa.array(r[:, 0])),
                        pa.array(r[:, 1]),
                        pa.array(r[:, 2]),
                        pa.array(crc, pa.int64()),
                        pa.array(size[r[:, 0]]),
                        pa.array(base + r[:, 3]),
                        pa.array(r[:, 4]),
                        pa.ListArray.from_arrays(pa.array((bounds[a : a + len(r) + 1] - lo).astype(np.int32)), pa.array(ids[lo:hi].astype(np.int32))),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

        for batch in batches:
            done = 0
            for texts in steps(batch.column("text")):
                ids, offsets = make.encode(texts)
                held.append((ids.astype("<u4"), np.diff(offsets).astype(np.int64), batch.column("doc_id").slice(done, len(texts))))
                done += len(texts)
                if sum(len(h[0]) for h in held) >= block_ids:
                    yield from block()
        if held:
            yield from block()
        make.forget()  # the Python worker goes on to other stages' tasks
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op8_nnls_pack(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
