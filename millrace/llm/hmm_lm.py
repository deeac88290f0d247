"""Scoring by a hidden Markov language model, with a unigram score beside it.

*Blocks.* A task cuts its documents into blocks of a bounded number of words and numbers each block's distinct words.
Only those cross the network: a word's count over all training documents is one window over its blocks. *Classes.* The
TOP most frequent words are observations of their own; any other word is one of TAILS classes by its last letters, and
within a class words go by their smoothed counts, with room for unseen ones, so the model is a distribution over all
words. Frequent words, a bounded list, are broadcast to the blocks that hold them; only the others are shuffled.
*Training.* Start values come from one sweep over all training documents, dealt out to SLICES by a hash: each slice's
expected counts re-estimate the model that reads the next one. In the first half of the slices the newest counts alone
do so, in the second half the mean of that half's. Then PASSES passes follow, each over all training documents at once. All of
them gather expected counts in each partition, sum them by observation across partitions and re-estimate. *Scoring* is
the forward recursion, rescaled every few words: the exact likelihood of the whole text, its end included.

Defined results: null and empty texts are the end alone; rows with a null id count as training rows; repeated rows are
counted and scored as often as they occur; without training rows every word is unseen; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fitting, fold, table, written
from millrace.llm.encode import steps

#: Hidden states, words and word classes observed, longest word among the former.
STATES, TOP, TAILS, LONGEST = 8, 16_000, 256, 64
#: Slices of the sweep for start values, and the passes over all training documents after it.
SLICES, PASSES = 12, 2
#: Bounds of ``start_sample``: documents, words, words of a piece.
SAMPLE_DOCS, SAMPLE_WORDS, PIECE_WORDS = 1500, 1_000_000, 2000
#: Words between two rescalings, and words whose shares are worked out at a time.
RESCALE, STRIP = 4, 4096
#: Words in a block, and in a group that the recursions run on side by side.
BLOCK_WORDS, GROUP_WORDS = 1_500_000, 300_000
END = b""  # no word is empty
SMOOTH, SEED = 0.01, 11


def tail_class(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % TAILS


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # observations x states


def start_values(counts: np.ndarray) -> Hmm:
    rng = np.random.default_rng(SEED)
    emit = (counts[:, None] + 0.5) * rng.uniform(0.5, 1.5, (len(counts), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def estimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
    """Parameters from expected counts; every observation keeps a little of its overall share."""
    start, move = start + SMOOTH, move + SMOOTH
    emit = emit + 0.5 * len(prior) * SMOOTH * prior[:, None]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def groups(seqs: list[np.ndarray]):
    """Numbers of sequences that run side by side: of like length, longest first, bounded in words."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, len(seqs[order[at]]))
        to = min(len(order), at + max(1, GROUP_WORDS // longest))
        yield order[at:to]
        at = to


def laid_out(seqs: list[np.ndarray], pick: np.ndarray):
    """Sequences (longest first) place by place: all observations at place 0, then at place 1, ... and how many each."""
    lengths = np.array([len(seqs[i]) for i in pick])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than t
    grid = np.zeros((len(pick), lengths[0]), np.int64)
    there = np.arange(lengths[0]) < lengths[:, None]
    grid[there] = np.concatenate([seqs[i] for i in pick])
    return grid.T[there.T], live, np.concatenate([[0], np.cumsum(live)])


def forward(hmm: Hmm, seqs: list[np.ndarray], keep: bool = False):
    """log10 likelihood of each sequence; with ``keep`` yields what the backward pass needs instead.

    States are rows here and words columns. Values are rescaled at every RESCALE-th word and where a sequence ends.
    """
    score = np.zeros(len(seqs))
    emit, move = np.ascontiguousarray(hmm.emit.T), np.ascontiguousarray(hmm.move.T)
    for pick in groups(seqs):
        obs, live, at = laid_out(seqs, pick)
        b = np.take(emit, obs, axis=1)
        alpha, scale = (np.empty_like(b), np.empty(len(obs))) if keep else (None, None)
        due = (np.arange(len(live)) % RESCALE == RESCALE - 1) | np.append(live[1:] < live[:-1], True)
        now, total = None, np.zeros(len(pick))
        for t, n in enumerate(live):
            now = (move @ now[:, :n] if t else hmm.start[:, None]) * b[:, at[t] : at[t + 1]]
            if due[t]:
                c = now.sum(0)
                now /= c
                total[:n] += np.log10(c)
                if keep:
                    scale[at[t] : at[t + 1]] = c
            if keep:
                alpha[:, at[t] : at[t + 1]] = now
        score[pick] = total
        if keep:
            yield obs, live, at, b, alpha, scale, due
    if not keep:
        yield score


def expected_counts(hmm: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(hmm.emit)
    for obs, live, at, b, alpha, scale, due in forward(hmm, seqs, keep=True):
        beta = np.ones((STATES, live[-1]))
        for t in range(len(live) - 1, -1, -1):
            if beta.shape[1] < live[t]:  # more sequences end here
                beta = np.hstack([beta, np.ones((STATES, live[t] - beta.shape[1]))])
            ahead = b[:, at[t] : at[t + 1]]  # b turns into emission, scale and what follows, all in one
            ahead *= beta
            if due[t]:
                ahead /= scale[at[t] : at[t + 1]]
            beta = hmm.move @ ahead
        first, later = b[:, : live[0]], b[:, live[0] :]
        before = alpha[:, : at[-2]]
        if live[-1] < live[0]:  # without the words that end their sequences
            place = np.arange(at[-2]) - np.repeat(at[:-2], live[:-1])
            before = before[:, place < np.repeat(live[1:], live[:-1])]
        for a in range(0, later.shape[1], STRIP):
            x, y = before[:, a : a + STRIP], later[:, a : a + STRIP]
            move += x @ y.T
            y *= hmm.move.T @ x
        first *= hmm.start[:, None]
        start += first.sum(1)
        for k in range(STATES):  # b holds the states' shares now
            emit[:, k] += np.bincount(obs, b[k], len(emit))
    return start, move * hmm.move, emit


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks: (block, docs) rows hold documents as numbers of words, (block, words) rows the numbered words."""

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        size = 0

        def numbers() -> defaultdict[bytes, int]:
            """Numbers of a block's words, in the order in which they are met."""
            found = defaultdict(count().__next__)
            found[END]
            return found

        words = numbers()

        def block():
            nonlocal number, rows, size, words
            none = np.zeros(0, np.int32)
            total = np.bincount(np.concatenate([none, *[r[2] for r in rows if r[1]]]), minlength=len(words))
            # frequent words get small numbers, which compress well
            flat = np.bincount(np.concatenate([r[2] for r in rows]), minlength=len(words))
            order = np.argsort(-flat, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            names = np.array(list(words), object)[order]
            counts = total[order]
            n, key = len(rows), part + number
            for a in range(0, n, 500):
                some = rows[a : a + 500]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), key, np.int64)),
                        pa.array([r[0] for r in some], pa.int64()),
                        pa.array([r[1] for r in some], pa.bool_()),
                        pa.array([rank[r[2]].astype("<u4").tobytes() for r in some], pa.binary()),
                        pa.nulls(len(some), pa.int32()),
                        pa.nulls(len(some), pa.binary()),
                        pa.nulls(len(some), pa.int64()),
                    ],
                    names=["block", "doc_id", "train", "ids", "number", "word", "count"],
                )
            for a in range(0, len(names), 50_000):
                some = names[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), key, np.int64)),
                        pa.nulls(len(some), pa.int64()),
                        pa.nulls(len(some), pa.bool_()),
                        pa.nulls(len(some), pa.binary()),
                        pa.array(np.arange(a, a + len(some), dtype=np.int32)),
                        pa.array(list(some), pa.binary()),
                        pa.array(counts[a : a + len(some)]),
                    ],
                    names=["block", "doc_id", "train", "ids", "number", "word", "count"],
                )
            number += 1
            rows, size, words = [], 0, numbers()

        for batch in batches:
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            done = 0
            for texts in steps(batch.column("text")):
                for t in texts.to_pylist():
                    w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                    w.append(END)
                    rows.append((ids[done], train[done], np.fromiter(map(words.__getitem__, w), np.int32, len(w))))
                    done += 1
                    size += len(w)
                    if size >= BLOCK_WORDS:
                        yield from block()
        if rows:
            yield from block()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) % 5 != 1, F.lit(True)).alias("train"), "text")
    return docs.mapInArrow(run, "block long, doc_id long, train boolean, ids binary, number int, word binary, count long")


OBSERVED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, tail_score double, obs binary, length int"


def most_frequent(words: DataFrame) -> list:
    """The TOP rows of (word, c) by count. Counts are first tallied by steps of an eighth of an octave, so that no
    partition sends TOP candidates to the driver: only words from the step on in which the last of them lies do.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    tally = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    lowest, n = None, 0
    for lowest, count in tally:
        n += count
        if n >= TOP:
            break
    return words.filter(step >= lowest).orderBy(F.desc("c"), "word").limit(TOP).collect() if tally else []


def observed(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Documents as observations with their unigram scores; the observations' training counts; all training tokens."""
    rows = written(blocks_of(docs), "blocks")
    words = rows.filter("word is not null").select("block", "number", "word", "count")
    # each word once
    once = rows.filter("word is not null and count > 0").groupBy("word").agg(F.sum("count").alias("c"))
    once = written(once, "vocabulary")
    total = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    n_all, v_all, ends = total["n"], total["v"], total["ends"]
    top = most_frequent(once.filter((F.length("word") <= LONGEST) & (F.length("word") > 0)))
    number = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}
    number[END] = 0

    def classes(batches):
        for batch in batches:
            w = [bytes(x) for x in batch.column("word").to_pylist()]
            of = [number.get(x, -1) for x in w]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block"),
                    batch.column("number"),
                    batch.column("c"),
                    pa.array([TOP + 1 + tail_class(x) if o < 0 else o for x, o in zip(w, of, strict=True)], pa.int32()),
                ],
                names=["block", "number", "c", "obs"],
            )

    # the frequent words are at most TOP + 1; any other word stands once in a block, so no key is hot
    frequent = rows.sparkSession.createDataFrame([(END, int(ends)), *((bytes(r["word"]), int(r["c"])) for r in top)], "word binary, c long")
    kept = words.select("block", "number", "word").join(F.broadcast(frequent), "word").select("block", "number", "word", "c")
    others = words.join(F.broadcast(frequent.select("word")), "word", "left_anti")
    counted = others.withColumn("c", F.sum("count").over(Window.partitionBy("word"))).select("block", "number", "word", "c")
    counted = written(counted.unionByName(kept), "counts")

    known = once.withColumn("block", F.lit(0).cast("long")).withColumn("number", F.lit(0)).select("block", "number", "word", "c")
    by_class = known.mapInArrow(classes, "block long, number int, c long, obs int").groupBy("obs").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    counts, kinds = np.zeros(TOP + 1 + TAILS), np.zeros(TOP + 1 + TAILS)
    for r in by_class:
        counts[r["obs"]], kinds[r["obs"]] = r["c"], r["v"]
    room = np.log10(counts + 0.5 * (kinds + 1))  # of a tail class, shared by its words and an unseen one

    def score(key, block: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("number").to_numpy())
        c, obs = words.column("c").to_numpy()[order], words.column("obs").to_numpy()[order]
        base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
        tail = np.where(obs > TOP, np.log10(c + 0.5) - room[obs], 0.0)
        ids = [np.frombuffer(x, "<u4") for x in block.column("ids").to_pylist()]
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "train": block.column("train"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "n_known": pa.array([int((c[x] > 0).sum()) for x in ids], pa.int64()),
                "base_score": pa.array([float(base[x].sum()) for x in ids], pa.float64()),
                "tail_score": pa.array([float(tail[x].sum()) for x in ids], pa.float64()),
                "obs": pa.array([obs[x].astype("<u2").tobytes() for x in ids], pa.binary()),
                "length": pa.array([len(x) for x in ids], pa.int32()),
            }
        )

    left = rows.filter("word is null").select("block", "doc_id", "train", "ids").groupBy("block")
    right = counted.mapInArrow(classes, "block long, number int, c long, obs int").groupBy("block")
    out = left.cogroup(right).applyInArrow(score, OBSERVED)
    # slices are read one by one; in each, documents of like length stand together, so that the recursions run side by side
    slices = F.when(F.col("train"), F.pmod(F.xxhash64("doc_id", "obs"), F.lit(SLICES))).otherwise(-1).cast("int")
    return written(out.withColumn("slice", slices).sortWithinPartitions("slice", "length"), "observed", "slice"), counts, n_all


def start_sample(train: DataFrame) -> list[np.ndarray]:
    """Pieces of the training documents whose ids' hashes come first, for a look at the data: ``fit`` takes nothing
    from it, its start values come from all training documents. Hashes and lengths come to the driver before any
    observations do: about twice SAMPLE_DOCS narrow rows, whatever the input, and then no more than the sample.
    """
    n = train.count()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "obs")
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, n))
    near = F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    # equal rows count once
    found = train.filter(near).groupBy(key.alias("key")).agg(F.min("length").alias("length")).orderBy("key").limit(SAMPLE_DOCS).collect()
    keys = [found[k]["key"] for k in fitting([r["length"] for r in found], SAMPLE_WORDS)]
    wanted = train.sparkSession.createDataFrame([(k,) for k in keys], "key long")
    rows = train.filter(near).select(key.alias("key"), "obs").join(F.broadcast(wanted), "key").groupBy("key").agg(F.min("obs").alias("obs")).orderBy("key").collect()
    return [seq[a : a + PIECE_WORDS] for seq in (np.frombuffer(r["obs"], "<u2") for r in rows) for a in range(0, len(seq), PIECE_WORDS)]


def swept(train: DataFrame, counts: np.ndarray, prior: np.ndarray) -> Hmm:
    """Start values from one sweep over all training rows, slice by slice. A slice's expected counts stand for all
    ``counts``; those of the first half are each replaced by the next, those of the second half averaged.
    """
    hmm, mean, n = start_values(counts), None, 0
    for k in range(SLICES):
        got = gathered(train.filter(F.col("slice") == k), hmm)
        share = got[2].sum() / counts.sum()
        if share > 0:
            n = n + 1 if k >= SLICES // 2 else 0
            new = [x / share for x in got]
            mean = [a + (b - a) / n for a, b in zip(mean, new, strict=True)] if n > 1 else new
            hmm = estimated(*mean, prior)
    return hmm


def fit(rows: DataFrame, counts: np.ndarray) -> Hmm:
    if not counts.any():
        return start_values(counts)
    prior = (counts + 0.5) / (counts + 0.5).sum()
    train = rows.filter("slice >= 0")
    hmm = swept(train, counts, prior)
    for _ in range(PASSES):
        hmm = estimated(*gathered(train, hmm), prior)
    return hmm


def gathered(train: DataFrame, hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all training rows: each partition's, summed by observation across partitions.

    The driver gets one row an observation, whatever the input.
    """

    def run(batches):
        sums = None
        for batch in batches:
            seqs = [np.frombuffer(x, "<u2") for x in batch.column("obs").to_pylist()]
            got = expected_counts(hmm, seqs)
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
        if sums is None:
            return
        start, move, emit = sums
        seen = np.flatnonzero(emit.sum(1) > 0)
        number = np.concatenate([[-1], -2 - np.arange(STATES), seen])
        values = np.concatenate([start[None], move, emit[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *[pa.array(v) for v in values.T]], names=["number", *names])

    names = [f"s{k}" for k in range(STATES)]
    parts = train.select("obs").mapInArrow(run, "number int, " + ", ".join(f"{x} double" for x in names))
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(hmm.emit)
    for r in parts.groupBy("number").agg(*[F.sum(x).alias(x) for x in names]).collect():
        v = np.array([r[x] for x in names])
        if r["number"] >= 0:
            emit[r["number"]] = v
        elif r["number"] == -1:
            start = v
        else:
            move[-2 - r["number"]] = v
    return start, move, emit


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    rows, counts, n_all = observed(docs)
    hmm = fit(rows, counts)

    def run(batches):
        for batch in batches:
            seqs = [np.frombuffer(x, "<u2") for x in batch.column("obs").to_pylist()]
            score = next(forward(hmm, seqs)) if seqs else np.zeros(0)
            out = [batch.column(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(score + batch.column("tail_score").to_numpy())], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    found = rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")


def op6_hmm_lm(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
