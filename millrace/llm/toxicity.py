"""Toxicity by a convolutional text classifier, trained in numpy.

A lower-cased word, without the marks around it, is the sum of two rows of two hashed embedding tables. Filters of WIDTHS words slide over the whole
text, the largest response of each is kept, and a logistic unit reads those. Embeddings start at zero but for their
first component, which starts at the log odds of the class in the documents that hold a row's words, where at least
SUPPORT do: the largest responses then fall on telling words from the first step on, and a word that training has not
seen adds nothing. The classifier is fitted with Adam on a sample of the labelled documents, whole texts of any length:
of each class those whose md5 of the id comes first, at most SAMPLE of them, and of these all but texts that would take
more than half of what is left of the class's share of SAMPLE_CHARS; a fifth of the sample is set aside. Then Spark
scores all labelled documents that training has not read, whole texts of any length, and counts of those scores scale
them to the classes' natural shares and choose, per language, the threshold of ``rejected``. The model is 8 MB and goes
to tasks as it is.

Defined results: null and empty texts have no words and get the score of an empty text; a document with several labels
is toxic if one of them says so, null labels don't count; of rows with equal ids training reads the one whose text has
the smallest hash; without labels of both classes every score is 0; repeated rows get equal scores; other columns pass through ``with_scores`` untouched (it adds ``score``).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fitting, fold, table, tidy, written
from millrace.llm.encode import steps

TABLE_BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
SUPPORT = 3  # documents that a row of the tables needs to start elsewhere than at zero
SAMPLE, SAMPLE_CHARS = 1500, 30_000_000  # documents of each class that training reads, and characters of all of them
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.02, 7
FEW_LABELS = 200_000  # labelled ids up to which they are broadcast: a few MB
DECISION, LOWEST, HIGHEST, ENOUGH = 0.7, 0.6, 0.9, 40  # thresholds; rows that a language needs for its own
OPTIONS = np.linspace(LOWEST, HIGHEST, 31)
BINS = 100  # of a unit of the logit, for the calibration's sums
SCORED_BYTES = 1_000_000  # text scored at a time: the filters' responses take about 30 times that
GAP = max(WIDTHS) - 1
MARKS = ".,;:!?\"'()[]|*"


def split(text: str | None) -> list[bytes]:
    """Lower-cased words without the marks around them."""
    words = (w.strip(MARKS) for w in (text or "").lower().split())
    return [w.encode("utf-8", "surrogatepass") for w in words if w]


def rows_of(word: bytes) -> tuple[int, int]:
    h = zlib.crc32(word)
    return h & ((1 << TABLE_BITS) - 1), zlib.crc32(word, 0x9E3779B9) >> (32 - TABLE_BITS)


@dataclass
class Model:
    first: np.ndarray
    second: np.ndarray
    filters: list[np.ndarray]  # width x dim x filters
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0  # of the calibrated logit
    shift: float = 0.0
    constant: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)
    fallback: float = DECISION


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts with GAP blanks (number 0) behind each, where texts begin, and the distinct words."""
    words: dict[bytes, int] = {b"": 0}
    out, starts = [], []
    n = 0
    for t in texts:
        own = split(t) or [b""]
        ids = [words.setdefault(w, len(words)) for w in own]
        starts.append(n)
        n += len(ids) + GAP
        out.append(ids + [0] * GAP)
    return np.fromiter((i for ids in out for i in ids), np.int64, n), np.array(starts, np.int64), list(words)


def embedded(model: Model, words: list[bytes]) -> np.ndarray:
    at = np.array([rows_of(w) for w in words], np.int64).reshape(-1, 2)
    e = model.first[at[:, 0]] + model.second[at[:, 1]]
    e[0] = 0
    return e


def responses(model: Model, e: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The filters' responses at every place; windows begin at words only."""
    n = len(ids) - GAP
    parts = []
    for f in model.filters:
        # einsum, unlike a matrix product, rounds a word's row alike wherever it stands: equal texts get equal scores
        total = np.einsum("wd,df->wf", e, f[0])[ids[:n]]
        for j in range(1, len(f)):
            total = total + np.einsum("wd,df->wf", e, f[j])[ids[j : n + j]]
        parts.append(total)
    out = np.concatenate(parts, 1) + model.bias
    gaps = np.concatenate([starts[1:], [len(ids)]]) - 1
    for g in range(GAP):
        at = gaps - g
        out[at[at < n]] = -np.inf
    return out


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    ids, starts, words = coded(texts)
    best = np.maximum.reduceat(responses(model, embedded(model, words), ids, starts), starts, axis=0)
    return (np.maximum(best, 0) * model.weight).sum(1) + model.offset


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_odds(texts: list[str], labels: np.ndarray) -> list[np.ndarray]:
    """For each table, the rows' shrunk log odds by the number of documents of either class that hold their words."""
    seen = np.zeros((2, 2, 1 << TABLE_BITS))
    for t, y in zip(texts, labels, strict=True):
        at = np.array([rows_of(w) for w in set(split(t))], np.int64).reshape(-1, 2)
        for k in range(2):
            seen[k, int(y), np.unique(at[:, k])] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    out = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
    return [np.where(c.sum(0) >= SUPPORT, o, 0).astype(np.float32) / 4 for o, c in zip(out, seen, strict=True)]


def train(texts: list[str], labels: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    wide = FILTERS * len(WIDTHS)
    size = 1 << TABLE_BITS
    model = Model(
        np.zeros((size, DIM), np.float32),
        np.zeros((size, DIM), np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(wide, 0.05, np.float32),
        rng.normal(0, 0.5, wide).astype(np.float32),
        0.0,
    )
    model.first[:, 0], model.second[:, 0] = log_odds(texts, labels)
    dense = [*model.filters, model.bias, model.weight]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in dense]
    grown = [np.full(size, 1e-8, np.float32), np.full(size, 1e-8, np.float32)]  # squared gradients of embedding rows
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            y = labels[rows]
            ids, starts, words = coded([texts[i] for i in rows])
            e = embedded(model, words)
            r = responses(model, e, ids, starts)
            ends = np.append(starts[1:], len(r) + GAP)
            at = np.stack([s + r[s : t - GAP].argmax(0) for s, t in zip(starts, ends, strict=True)])
            top = np.take_along_axis(r, at, 0)
            best = np.maximum(top, 0)
            d = ((sigmoid(best @ model.weight + model.offset) - y) / len(rows)).astype(np.float32)
            back = d[:, None] * model.weight * (top > 0)
            grads = [np.zeros_like(x) for x in dense]
            grads[-1], grads[-2] = best.T @ d, back.sum(0)
            de = np.zeros_like(e)
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, a = back[:, cols], at[:, cols]
                for j in range(w):
                    seen = ids[a + j]  # documents x filters
                    grads[k][j] = np.einsum("nfd,nf->df", e[seen], g)
                    np.add.at(de, seen, g[:, :, None] * model.filters[k][j].T[None])
            de[0] = 0
            step += 1
            for x, g, (m, v) in zip(dense, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.offset -= RATE * float(d.sum())
            hit = np.flatnonzero(np.abs(de).sum(1))
            places = np.array([rows_of(words[i]) for i in hit], np.int64).reshape(-1, 2)
            for side, rows_, sums in ((model.first, places[:, 0], grown[0]), (model.second, places[:, 1], grown[1])):
                np.add.at(sums, rows_, (de[hit] ** 2).mean(1))
                np.add.at(side, rows_, -RATE * de[hit] / np.sqrt(sums[rows_])[:, None])
    return model


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Fit slope and shift of the logit ``z`` by weighted logistic regression."""
    goal = np.where(labels == 1, 0.995, 0.005)
    ab = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)

    def loss(ab):
        m = x @ ab
        return (weights * (np.logaddexp(0, m) - goal * m)).sum() + 0.5 * ((ab - [1, 0]) ** 2).sum()

    for _ in range(50):  # Newton with halved steps, and a weak pull to the logit as it is
        p = sigmoid(x @ ab)
        grad = x.T @ (weights * (p - goal)) + (ab - [1, 0])
        move = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        while np.abs(move).max() > 1e-9 and loss(ab - move) > loss(ab):
            move = move / 2
        ab = ab - move
    model.slope, model.shift = max(0.1, float(ab[0])), float(ab[1])


def threshold(reached: np.ndarray, natural: np.ndarray) -> float:
    """The option of best F1. ``reached``: rows of class 0 and 1 by how many options their score reaches (2 x 32)."""
    over = natural[:, None] * reached[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # weight of the rows at or over each option
    f1 = 2 * over[1] / np.maximum(1e-9, over.sum(0) + natural[1] * reached[1].sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(OPTIONS[best[np.abs(OPTIONS[best] - DECISION).argmin()]])


def set_thresholds(model: Model, scored: DataFrame, natural: np.ndarray) -> None:
    """Thresholds by language and for the rest, from all rows of ``scored`` (lang, toxic, z)."""
    cuts = (np.log(OPTIONS / (1 - OPTIONS)) - model.shift) / model.slope
    reached = sum(((F.col("z") >= float(c)).cast("int") for c in cuts), F.lit(0))
    counts = scored.groupBy("lang", "toxic", reached.alias("reached")).count()
    total = np.zeros((2, len(OPTIONS) + 1))
    for r in counts.groupBy("toxic", "reached").agg(F.sum("count").alias("n")).collect():
        total[r["toxic"], r["reached"]] = r["n"]
    model.fallback = threshold(total, natural)
    # only languages with enough rows and both classes come to the driver, with 64 counts each at most
    rows = counts.filter("lang is not null").groupBy("lang").agg(
        F.collect_list(F.struct("toxic", "reached", "count")).alias("counts"), F.sum("count").alias("n"), F.countDistinct("toxic").alias("classes")
    )
    for r in rows.filter((F.col("n") >= ENOUGH) & (F.col("classes") == 2)).collect():
        own = np.zeros_like(total)
        for toxic, at, n in r["counts"]:
            own[toxic, at] = n
        model.thresholds[r["lang"]] = threshold(own, natural)


def with_logits(docs: DataFrame, model: Model) -> DataFrame:
    @F.arrow_udf(T.DoubleType())
    def logit(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in steps(texts, SCORED_BYTES):
            out.append(np.clip(logits(model, part.to_pylist()), -12, 12))
        tidy()
        return pa.array(np.concatenate(out).astype(np.float64))

    return docs.withColumn("z", logit(F.col("text")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the sample, and calibrate on all other labelled documents, whose id's crc32 is not 1 modulo 3."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = usable.filter("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(SAMPLE))
    picked = written(picked, "picked")  # at most 2 * SAMPLE ids: a bounded broadcast
    one = F.min_by(F.struct(F.length("text").alias("chars"), "_hash"), "_hash")
    sized = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("one"))
    # narrow rows come to the driver first, so that no more than SAMPLE_CHARS follow
    told = sized.select("doc_id", "toxic", "one.*").orderBy(*order).collect()
    chosen = []
    for toxic in (0, 1):
        own = [r for r in told if r["toxic"] == toxic]
        chosen += [(own[k]["doc_id"], own[k]["_hash"]) for k in fitting([r["chars"] for r in own], SAMPLE_CHARS // 2)]
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([sized.schema["doc_id"], T.StructField("_hash", T.LongType())]))
    found = texts.join(F.broadcast(wanted), ["doc_id", "_hash"]).join(F.broadcast(picked), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(*[np.zeros((1, 1), np.float32)] * 2, [], np.zeros(0), np.zeros(0), 0.0, constant=True)
    aside = np.array([zlib.crc32(b"aside" + str(r[0]).encode()) % 5 == 0 for r in rows])
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(rows), bool)
    model = train([r[1] for r, a in zip(rows, aside, strict=True) if not a], y[~aside])
    # texts stay where they are: each is scored in the scan, and only ids and logits are joined with the labels
    mine = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 3 != 1))
    if sum(shares.values()) <= FEW_LABELS:  # then no others are scored
        mine = mine.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    scored = with_logits(mine.select("doc_id", "lang", "text"), model).select("doc_id", "lang", F.xxhash64("text").alias("text"), "z").distinct()
    scored = written(scored.join(known, "doc_id"), "scored")
    read = scored.sparkSession.createDataFrame([(i,) for i in sorted({r[0] for r, a in zip(rows, aside, strict=True) if not a})], scored.select("doc_id").schema)
    unread = scored.join(F.broadcast(read), "doc_id", "left_anti")
    check = unread if unread.select("toxic").distinct().count() == 2 else scored
    bins = check.groupBy("toxic", F.round(F.col("z") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg("z").alias("z")).collect()
    label, n, z = (np.array([r[c] for r in bins], np.float64) for c in ("toxic", "n", "z"))
    sums = np.array([n[label == k].sum() for k in range(2)])
    natural = np.array([shares[k] for k in range(2)]) / sums
    natural *= sums.sum() / (natural * sums).sum()
    calibrate(model, z, label, n * natural[label.astype(int)])
    set_thresholds(model, check, natural)
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        if model.constant:
            return pa.array(np.zeros(len(texts)))
        out = [np.zeros(0)]
        for part in steps(texts, SCORED_BYTES):
            out.append(sigmoid(model.slope * np.clip(logits(model, part.to_pylist()), -12, 12) + model.shift))
        tidy()
        return pa.array(np.concatenate(out).astype(np.float64))

    return docs.withColumn("score", scored(F.col(text)))


def threshold_of(model: Model, lang: str):
    """The threshold of a row's language."""
    out = F.lit(model.fallback)
    for name, t in model.thresholds.items():
        out = F.when(F.col(lang) == name, F.lit(t)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, labels: DataFrame, lang: str = "lang") -> DataFrame:
    """The documents whose score is under their language's threshold, with the columns they came with."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text", lang)  # columns of any name come through
    return with_scores(rows, model).filter(F.col("score") < threshold_of(model, lang)).select("_doc.*")


def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    rows = with_scores(docs.select("doc_id", "lang", "text"), model)
    return rows.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
        (F.col("score") >= threshold_of(model, "lang")).alias("rejected"),
    )
