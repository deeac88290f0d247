"""Language of texts by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, each of which also sees the bytes behind it that its last
filters need, so no sequence of bytes is lost between two of them. A byte is a vector of DIM numbers; filters of WIDTHS
bytes slide over the window, the largest response of each is kept, and a softmax over the languages reads those. A text's
logits are the mean of its windows', weighted by the bytes they hold: all windows of the whole text count. Windows of
many texts run side by side, BLOCK_WINDOWS at a time. A filter's response is a sum of rows of small tables, one for each
place in the filter, so scoring gathers rows and never multiplies matrices over positions.

The network is fitted with Adam on a bounded sample of the labelled texts: of each of the LANGS most frequent languages
at most SAMPLE_DOCS texts, those whose md5 of id and text's hash comes first, and of each text at most SAMPLE_WINDOWS windows at
places that lie evenly over it.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be
learnt, and where one language alone was labelled every text with a letter is of that one, with score 1; ties of two
languages go to the first by name; rows without an id are not learnt from; of rows with one id and one text training
reads one; equal texts get equal results; other columns pass through ``with_language`` untouched (it adds ``lang_pred``
and ``score``); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fold, table, tidy, written
from millrace.llm.encode import steps

WINDOW, WIDTHS, DIM, FILTERS = 256, (2, 3, 4), 8, 16
AHEAD = max(WIDTHS) - 1  # bytes behind a window that its filters see
LANGS, SAMPLE_DOCS, SAMPLE_WINDOWS = 256, 400, 8
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 11
SCORED_BYTES, BLOCK_WINDOWS = 1_000_000, 16  # text laid out at a time, and windows whose responses stand in memory at a time
UNKNOWN = "und"
LETTER = r"\p{L}"


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray  # bytes x DIM; byte 0, which fills windows up, is zero
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # filters x languages
    offset: np.ndarray


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts with the AHEAD bytes behind each, zeros where a text has ended; the texts' first windows;
    and how many of a text's bytes each window holds.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(1, -(-sizes // WINDOW))
    starts = np.cumsum(windows) - windows
    flat = b"".join(x for t, n in zip(texts, (windows * WINDOW - sizes).tolist(), strict=True) for x in (t, bytes(n)))
    own = np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)
    ahead = np.concatenate([own[1:, :AHEAD], np.zeros((1, AHEAD), np.uint8)])
    ahead[starts + windows - 1] = 0
    place = np.arange(windows.sum()) - np.repeat(starts, windows)
    held = np.clip(np.repeat(sizes, windows) - place * WINDOW, 0, WINDOW)
    return np.concatenate([own, ahead], 1), starts, held.astype(np.float32)


def features(model: Model, windows: np.ndarray) -> np.ndarray:
    """The largest response of every filter in every window, BLOCK_WINDOWS at a time.

    Filters are narrow first, so those that have a j-th place are the last ones, and one table serves them all.
    """
    n, wide = len(windows), FILTERS * len(WIDTHS)
    tables = [np.concatenate([model.embedding @ f[j] for f in model.filters if len(f) > j], 1) for j in range(max(WIDTHS))]
    out = np.empty((n, wide), np.float32)
    for a in range(0, n, BLOCK_WINDOWS):
        some = windows[a : a + BLOCK_WINDOWS]
        own = np.append(some.ravel(), np.zeros(AHEAD, np.uint8)).astype(np.intp)
        total = tables[0].take(own[: some.size], axis=0, mode="clip")  # bytes never are beyond a table
        for j in range(1, len(tables)):
            total[:, wide - tables[j].shape[1] :] += tables[j].take(own[j : some.size + j], axis=0, mode="clip")
        out[a : a + len(some)] = total.reshape(len(some), -1, wide)[:, :WINDOW].max(1)
    return np.maximum(out + model.bias, 0)


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """One row a text: the mean of its windows' logits, by the bytes they hold."""
    windows, starts, held = laid_out(texts)
    # not a product of matrices, which may round equal rows unlike
    z = (features(model, windows)[:, :, None] * model.weight).sum(1) + model.offset
    return np.add.reduceat(z * held[:, None], starts, axis=0) / np.maximum(np.add.reduceat(held, starts), 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: list[bytes], labels: np.ndarray, langs: list[str]) -> Model:
    """Fit on windows of WINDOW + AHEAD bytes at most; every language weighs the same."""
    rng = np.random.default_rng(SEED)
    wide = FILTERS * len(WIDTHS)
    model = Model(
        langs,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(wide, np.float32),
        rng.normal(0, 0.3, (wide, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    model.embedding[0] = 0
    x = np.zeros((len(windows), WINDOW + AHEAD), np.uint8)
    for row, w in zip(x, windows, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    share = 1 / np.bincount(labels, minlength=len(langs))[labels]
    share = (share / share.mean()).astype(np.float32)
    dense = [model.embedding, *model.filters, model.bias, model.weight, model.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            own = x[rows]
            r = np.empty((len(rows), WINDOW, wide), np.float32)
            for k, f in enumerate(model.filters):
                r[:, :, k * FILTERS : (k + 1) * FILTERS] = sum((model.embedding @ f[j])[own[:, j : WINDOW + j]] for j in range(len(f)))
            at = r.argmax(1)  # windows x filters
            top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + model.bias
            best = np.maximum(top, 0)
            d = softmax(best @ model.weight + model.offset)
            d[np.arange(len(rows)), labels[rows]] -= 1
            d *= share[rows, None] / len(rows)
            back = (d @ model.weight.T) * (top > 0)
            grads = [np.zeros_like(p) for p in dense]
            grads[-1], grads[-2], grads[-3] = d.sum(0), best.T @ d, back.sum(0)
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, a = back[:, cols], at[:, cols]
                for j in range(w):
                    seen = np.take_along_axis(own, a + j, 1)
                    grads[1 + k][j] = np.einsum("nfd,nf->df", model.embedding[seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * model.filters[k][j].T[None])
            grads[0][0] = 0
            step += 1
            for p, g, (m, v) in zip(dense, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def sample_windows(texts: pa.Array) -> pa.Array:
    """At most SAMPLE_WINDOWS windows of each text, evenly spread, with the bytes that their filters see."""
    out = []
    for t in texts.to_pylist():
        raw = t.encode("utf-8", "surrogatepass")
        n = max(1, -(-len(raw) // WINDOW))
        some = sorted({k * n // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)})
        out.append([raw[k * WINDOW : (k + 1) * WINDOW + AHEAD] for k in some])
    return pa.array(out, pa.list_(pa.binary()))


def fit(docs: DataFrame) -> Model | list[str]:
    """The network, fitted on the labelled documents whose id's crc32 is not 1 modulo 3; with less than two languages
    just those.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) % 3 != 1) & F.col("text").rlike(LETTER))
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("_hash"))
    ids = written(known.select("lang", "doc_id", "_hash"), "labelled")
    # the driver gets LANGS names at most, tasks get their samples: bounded
    langs = sorted(r["lang"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect())
    if len(langs) < 2:
        return langs
    # ranks need few rows of each language: those whose hash is among the first, some times SAMPLE_DOCS
    ids = ids.filter(F.col("lang").isin(langs)).distinct().withColumn("_key", F.md5(F.concat_ws(" ", "doc_id", "_hash").cast("binary")))
    ids = written(ids, "distinct")
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.count("*"))
    shares = ids.groupBy("lang").agg(share.alias("_share"))  # LANGS rows at most
    first = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32 < F.col("_share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id", "_hash"))
    near = ids.join(F.broadcast(shares), "lang").filter((F.col("_share") == 1) | first)
    picked = written(near.withColumn("_r", rank).filter(F.col("_r") <= SAMPLE_DOCS).select("lang", "doc_id", "_hash"), "picked")
    texts = known.join(F.broadcast(picked), ["lang", "doc_id", "_hash"]).dropDuplicates(["lang", "doc_id", "_hash"])
    rows = texts.select("lang", "doc_id", "_hash", sample_windows("text").alias("windows")).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["_hash"]))
    windows = [(bytes(w), langs.index(r["lang"])) for r in rows for w in r["windows"]]
    return train([w for w, _ in windows], np.array([y for _, y in windows]), langs)


def with_language(docs: DataFrame, model: Model | list[str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the softmax of its language."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in steps(texts, SCORED_BYTES):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.to_pylist()]
            if raw:
                p = softmax(logits(model, raw).astype(np.float64))
                best = p.argmax(1)
                names += [model.langs[k] for k in best]
                scores += p[np.arange(len(best)), best].tolist()
        tidy()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))  # columns of any name come through
    if isinstance(model, Model):
        rows = rows.withColumn("_told", predicted("_text"))
        name, score = F.col("_told.lang_pred"), F.col("_told.score")
    else:
        name, score = F.lit(model[0] if model else UNKNOWN), F.lit(1.0 if model else 0.0)
    legible = F.coalesce(F.col("_text").rlike(LETTER), F.lit(False))
    return rows.select("_doc.*", F.when(legible, name).otherwise(UNKNOWN).alias("lang_pred"), F.when(legible, score).otherwise(0.0).alias("score"))


def op12_byte_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = with_language(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
