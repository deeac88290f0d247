"""Model code against enumeration, and stored tokens against their files' metadata."""

import hashlib
import itertools
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from millrace.llm import common, hmm_lm, nnls_pack, token_orc, toxicity

SMALL = "/root/testdata/sf0.001"


def small_model(states, words, rng):
    row = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm_lm.Hmm(row(1, states)[0], row(states, states), row(states, words).T)


def test_scores_and_counts_are_those_of_all_state_paths(monkeypatch):
    monkeypatch.setattr(hmm_lm, "STATES", 3)
    rng = np.random.default_rng(1)
    hmm = small_model(3, 5, rng)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 6)]
    want, start, move, emit = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in seqs:
        total, s0, m0, e0 = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for path in itertools.product(range(3), repeat=len(seq)):
            p = hmm.start[path[0]] * np.prod([hmm.emit[w, s] for w, s in zip(seq, path, strict=True)]) * np.prod([hmm.move[a, b] for a, b in itertools.pairwise(path)])
            total += p
            s0[path[0]] += p
            for a, b in itertools.pairwise(path):
                m0[a, b] += p
            for w, s in zip(seq, path, strict=True):
                e0[w, s] += p
        want.append(np.log10(total))
        start, move, emit = start + s0 / total, move + m0 / total, emit + e0 / total
    assert next(hmm_lm.forward(hmm, seqs)) == pytest.approx(want, abs=1e-12)
    got = hmm_lm.expected_counts(hmm, seqs)
    for mine, theirs in zip(got, (start, move, emit), strict=True):
        assert mine == pytest.approx(theirs, abs=1e-12)


def test_counts_of_partitions_are_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    hmm = small_model(hmm_lm.STATES, hmm_lm.TOP + 1 + hmm_lm.TAILS, rng)
    seqs = [rng.integers(0, 40, n).astype("<u2") for n in rng.integers(1, 60, 50)]
    rows = spark.createDataFrame([(s.tobytes(),) for s in seqs], "obs binary").repartition(7)
    for mine, theirs in zip(hmm_lm.gathered(rows, hmm), hmm_lm.expected_counts(hmm, seqs), strict=True):
        assert mine == pytest.approx(theirs, abs=1e-9)


def test_start_sample_is_bounded_and_reads_long_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "SAMPLE_DOCS", 30)
    monkeypatch.setattr(hmm_lm, "PIECE_WORDS", 7)
    obs = {i: np.full(3 + i % 50, i, "<u2") for i in range(400)}
    rows = spark.createDataFrame([(i, True, s.tobytes(), len(s)) for i, s in obs.items()], "doc_id long, train boolean, obs binary, length int")
    pieces = hmm_lm.start_sample(rows)
    taken = {int(p[0]) for p in pieces}
    assert 15 <= len(taken) <= 30 and max(map(len, pieces)) == 7
    assert sum(map(len, pieces)) == sum(len(obs[i]) for i in taken)
    assert {int(p[0]) for p in hmm_lm.start_sample(rows.unionByName(rows).repartition(9))} <= set(obs)
    assert hmm_lm.start_sample(rows.limit(0)) == []


def test_long_texts_are_those_of_plain_recursions():
    rng = np.random.default_rng(7)
    hmm = small_model(hmm_lm.STATES, 400, rng)
    hmm.emit[:] = hmm.emit**12 + 1e-18  # far apart, and far below one
    seqs = [rng.integers(0, 400, n) for n in (900, 1, 37, 900, 5)]
    move, emit, want = np.zeros_like(hmm.move), np.zeros_like(hmm.emit), []
    for seq in seqs:
        alpha, total = [], 0.0
        for t, w in enumerate(seq):
            now = (alpha[-1] @ hmm.move if t else hmm.start) * hmm.emit[w]
            total += np.log10(now.sum())
            alpha.append(now / now.sum())
        beta = np.ones(hmm_lm.STATES)
        for t in range(len(seq) - 1, -1, -1):
            emit[seq[t]] += alpha[t] * beta / (alpha[t] @ beta)
            if t:
                pair = alpha[t - 1][:, None] * hmm.move * (hmm.emit[seq[t]] * beta)
                move += pair / pair.sum()
                beta = hmm.move @ (hmm.emit[seq[t]] * beta)
                beta /= beta.sum()
        want.append(total)
    assert next(hmm_lm.forward(hmm, seqs)) == pytest.approx(want, rel=1e-12)
    got = hmm_lm.expected_counts(hmm, seqs)
    assert got[1] == pytest.approx(move, abs=1e-8) and got[2] == pytest.approx(emit, abs=1e-8)


def test_start_values_come_from_every_training_word(spark, monkeypatch):
    read, whole = [], hmm_lm.gathered

    def gathered(train, hmm):
        got = whole(train, hmm)
        read.append(got[2].sum(1))
        return got

    monkeypatch.setattr(hmm_lm, "gathered", gathered)
    monkeypatch.setattr(hmm_lm, "PASSES", 0)  # start values alone
    monkeypatch.setattr(hmm_lm, "SAMPLE_DOCS", 5)
    docs = [(i, f"a{i % 7} b{i % 11} c{i}" * (1 + i % 3)) for i in range(60)] + [(None, "x y z"), (100, None), (101, ""), (102, "w " * 5000), (3, "a b"), (3, "a b")]
    rows, counts, n = hmm_lm.observed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    hmm_lm.fit(rows, counts)
    assert sum(read).sum() == pytest.approx(n) and sum(read) == pytest.approx(counts)
    assert len(read) > 1 and max(r.sum() for r in read if r.sum() < 5000) < n / 3  # in slices


def test_no_training_rows_leave_the_unigram_start(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = hmm_lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (one.held_out, one.n_tokens, one.n_known, one.train_tokens) == (True, 3, 0, 0) and np.isfinite(one.score)
    assert hmm_lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_texts_score_better_than_the_unigram_base(spark):
    rows = hmm_lm.op6_hmm_lm(spark, SMALL.replace("0.001", "0.01")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows.s / rows.n > rows.b / rows.n + 0.1


def test_least_squares_are_those_of_the_best_active_set():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 3, (4, 6)).astype(float), rng.integers(0, 9, 4).astype(float)
        best = b @ b
        for k in range(1, 5):
            for pick in itertools.combinations(range(6), k):
                x = np.linalg.lstsq(a[:, pick], b, rcond=None)[0]
                if x.min() >= 0:
                    best = min(best, ((a[:, pick] @ x - b) ** 2).sum())
        x = nnls_pack.nnls(a, b)
        assert x.min() >= 0 and ((a @ x - b) ** 2).sum() == pytest.approx(best, abs=1e-6)


def test_combinations_are_all_of_them():
    found = nnls_pack.combinations(8, 3).T
    want = {tuple(np.bincount(c, minlength=9)[1:]) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 9), k) if sum(c) == 8}
    assert {tuple(f.astype(int)) for f in found} | {tuple(np.bincount([8], minlength=9)[1:])} == want


def test_packing_pads_little(spark):
    rows = nnls_pack.op8_nnls_pack(spark, SMALL.replace("0.001", "0.01")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = lambda n: 0 if n & (n - 1) == 0 else nnls_pack.WINDOW - n
    assert sum(padded(r.n) for r in rows) < 0.01 * sum(r.n for r in rows)
    assert all(r.n <= nnls_pack.WINDOW for r in rows)


def test_stripes_hold_ranges_and_reads_by_id_skip_them(spark, tmp_path, monkeypatch):
    """Integer columns with direct-v2 run lengths, a Bloom filter and a row index on ids; stripes in order of ids; a
    read of two ids finds them, filters in the scan and skips the rows that metadata rules out."""
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 64 << 10)
    docs = spark.range(4000).selectExpr("id * 3 AS doc_id", "repeat(concat('word', id, ' '), 40) AS text")
    path = f"file://{tmp_path}/tokens.orc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks stay apart
    try:
        token_orc.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = []
    for f in sorted(Path(urlparse(path).path).glob("*.orc")):
        file = orc.ORCFile(f)
        for k in range(file.nstripes):
            ids = file.read_stripe(k, columns=["doc_id"]).column(0).to_pylist()
            assert ids == sorted(ids)
            spans.append((ids[0], ids[-1]))
    assert len(spans) >= 8
    assert all(a[1] < b[0] for a, b in itertools.pairwise(sorted(spans)))  # no two stripes share an id
    whole = token_orc.read_tokens(spark, path)
    some = token_orc.read_tokens(spark, path, [9, 6000, 6001])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString().replace("\n", " ")
    assert sorted(r.doc_id for r in some.collect()) == [9, 6000]
    read = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert 0 < read < whole.count() / 2
    raw = b"".join(f.read_bytes() for f in Path(urlparse(path).path).glob("*.orc"))
    assert len(raw) < 4 * whole.agg(F.sum("n_tokens")).first()[0]


def test_starts_of_equal_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (None, "x"), (1, None), (2, "b c"), (1, "")], "doc_id long, text string")
    path = f"file://{tmp_path}/t.orc"
    token_orc.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    rows = token_orc.starts(token_orc.read_tokens(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 2]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_threshold_is_that_of_the_best_f1():
    rng = np.random.default_rng(5)
    for _ in range(40):
        y = rng.integers(0, 2, 60)
        score = np.clip(0.75 + 0.1 * (y - 0.5) + rng.normal(0, 0.12, 60), 0, 1)
        reached = np.zeros((2, len(toxicity.OPTIONS) + 1))
        for s, k in zip(score, y, strict=True):
            reached[k, (s >= toxicity.OPTIONS).sum()] += 1

        def f1(t):
            hit, said = ((score >= t) & (y == 1)).sum(), (score >= t).sum()
            return 2 * hit / (said + y.sum()) if said + y.sum() else 0.0

        got = toxicity.threshold(reached, np.ones(2))
        assert f1(got) == pytest.approx(max(map(f1, toxicity.OPTIONS)), abs=1e-9)


def test_a_giant_leaves_room_for_those_behind_it():
    small = [2500] * 1500
    assert common.fitting([16_000_000, *small], 15_000_000) == list(range(1, 1501))
    assert common.fitting([*small[:10], 16_000_000, *small[10:]], 15_000_000) == [k for k in range(1501) if k != 10]
    taken = common.fitting([7_000_000, 3_900_000, 2_000_000, *small], 15_000_000)
    assert taken[:2] == [0, 1] and len(taken) > 700 and sum([7_000_000, 3_900_000, 2_000_000, *small][k] for k in taken) <= 15_000_000
    assert common.fitting([90, 50, 70], 60) == [1] and common.fitting([], 60) == []


@pytest.mark.parametrize("place", [0, 10])
def test_a_giant_labelled_text_does_not_shut_out_others(spark, monkeypatch, place):
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400_000)
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)) or real(texts, y))
    ids = sorted((i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    giant = [i for i in ids if i % 2][place]
    rows = [(i, "word " * 100_000 if i == giant else f"plain words {i}" + " vile" * (i % 2), "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int"))
    assert seen[0] > 0.7 * (len(ids) - 1)
