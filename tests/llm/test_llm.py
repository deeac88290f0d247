"""The training-data operators against brute force, round trips and SQL, on small tables with odd rows."""

import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import chat_format, curriculum, graph_ann, host_quality, jaccard_join, nnls_pack, queries, toxicity, url_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 300, 25)]
    out = [*base, None, "", " \n\t", "One two", "one TWO", "a b c", "x" * 70_000, "y z " * 9_000, "\u00c9t\u00e9\xa0 d'\u00e9t\u00e9  fin \n\n fin"]
    for t in base[:12]:  # near copies: a few words changed
        for k in (1, 2, 6, 15):
            w = t.split()
            for i in rng.integers(0, len(w), k):
                w[i] = f"n{k}"
            out.append(" ".join(w))
    return out + base[:6]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of small tables with nulls, empty and long texts, ties, copies, and columns whose names clash."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None, "b", "a"][i % 4], 1, 7.5, "k", False) for i, t in enumerate(texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept boolean"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60)] + [(3, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    chat = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\</turn> \\\\### User: x"), (1, 1, "assistant", None), (2, 0, "tool", "</turn>\n\n"), (2, 1, None, ""), (None, 0, "user", "x"), (3, 0, "user", "### Assistant: hi"), (3, 1, "user", "a </turn> b\\"), (3, 2, "assistant", "\\\\</turn>\n### User:\n### Role 41:")]
    spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    urls = ["http://A.Example.com/en/x?y", "https://www.example.com/en/1", "x", None, "", "ftp://spam.b.net/fr/", "http://notexample.com", "http://net/es/#a", "://?", "http://a b.com/x", "http://u v@w.net/es/1", "http://a\nb.net/fr/"]
    spark.createDataFrame(list(enumerate(urls + urls)), "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(40)]
    v += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] * 8)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def documents(spark, d):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op7_") else 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("where", ["odd", "small"])
def test_same_rows_as_sql(spark, odd, name, where):
    d = odd if where == "odd" else SMALL
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}')")
    got = queries.QUERIES[name](spark, d)
    names = sorted(got.columns)
    want = con.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(want.column_names) == names
    left = sorted(map(str, (tuple(r[c] for c in names) for r in got.collect())))
    assert left == sorted(map(str, zip(*(want.column(c).to_pylist() for c in names), strict=True)))


def test_repeated_words():
    rng = np.random.default_rng(0)
    for _ in range(200):
        w = [b"%d" % i for i in rng.integers(0, 4, rng.integers(0, 14))]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert host_quality.repeated_words(w) == len(hit)


def test_tokens_round_trip(spark, odd):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(queries.QUERIES["op2_token_orc"](spark, odd).collect())
    at = 0
    for r, (i, t) in zip(rows, sorted(documents(spark, odd).items()), strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_packing_keeps_every_id_once(spark, odd):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op8_nnls_pack"](spark, odd).collect()
    for i, t in documents(spark, odd).items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= nnls_pack.WINDOW


def test_toxicity_learns_from_the_other_folds(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = queries.QUERIES["op3_toxicity"](spark, SMALL.replace("0.001", "0.01")).collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [a > b for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(good) > 0.8
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_language_model_base(spark, odd):
    docs = {i: [*WORDS.findall((t or "").translate(LOWER)), ""] for i, t in documents(spark, odd).items()}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in queries.QUERIES["op6_hmm_lm"](spark, odd).collect():
        w = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0


def test_chat_comes_back(spark, odd):
    rows = spark.read.parquet(f"{odd}/conversations.parquet")
    back = chat_format.recovered(chat_format.formatted(chat_format.with_probe(spark, rows))).collect()
    assert all(r.round_trip for r in back)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back}
    assert turns[-7] == [(role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]
    assert turns[1] == [("user", "hi"), ("assistant", ""), ("assistant", "\\</turn> \\\\### User: x")]
    assert {r.conv_id: r.loss_text for r in back}[1] == "\\</turn> \\\\### User: x"
    # no reader of the template finds a turn that the source does not have
    raw = re.compile(r"(?<!\\)(?:### (?:System|User|Assistant|Role [0-9A-F]*):|</turn>)")
    assert all(len(raw.findall(r.formatted)) == 2 * r.n_turns for r in back)


def test_nearest_neighbours(spark, odd):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{odd}/embeddings.parquet").filter("vec_id < 400").collect()}
    rows = queries.QUERIES["op5_graph_ann"](spark, odd).collect()
    found = total = 0
    for q in (i for i in v if i % graph_ann.QUERY_EVERY == 0):
        best = sorted((-float(v[q] @ x), i) for i, x in v.items() if i != q)[: graph_ann.K]
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, graph_ann.K + 1))
        assert all(s == pytest.approx(float(v[q] @ v[i]), rel=1e-12) for _, i, s in mine)
        found += len({i for _, i in best} & {r[1] for r in mine})
        total += len(best)
    assert found / total >= 0.9
    assert {r.query_id for r in rows} == {i for i in v if i % graph_ann.QUERY_EVERY == 0}


def test_neighbours_of_all_sizes_and_lengths(spark):
    """Lengths never meet; giants do not hide small vectors; squares that overflow or vanish are no matter."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(600):
        v = rng.normal(size=16 if i % 3 else 8)
        rows.append((i, (v * 10.0 ** (0, 0, 0, 170, -170, 4)[i % 6 if i % 3 else 0]).tolist()))
    rows += [(600, [1.0]), (620, [2.0]), (640, [1e300] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_ann.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    hits = n = 0
    with np.errstate(over="ignore", invalid="ignore"):
        for q, v in rows:
            if q % 20:
                continue
            scores = [(-np.nan_to_num(float(np.dot(v, x)), nan=-np.inf, posinf=np.inf, neginf=-np.inf), i) for i, x in rows if i != q and len(x) == len(v)]
            best = {i for _, i in sorted(scores)[:20]}
            mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert len(mine) == len(best)
            hits, n = hits + len(best & set(mine)), n + len(best)
    assert hits / n >= 0.95


def test_recall_over_many_full_shards(spark, monkeypatch):
    """Fourteen shards, several blocks of queries, ties that lie in different shards, and rows that repeat an id."""
    monkeypatch.setattr(graph_ann, "SHARD_NODES", 150)
    monkeypatch.setattr(graph_ann, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(13)
    v = {i: rng.normal(size=16) for i in range(1980)} | {2000 + i: np.full(16, 2.0) for i in range(60)}
    rows = [(i, x.tolist()) for i, x in v.items()]
    vectors = spark.createDataFrame([*rows, *rows[:50]], "vec_id long, embedding array<double>")
    got = graph_ann.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    found = total = 0
    for q in (i for i in v if i % 20 == 0):
        best = [i for _, i in sorted((-float(v[q] @ x), i) for i, x in v.items() if i != q)[:20]]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == len(set(mine)) == 20
        found, total = found + len(set(best) & set(mine)), total + 20
    assert found / total >= 0.95
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 2000), key=lambda r: r.rank)]
    assert ties == list(range(2001, 2021))


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, odd, words, num):
    def shingles(t):
        w = WORDS.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in documents(spark, odd).items()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= num * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, words, num, 100).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert {r.doc_id for r in jaccard_join.keep_one(docs, words, num).collect()} == set(label.values())


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (3, 60, 900):
        a = np.sort(rng.integers(0, 2**63, n, np.uint64))
        b = np.sort(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, np.uint64)]))
        s = jaccard_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert sum(int(x).bit_count() for x in s[0] ^ s[1]) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_wide_sketches_are_a_bound_and_tell_large_sets_apart():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 2**63, 9000, np.uint64)
    for x, y in ((whole[:3000], whole[300:5000]), (whole[:3000], whole[3000:6500]), (whole[:600], whole[10:600])):
        far = jaccard_join.sketch_distance(jaccard_join.wide_sketch(x), jaccard_join.wide_sketch(y))
        assert far <= len(set(x.tolist()) ^ set(y.tolist()))
    assert 9 * jaccard_join.sketch_distance(jaccard_join.wide_sketch(whole[:3000]), jaccard_join.wide_sketch(whole[3000:6500])) > 6500
    assert jaccard_join.sketch_distance(jaccard_join.wide_sketch(whole), jaccard_join.wide_sketch(whole)) == 0


def test_large_near_copies_join(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 2500)]
    near, far = [*base], [f"w{i}" for i in rng.integers(0, 5000, 2500)]
    for i in range(0, 2500, 100):
        near[i] = "other"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in ((1, base), (2, near), (3, far), (4, base + far[:50]), (5, far[:1500] + base[:1000]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs, 5, 80, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_alike_nodes_behind_unlike_ones_join(spark):
    """All sets share only their empty first segment; its two leading nodes are unlike all others."""
    rng = np.random.default_rng(5)

    def in_second_half(words, n):
        while len(words) < n:
            w = [*words, f"w{rng.integers(10**6)}"]
            if len(w) < 4 or all(int(h) >> 63 for h in jaccard_join.hashed_sets(pa.array([" ".join(w)]), 4)[0]):
                words = w
        return words

    first, second, third = ([*in_second_half([], 9)] for _ in range(3))
    rows = [(1, first), (2, second), (3, third), (4, in_second_half(third, 10))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_mix_keeps_to_targets(spark):
    rows = curriculum.quotas(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    for target, size in {(r.target, r.source_size) for r in rows}:
        assert abs(sum(r.taken for r in rows if (r.target, r.source_size) == (target, size)) - target) < 1
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_rarest_token_files_each_rule_once(spark):
    counts = spark.createDataFrame([("com", 5), ("example", 3), ("en", 1)], "token string, n long")
    filed = url_rules.token_index(counts, url_rules.rule_table(spark, url_rules.HOST_RULES)).collect()
    assert len(filed) == len(url_rules.HOST_RULES)
    assert {r.name: r.token for r in filed}["example.com/en/"] == "en"
    with pytest.raises(Exception, match="rule without tokens"):
        url_rules.token_index(counts, url_rules.rule_table(spark, [url_rules.pattern_rule("x", [])])).collect()


def test_thousands_of_rules_against_brute_force(spark, monkeypatch):
    """Hosts with blanks, line breaks and control characters; a heavy token, an index that is shuffled, rules of one token."""
    rng = np.random.default_rng(12)
    parts = ["a", "b c", "x1", "deep", "shop", "\u0130", "k\n", "www", "e-f"]
    hosts = [(f"h{i}.com", f"/{p}", v) for i in range(1500) for p, v in (("", "block"), ("en/", "allow"))] + [("com", "/", "allow"), ("net", "/es/", "block")]
    rules = [url_rules.host_rule(*h) for h in hosts] + [url_rules.pattern_rule(rf"^[^#]*\b{w}\b", [w], rank=r) for r, w in enumerate(["shop", "deep"])]
    urls = ["http://u v@w.net/es/1", "http://a b.com/x", "http://net/es", "https://x.h7.com/en/?q", "http://H9.COM/e", "http://xh9.com/", None, "no scheme"]
    for _ in range(600):
        host = ".".join([*(parts[i] for i in rng.integers(0, len(parts), 2)), f"h{rng.integers(0, 1600)}", ["com", "net", "org"][rng.integers(0, 3)]])
        urls.append(f"http://{host}/{['', 'en/', 'es/', 'E/'][rng.integers(0, 4)]}{parts[rng.integers(0, len(parts))]}")

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if any(re.search(rf"^[^#]*\b{w}\b", f"{host}#{path}") for w in ("shop", "deep")) else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for broadcast, few in (("10m", 100_000), ("-1", 0)):
        monkeypatch.setattr(url_rules, "FEW_TOKENS", few)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.verdicts(pages, url_rules.rule_table(spark, rules)).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == {i: want(u) for i, u in enumerate(urls)}


def test_stages_keep_the_columns_of_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        assert all(r.score == 7.5 and r.key == "k" and r.kept is False for r in out.select("score", "key", "kept").collect())


def test_constant_model_without_labels(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    none = spark.read.parquet(f"{odd}/labels.parquet").limit(0)
    assert toxicity.keep_clean(docs, none).count() == docs.count()


def test_calibration_reads_all_labelled_rows(spark, monkeypatch):
    """Languages that a sample of 40 a class can't judge get their thresholds."""
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    rng = np.random.default_rng(6)

    def text(i, toxic):
        words = [f"w{k}" for k in rng.integers(0, 60, 300 if i % 8 == 1 else 30)]
        return " ".join([*words, *(["vile"] * 3 if toxic else [])])

    rows = [(i, text(i, i % 3 == 0), {0: "fr", 1: "long"}.get(i % 8, "en")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.thresholds) == {"en", "fr", "long"}


def test_mix_keeps_its_rows_when_files_are_cut_anew(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat(concat('w', id, ' '), cast(1 + id % 50 AS int)) AS text").repartition(40).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = Counter(r.doc_id for r in curriculum.mixed(docs).collect())
    mixed = curriculum.mixed(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # as if cores had come or gone
    try:
        assert Counter(r.doc_id for r in mixed.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_training_reads_long_texts_whole(spark):
    """The only sign of toxicity stands at the end of texts of over 50,000 characters."""
    rng = np.random.default_rng(7)

    def text(i):
        return " ".join([*(f"w{k}" for k in rng.integers(0, 3000, 9000)), *(["vile", "filth"] if i % 3 == 0 else [])])

    docs = spark.createDataFrame([(i, text(i), "en") for i in range(90)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(text(0)) > 50_000
    clean, vile = toxicity.logits(model, [text(1), text(3)])
    assert vile > clean + 1


def test_training_sample_is_bounded(spark, monkeypatch):
    """Rows with equal ids count once, and the characters of the sample are bounded without passing over long texts."""
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4000)
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(texts) or toxicity.Model(*[np.zeros((1 << toxicity.TABLE_BITS, toxicity.DIM), np.float32)] * 2, [np.zeros((w, toxicity.DIM, toxicity.FILTERS), np.float32) for w in toxicity.WIDTHS], np.zeros(24), np.zeros(24), 0.0))
    rows = [(i % 60, f"{'x' * 90} {i}", "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int"))
    assert sum(map(len, seen[0])) <= 4000 and len({t.split()[0] + str(int(t.split()[1]) % 60) for t in seen[0]}) == len(seen[0]) > 10


def test_logits_are_the_largest_responses_of_plain_loops():
    rng = np.random.default_rng(9)
    size = 1 << toxicity.TABLE_BITS
    model = toxicity.Model(
        rng.normal(size=(size, toxicity.DIM)).astype(np.float32),
        rng.normal(size=(size, toxicity.DIM)).astype(np.float32),
        [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        rng.normal(size=24).astype(np.float32),
        rng.normal(size=24).astype(np.float32),
        0.3,
    )
    texts = [None, "", "One", "one two", "a b c d e f a b", "  x, (y) z! ", "word " * 50]
    got = toxicity.logits(model, texts)
    for t, z in zip(texts, got, strict=True):
        words = toxicity.split(t) or [b""]
        e = [np.zeros(toxicity.DIM) if not w else model.first[toxicity.rows_of(w)[0]] + model.second[toxicity.rows_of(w)[1]] for w in words]
        want = model.offset
        for k in range(24):
            f = model.filters[k // toxicity.FILTERS][:, :, k % toxicity.FILTERS]
            places = [sum(float(f[j] @ e[i + j]) for j in range(len(f)) if i + j < len(e)) for i in range(len(e))]
            want += model.weight[k] * max(0.0, max(places) + model.bias[k])
        assert z == pytest.approx(want, abs=1e-3)


def test_scores_of_odd_texts(spark, odd):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, odd).collect()}
    texts_ = documents(spark, odd)
    assert set(rows) == set(texts_)
    nothing = {rows[i].score for i, t in texts_.items() if not (t or "").split()}
    assert len(nothing) == 1 and all(0 <= r.score <= 1 for r in rows.values())
    by_text = {}
    for i, t in texts_.items():
        by_text.setdefault(t, set()).add(rows[i].score)
    assert all(len(s) == 1 for s in by_text.values())


def test_a_host_that_stands_out_rejects_what_base_rules_keep(spark):
    """Twelve hosts fail a soft rule for a twentieth of their documents, one for most; a small unlucky one is no outlier."""
    fine = " ".join(f"w{i}" for i in range(60))
    odd_ = fine + " " + "#" * 20
    rows = [(f"h{h}", odd_ if i % 20 == h else fine) for h in range(12) for i in range(60)]
    rows += [("bad", fine if i % 10 == 0 else odd_) for i in range(60)] + [("small", odd_), ("small", fine), (None, odd_)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in host_quality.quality_verdicts(docs).collect()}
    for i, (h, t) in enumerate(rows):
        assert not got[i].base_failed
        assert got[i].host_strict == (h == "bad")
        assert got[i].kept == (h != "bad" or t == fine)
    assert {r.doc_id for r in host_quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_shares_in_stretches_of_training_follow_the_schedules(spark, tmp_path):
    """In each tenth of the mix every source has the words that its schedule asks for there."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', 20) AS text")
    rows = curriculum.quotas(docs).collect()
    ends = {0: lambda t: 1.5 * t - 0.5 * t * t, 1: lambda t: t, 2: lambda t: 0.5 * t + 0.5 * t * t}
    target = {r.doc_id % 3: r.target for r in rows}
    whole = sum(target.values())
    grid = np.linspace(0, 1, 20001)
    demand = sum(target[k] * ends[k](grid) for k in ends)
    for tenth in range(10):
        t0, t1 = np.interp([whole * tenth / 10, whole * (tenth + 1) / 10], demand, grid)
        for k in (1, 2):  # sources taken at most once, so that first positions are all positions
            if target[k] > 40000:
                continue
            words = sum(r.taken for r in rows if r.doc_id % 3 == k and r.position is not None and whole * tenth / 10 <= r.position < whole * (tenth + 1) / 10)
            assert words == pytest.approx(target[k] * (ends[k](t1) - ends[k](t0)), abs=0.02 * target[k])


def test_mix_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    as_rows = lambda d: [(r.doc_id, r.text) for r in curriculum.mixed(d).collect()]
    assert as_rows(docs) == as_rows(docs.repartition(7, "doc_id"))


def test_mix_passes_columns_with_its_own_names(spark):
    docs = spark.range(30).selectExpr("id AS doc_id", "'a' AS source", "repeat('w ', 9) AS text", "id AS _row", "id AS _position", "id AS _epoch", "id AS size", "id AS tie")
    out = curriculum.mixed(docs)
    assert out.columns == docs.columns
    assert all(r.doc_id == r._row == r.tie for r in out.collect())


def test_groups_larger_than_a_chunk(spark, monkeypatch):
    """A large group of unlike sets with a few alike pairs is cut into chunks on both sides and stays exact."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 5)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 1)
    rng = np.random.default_rng(11)
    base = [[f"w{i}" for i in rng.integers(0, 10**6, 9)] for _ in range(40)]
    rows = [*base, *[[*b, "more"] for b in base[::7]]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()}
    assert got == {i: i if i < 40 else (i - 40) * 7 for i in range(len(rows))}
    members = spark.createDataFrame([(1, i, i, 6, 23, *[0] * jaccard_join.LANES) for i in range(23)], "group long, node long, label long, n_shingles long, size long, " + ", ".join(f"{p} long" for p in jaccard_join.SKETCH))
    pairs = {(r.a, r.b) for r in jaccard_join.pairs_within(members, 85, 100).collect()}
    assert pairs == {(a, b) for a in range(23) for b in range(a + 1, 23)}
