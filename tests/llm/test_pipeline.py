"""The pipeline's stages, each on its own input, against plain Python; tables with odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import curriculum, host_quality, jaccard_join, nnls_pack, toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of six sources with nulls, repeated ids and texts, long and empty texts, near copies and a bad source."""
    rng = np.random.default_rng(21)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(240):
        words = list(rng.choice(vocab, int(rng.integers(55, 160))))
        if i % 6 == 5 and i % 4:
            words = (words[:30] * 6)[: int(rng.integers(60, 100))] if i % 8 == 1 else [*words[:60], "#" * 30]
        if i % 5 == 0:
            words += ["vile", "filth"]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", f"s{i % 6}"))
    for i in range(0, 60, 2):  # near copies, and some that are not near enough
        w = rows[i][1].split()
        for k in rng.integers(0, len(w), 1 if i % 4 else 25):
            w[k] = "changed"
        rows.append((300 + i, " ".join(w), "en", rows[i][3]))
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " ".join(vocab) + " " + " ".join(vocab[:2000]), "en", "s1"), (403, rows[7][1], "en", None), (404, "short one", "en", "s2")]
    rows += [rows[9], rows[9]]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


def clean(model, text, lang):
    z = float(np.clip(toxicity.logits(model, [text])[0], -12, 12))
    return toxicity.sigmoid(model.slope * z + model.shift) < model.thresholds.get(lang, model.fallback)


def good(rows):
    """Rows that the rules keep; rates, prior and bar by hand."""
    measured = [dict(zip(host_quality.MEASURES, host_quality.measure_text(r[1]), strict=True)) for r in rows]
    fails = {k: [bool(eval(rule, {}, m)) for m in measured] for k, rule in host_quality.RULES.items()}
    hosts = defaultdict(list)
    for n, r in enumerate(rows):
        if r[3] is not None:
            hosts[r[3]].append(n)
    total = sum(map(len, hosts.values()))
    strict = set()
    for of in fails.values():
        counts = {h: (sum(of[n] for n in ns), len(ns)) for h, ns in hosts.items()}
        m = sum(f for f, _ in counts.values()) / total
        v = sum(n * (f / n - m) ** 2 for f, n in counts.values()) / total - len(hosts) * m * (1 - m) / total
        strength = min(host_quality.MAX_STRENGTH, max(host_quality.MIN_STRENGTH, m * (1 - m) / v - 1)) if v > 0 else host_quality.MAX_STRENGTH
        bar = m + host_quality.STRICT_SPREADS * math.sqrt(m * (1 - m) / (strength + 1))
        strict |= {h for h, (f, n) in counts.items() if (f + m * strength) / (n + strength) > bar}
    for n, r in enumerate(rows):
        base = any(fails[k][n] for k in host_quality.BASE_RULES)
        soft = any(fails[k][n] for k in host_quality.SOFT_RULES)
        if not base and not (soft and r[3] in strict):
            yield r


def without_copies(rows):
    sets = {r[0]: jaccard_join.shingle_set(r[1], 5) for r in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return [r for r in rows if label[r[0]] == r[0]]


def mixture(rows):
    """How often each row is taken, and the ids in order of position, by plain loops."""
    size = [len((r[1] or "").encode().split()) for r in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    have = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: curriculum.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(size) - sum(target.values())
        over = {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * have[s]}
        if not over:
            break
        target |= {s: 3.0 * have[s] for s in over}
        free -= over
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    integral = {5: lambda t: 1.5 * t - 0.5 * t * t, 2: lambda t: t, 1: lambda t: 0.5 * t + 0.5 * t * t}
    grid = np.linspace(0, 1, 200_001)
    copies = []
    for s in names:
        own = sorted((hashlib.md5(f"{r[0]}:{size[n]}".encode()).hexdigest(), r[0], n) for n, r in enumerate(rows) if r[3] == s)
        at = 0
        for epoch in range(3):
            for _, i, n in own:
                take = max(0, min(size[n], math.floor(target[s]) - at))
                if take and 2 * take >= size[n]:
                    t = np.interp((at + take / 2) / target[s], integral[weight[s]](grid), grid)
                    copies.append((sum(target[x] * integral[weight[x]](t) for x in names), i))
                at += size[n]
    return sorted(copies)


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    stage = corpus_pipeline.written(STAGES["toxicity"](spark, docs, folder), "a")
    before = rows_of(docs)
    assert Counter(rows_of(stage)) == Counter(r for r in before if clean(model, r[1], r[2]))
    assert 20 < len(before) - stage.count() < 120

    before = rows_of(stage)
    stage = corpus_pipeline.written(STAGES["quality rules"](spark, stage, folder), "b")
    assert Counter(rows_of(stage)) == Counter(good(before))
    base = [r for r in before if host_quality.measure_text(r[1])[0] >= 50]
    assert stage.count() < len(base)

    before = rows_of(stage)
    stage = corpus_pipeline.written(STAGES["n-gram Jaccard join"](spark, stage, folder), "c")
    assert Counter(rows_of(stage)) == Counter(without_copies(before))
    assert stage.count() < len(before)

    before = rows_of(stage)
    mixed = STAGES["mixing"](spark, stage, folder)
    assert mixed.columns == docs.columns
    got, want = [r[0] for r in rows_of(mixed)], mixture(before)
    assert Counter(got) == Counter(i for _, i in want)
    first = {}
    for p, i in want:
        first.setdefault(i, p)
    seen = [first[i] for n, i in enumerate(got) if i not in got[:n]]
    assert all(a <= b + 2.0 for a, b in zip(seen, seen[1:], strict=False))  # the grid is as fine as that

    stage = corpus_pipeline.written(mixed, "d")
    pieces = STAGES["packing"](spark, stage, folder).collect()
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter(r[0] for r in rows_of(stage))
    for i, t in {(r[0], r[1]) for r in rows_of(stage)}:
        n = len(vocabulary.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(p.length for p in pieces if p.doc_id == i) == n * lengths[i]
        assert {p.doc_tokens for p in pieces if p.doc_id == i} == {n}
    assert all(n <= nnls_pack.WINDOW for n in Counter({s: sum(p.length for p in pieces if p.sequence_id == s) for s in {p.sequence_id for p in pieces}}).values())


def test_run_on_odd_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(0 < r.length <= nnls_pack.WINDOW and r.offset + r.length <= nnls_pack.WINDOW for r in rows)
    ids = {r.doc_id for r in rows}
    assert not ids & {400, 401, 404}
