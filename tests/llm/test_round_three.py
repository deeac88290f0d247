"""Clustering, language and manifest against plain Python, on small tables with odd rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_lang, curriculum, hamerly, merkle

SMALL = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# Clustering


def clustered_plainly(rows, k=8, rounds=10):
    kept = [(i, [math.floor(x) if abs(x) >= 2**53 else math.floor(x * 1024) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [int(x) * 1024 if abs(x) >= 2**53 else q for x, q in zip(v, s, strict=True)]) for (i, s), v in zip(kept, [v for _, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)], strict=True)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    cents = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (dist(v, cents[c]), c)) for _, v in kept]
        if step == rounds:
            break
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    d = [dist(v, cents[o]) for (_, v), o in zip(kept, own, strict=True)]
    fits = lambda x: x if x < 2**63 else None
    by = {c: sum(x for x, o in zip(d, own, strict=True) if o == c) for c in set(own)}
    return [(i, o, fits(x), fits(by[o]), fits(sum(d)), sha(",".join(map(str, cents[o])))) for (i, _), o, x in zip(kept, own, d, strict=True)]


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def vectors(n=300, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (9, 64))
    return [(i, (middles[i % 9] + rng.normal(0, 0.4, 64)).tolist()) for i in range(n)]


VECTORS = "vec_id long, embedding array<double>, cluster string, distance string"


def run_clusters(spark, rows):
    return hamerly.clustered(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)).collect()


def test_clusters_are_those_of_full_scans(spark, monkeypatch):
    monkeypatch.setattr(hamerly, "BLOCK", 16)
    rows = vectors()
    rows += [rows[0], rows[1], (1, rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]  # repeated rows, equal and null ids
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [1.0] * 63 + [float("inf")]), (906, [0.0] * 64), (907, [-0.0] * 64)]
    assert by_text(run_clusters(spark, rows + odd)) == by_text(clustered_plainly(rows + odd))


def test_bounds_spare_scans(spark):
    _, _, scanned = hamerly.assigned(spark.createDataFrame(vectors(2000), "vec_id long, embedding array<double>"))
    assert scanned[0] == 2000 and scanned[-1] < 700


def test_clusters_of_large_components(spark):
    rows = vectors(60) + [(100 + k, [(-1.0) ** k * 10.0 ** (3 * k + j % 3) for j in range(64)]) for k in range(12)] + [(200, [1e300] * 64), (201, [-1e300] * 64), (202, [3e9] * 64)]
    got = run_clusters(spark, rows)
    assert by_text(got) == by_text(clustered_plainly(rows))
    assert any(r["distance"] is None or r["inertia"] is None for r in got)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    rows = vectors(n)
    assert by_text(run_clusters(spark, rows)) == by_text(clustered_plainly(rows))


def test_clusters_of_one_vector_repeated(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    got = run_clusters(spark, rows)
    assert {r["cluster"] for r in got} == {0} and by_text(got) == by_text(clustered_plainly(rows))


@pytest.mark.parametrize("module, name", [(hamerly, "op11_hamerly"), (merkle, "op13_merkle")])
def test_same_rows_as_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = getattr(module, name)(spark, SMALL)
    want = con.sql(module.ORACLE_SQL)
    assert got.columns == want.columns
    assert by_text(got.collect()) == by_text(want.fetchall())


# Manifest


def climb(nodes):
    """All levels of a tree, by the rule as it is told."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a : a + 3])) for a in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return out


def manifest_plainly(docs):
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, text: sha("".join(map(said, (*d[:4], text))))
    trees = {}
    for d in docs:
        trees.setdefault(d[1], []).append((d, leaf(d, d[4])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in order:
        trees[t].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    grown = {t: climb([h for _, h in trees[t]]) for t in order}
    top = climb([grown[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, (d, h) in enumerate(trees[t]):
            proof = siblings(grown[t], i) + siblings(top, k)
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            f = leaf(d, d[4].replace("\n", "")) if changed else h
            for before, after in proof:
                f = sha("".join(before) + f + "".join(after))
            root = top[-1][0]
            out.append((d[0], h, grown[t][-1][0], root, sha("".join(x for b, a in proof for x in b + a)), f, f == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, proof string, tree string"


def run_manifest(spark, tmp_path, docs, parts=4):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return merkle.op13_merkle(spark, path).collect()


def odd_docs():
    out = [(i, f"s{i % 2}", "en", i, f"text {i}\nmore\n\n") for i in range(90)]
    out += [(200 + i, "hot", "de", 5, "a\nb") for i in range(250)]
    out += [(7, "hot", None, None, None), (None, "hot", "en", 1, "x\ny"), (None, None, None, None, None), (500, None, "fr", 2, ""), (501, "é", "fr", 2, "é\n" * 9000), (502, "", "fr", 2, "\n"), (503, "z", "zz", 3, "lone")]
    return out + [out[3]] * 4 + [(3, "s1", "en", 3, "another text of one id")]


@pytest.mark.parametrize("partitions, levels", [("1", 12), ("7", 1), ("40", 2)])
def test_manifest_is_that_of_the_rule(spark, tmp_path, monkeypatch, partitions, levels):
    monkeypatch.setattr(merkle, "SPAN_LEVELS", levels)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = run_manifest(spark, tmp_path, odd_docs())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert by_text(got) == by_text(manifest_plainly(odd_docs()))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_manifest_of_few_documents(spark, tmp_path, n):
    docs = odd_docs()[:n]
    assert by_text(run_manifest(spark, tmp_path, docs, 1)) == by_text(manifest_plainly(docs))


def test_stack_leaves_unaligned_edges_open():
    nodes = [(0, i, bytes([i])) for i in range(27)]
    whole, peaks = merkle.climbed(nodes, 27)
    assert [p[:2] for p in peaks] == [(3, 0)] and len(whole) == 13
    left, right = merkle.climbed(nodes[:10], 27), merkle.climbed(nodes[10:], 27)
    assert [p[:2] for p in left[1]] == [(2, 0), (0, 9)]
    assert [p[:2] for p in right[1]] == [(0, 10), (0, 11), (1, 4), (1, 5), (2, 2)]
    rest, peak = merkle.climbed(left[1] + right[1], 27)
    assert peak == peaks and sorted(left[0] + right[0] + rest) == sorted(whole)


# Language


def tiny(langs=("a", "b"), seed=2):
    rng = np.random.default_rng(seed)
    wide = byte_lang.FILTERS * len(byte_lang.WIDTHS)
    e = rng.normal(size=(256, byte_lang.DIM)).astype(np.float32)
    e[0] = 0
    filters = [rng.normal(size=(w, byte_lang.DIM, byte_lang.FILTERS)).astype(np.float32) for w in byte_lang.WIDTHS]
    return byte_lang.Model(list(langs), e, filters, rng.normal(size=wide).astype(np.float32), rng.normal(size=(wide, len(langs))).astype(np.float32), rng.normal(size=len(langs)).astype(np.float32))


def test_logits_are_those_of_plain_loops():
    model = tiny()
    rng = np.random.default_rng(4)
    texts = [b"", b"a", b"ab", bytes(rng.integers(1, 256, 253)), bytes(rng.integers(1, 256, 256)), bytes(rng.integers(1, 256, 6000)), b"ab"]
    want = []
    for t in texts:
        raw, total, weight = t + bytes(2 * byte_lang.WINDOW), 0, 0
        for a in range(0, max(1, len(t)), byte_lang.WINDOW):
            places = range(a, a + byte_lang.WINDOW)
            best = [np.max([sum(model.embedding[raw[p + j]] @ f[j] for j in range(len(f))) for p in places], 0) for f in model.filters]
            z = np.maximum(np.concatenate(best) + model.bias, 0) @ model.weight + model.offset
            n = min(max(len(t) - a, 0), byte_lang.WINDOW)
            total, weight = total + z * n, weight + n
        want.append(total / max(weight, 1))
    got = byte_lang.logits(model, texts)
    assert got == pytest.approx(np.array(want), rel=1e-3, abs=1e-3)
    assert (got[2] == got[6]).all()


def test_languages_of_held_out_texts(spark):
    got = byte_lang.op12_byte_lang(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98


LANG_DOCS = "doc_id long, text string, lang string, score string"


def lang_docs():
    one, two = "lorem ipsum dolor ", "żółć gęślą jaźń "
    out = [(i, (one if i % 2 else two) * (1 + i % 30), "x" if i % 2 else "y", "clash") for i in range(60)]
    return out + [(100, None, "x", ""), (101, "", "x", ""), (102, "123 !? \n", "y", ""), (103, one * 200_000, None, ""), (None, two, "y", ""), (104, two, None, ""), (3, two * 3, "x", ""), (103, "ж", None, "")]


def test_languages_of_odd_rows(spark, tmp_path):
    path = str(tmp_path)
    rows = lang_docs()
    spark.createDataFrame(rows + rows[:5], LANG_DOCS).write.parquet(f"{path}/documents.parquet")
    got = byte_lang.op12_byte_lang(spark, path).collect()
    assert len(got) == len(rows) + 5
    told = {}
    for r in got:
        told.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert told[100] == told[101] == told[102] == {("und", 0.0)}
    assert {t for t, _ in told[103]} <= {"x", "y"} and ("x" in {t for t, _ in told[103]}) and {t for t, _ in told[104]} == {"y"} == {t for t, _ in told[None]}
    assert all(len(told[i]) == 1 for i in range(5) if i != 3)  # equal texts, equal results
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]


@pytest.mark.parametrize("langs, want", [((), ("und", 0.0)), (("x",), ("x", 1.0))])
def test_too_few_languages(spark, tmp_path, langs, want):
    docs = [(i, "some words", x, "") for i, x in enumerate(langs * 9)] + [(50, "more", None, ""), (51, "7", None, "")]
    spark.createDataFrame(docs, LANG_DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in byte_lang.op12_byte_lang(spark, str(tmp_path)).collect()}
    assert got[50] == want and got[51] == ("und", 0.0)


def test_languages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], LANG_DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert byte_lang.op12_byte_lang(spark, str(tmp_path)).collect() == []


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame(lang_docs(), LANG_DOCS).withColumn("_told", F.lit(1)).drop("score")
    got = byte_lang.with_language(docs, tiny(("x", "y")))
    assert got.columns == ["doc_id", "text", "lang", "_told", "lang_pred", "score"]
    assert [r["_told"] for r in got.collect()] == [1] * len(lang_docs())


# URL rules


def test_shipped_url_rules_are_those_of_their_family(spark):
    """Every rule's own URL is blocked by the index as by the few expressions of the SQL; words that only touch are not."""
    import re

    from millrace.llm import url_rules

    hosts = [f"{a}{sep}{b}.org" for a, b in (("cheap", "pills"), ("loans", "fast"), ("free", "porn"), ("win", "win")) for sep in ("-", ".", "")]
    urls = [f"http://{h}/" for h in hosts] + [f"http://x.org/a/{o}{sep}{g}{end}" for o in url_rules.OFFERS[:4] for g in url_rules.GOODS[::5] for sep in "-_/" for end in ("", "/x", "s", ".html")]
    urls += [f"http://www.{g}.{e}/" for g in url_rules.GOODS[::4] for e in (*url_rules.ENDS[:3], "org")] + ["http://nice-tickets-shop.org/", "http://a.org/best-", None, "best-loans", "http://BEST-Loans.ORG/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.verdicts(pages).collect()}
    for n, r in got.items():
        text = f"{r.host}#{r.path}"
        if r.rule is None:
            assert (r.verdict == "block") == any(re.search(p, text) for p in url_rules._PATTERNS) == any(re.search(p.pattern, text) for p in url_rules.PATTERN_RULES), urls[n]
    assert {r.verdict for r in got.values()} == {"allow", "block"} and len(url_rules.PATTERN_RULES) > 1500


def test_targets_of_many_sources_go_over_ranges(spark):
    """Sources in eight ranges get the targets that plain water filling gives, stopped ones in several ranges."""
    rng = random.Random(5)
    size = {**{f"{rng.choice('aé\U0001f600z')}{k}": rng.choice([0, 1, 1, 7, 40, 900, rng.randint(0, 20_000)]) for k in range(3000)}, None: 55}
    rows = [(s, n // 2) for s, n in size.items()] + [(s, n - n // 2) for s, n in size.items()]
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, sorted(names, key=lambda s: 3 * size[s] / weight[s]), sum(size.values())
    share = sum(weight.values())
    while free and weight[free[0]] * left > 3 * size[free[0]] * share:
        s = free.pop(0)
        want[s], left, share = 3 * size[s], left - 3 * size[s], share - weight[s]
    want |= {s: weight[s] * left / share for s in free}
    assert 100 < len(free) < 2900
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sized = spark.createDataFrame(rows, "source string, size long")
        found = curriculum.targets(sized).collect()
        ranges = curriculum.in_ranges(sized.select("source").distinct(), [F.col("source").asc_nulls_last()], "test")
        assert ranges.select("_p").distinct().count() == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["source"]: (r["source_size"], r["target"]) for r in found}
    assert len(found) == len(got) == len(size)
    assert all(got[s][0] == size[s] and got[s][1] == pytest.approx(want[s], rel=1e-12) for s in size)
    assert sum(t for _, t in got.values()) == pytest.approx(sum(size.values()))
