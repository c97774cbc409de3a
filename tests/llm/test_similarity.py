import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import components, multiindex, nearjoin, passages
from tempora.llm.shingles import runs, words

ODD = [(None, "no key at all here now"), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two, WORDS"), (905, "z " * 4000)]


def edited(text, share, seed):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, links):
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, None)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == {i: g for i, g in groups({x for e in real for x in e}, real).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [250_000, 2_000])
def test_jaccard_join(docs_of, prose, block):
    rows = [(i, prose(i, 60)) for i in range(30)]
    rows += [(100 + i, edited(prose(i % 3, 60), 0.02 + 0.01 * (i % 4), i)) for i in range(60)] + [(200 + i, prose(5, 60)) for i in range(5)] + [(200, prose(5, 60))] + ODD
    got = nearjoin.jaccard_join(docs_of(rows), block_shingles=block).collect()
    assert len(got) == len(rows)
    s = [(i, sets(t)) for i, t in rows]
    same = lambda a, b: bool(a) and len(a & b) / len(a | b) >= 0.8
    n_links = {}
    for x, (i, a) in enumerate(s):
        n_links.setdefault(i, []).append(sum(same(a, b) for y, (_, b) in enumerate(s) if x != y))
    ids = {i for i, _ in s if i is not None}
    classes = groups(ids, [(i, j) for i, a in s for j, b in s if i is not None and j is not None and i < j and same(a, b)])
    for r in got:
        assert r.n_links in n_links[r.doc_id], r
        if r.doc_id is not None:
            assert r.class_id == classes[r.doc_id] and r.kept == (r.doc_id == r.class_id), r
    assert nearjoin.jaccard_join(docs_of(rows).limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    looks = nearjoin.least_matches(0.8, 140, 20, 1e-5)
    assert [n for n, _ in looks] == list(range(20, 141, 20)) and all(0 < m < 0.8 * n for n, m in looks)
    rng = np.random.default_rng(1)
    lost = sum(any(x[:n].sum() < m for n, m in looks) for x in rng.random((20_000, 140)) < 0.8)
    assert lost < 20


def test_words_and_runs():
    for t in ("Ab, cd-ef  gh\n9é", "", None, "...", "one"):
        h, s, e = words(t)
        assert [t[a:b].lower() for a, b in zip(s, e)] == re.findall(r"[^\W_]+", (t or "").lower())
    a, b = words("x the cat sat on a mat")[0], words("The CAT sat? on a mat, then")[0]
    assert set(runs(a, 5)) & set(runs(b, 5)) == set(runs(a, 5)[1:]) and len(runs(a, 5)) == 3


def brute_chain(points, k, gap):
    points = sorted(set(points))
    best = []
    for i, (p, q) in enumerate(points):
        top = max([best[j] - gap * (p + q - points[j][0] - points[j][1]) for j in range(i) if points[j][0] < p and points[j][1] < q], default=0)
        best.append(k + max(0, top))
    return max(best)


def test_chain_against_quadratic():
    rng = random.Random(7)
    for _ in range(200):
        pts = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))]
        parts = passages.chain(pts)
        assert sorted(p for c in parts for p in c) == sorted(set(pts))
        first = parts[0]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(first, first[1:]))
        total = 5 * len(first) - passages.GAP * (sum(first[-1]) - sum(first[0]))
        assert total == pytest.approx(brute_chain(pts, 5, passages.GAP))


def test_passages(docs_of, prose, spark):
    shared = prose(77, 80)
    rows = [(1, prose(1, 100) + " " + shared), (2, prose(2, 40) + " " + shared + " " + prose(3, 40)), (3, prose(4, 100)), (4, prose(5, 60) + " " + edited(shared, 0.06, 3) + " " + prose(6, 60)), (5, prose(7, 50) + " " + " ".join(shared.split()[:30])), *ODD]
    rows += [(20 + i, prose(100 + i, 10) + " " + shared) for i in range(30)]
    got = {r.doc_id: r for r in passages.find_passages(docs_of(rows)).collect()}
    assert set(got) == {2, 4} | set(range(20, 50))
    assert (got[2].start_word, got[2].end_word) == (40, 120) and got[2].sources == [1] and got[2].identity == 1.0
    assert abs(got[4].start_word - 60) <= 3 and abs(got[4].end_word - 140) <= 3 and 0.9 <= got[4].identity < 1
    found = passages.find_passages(docs_of(rows))
    cut = {r.doc_id: r for r in passages.cut_passages(docs_of(rows), found).collect()}
    assert cut[2].text.split() == (prose(2, 40) + " " + prose(3, 40)).split() and cut[1].text == rows[0][1] and cut[3].text == rows[2][1]
    assert passages.find_passages(docs_of(rows).limit(0)).count() == 0
    twice = docs_of([(1, shared), (1, shared), (2, prose(9, 80))])
    assert [r.doc_id for r in passages.find_passages(twice).collect()] == [1]


def test_two_passages_of_one_pair(docs_of, prose):
    shapes = [(60, 40, 60), (60, 100, 60), (60, 200, 60), (60, 300, 60), (100, 100, 100), (200, 200, 200)]
    rows, want = [], []
    for i, (x, gap, y) in enumerate(shapes):
        first, second = prose(1000 + i, x), prose(1100 + i, y)
        rows += [(10 * i + side, " ".join([prose(1200 + 10 * i + side, 30), first, prose(1300 + 10 * i + side, gap), second, prose(1400 + 10 * i + side, 30)])) for side in (1, 2)]
        want += [(10 * i + 2, 30, 30 + x), (10 * i + 2, 30 + x + gap, 30 + x + gap + y)]
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in passages.find_passages(docs_of(rows)).collect())
    assert len(got) == len(want)
    assert all(g[0] == w[0] and abs(g[1] - w[1]) <= 2 and abs(g[2] - w[2]) <= 2 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("every", [5, 6, 8, 10])
def test_seeds_of_edited_passages(docs_of, prose, every):
    rows = []
    for i in range(12):
        passage = prose(2000 + i, 90)
        changed = " ".join(f"x{every}y{i}z{n}" if n % every == every - 1 else w for n, w in enumerate(passage.split()))
        rows += [(10 * i + 1, prose(2100 + i, 40) + " " + passage + " " + prose(2200 + i, 40)), (10 * i + 2, prose(2300 + i, 40) + " " + changed + " " + prose(2400 + i, 40))]
    got = {r.doc_id: r for r in passages.find_passages(docs_of(rows)).collect()}
    assert set(got) == {10 * i + 2 for i in range(12)}
    assert all(r.start_word <= 48 and r.end_word >= 122 and r.identity >= passages.IDENTITY for r in got.values())


def test_kept_words_are_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert passages._matches(a, b) == row[-1][-1]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"_x": F.lit(1), "_cells": F.lit(2), "links": F.lit(3)})


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 32))
    near = base[:200] + 0.2 * rng.normal(size=(200, 32)) * np.linalg.norm(base[:200], axis=1)[:, None] / 32**0.5
    crowd = base[3] + 0.03 * rng.normal(size=(150, 32))
    x = np.concatenate([base, near, crowd, base[:2]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, [float("nan")] + [1.0] * 31, 0), (5003, [None] + [1.0] * 31, 0), (5004, [], 0), (5005, [1.0] * 8, 0), (5006, [float("inf")] * 32, 0), (None, (-x[9]).tolist(), 0)]
    got = multiindex.near_vectors(vectors(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    by = {r.vec_id: r for r in got}
    found = sum(by[i].n_links for i in range(len(x)))
    assert 0.99 * link.sum() <= found <= link.sum() and link.sum() > 20_000
    want = groups(range(len(x)), [tuple(e) for e in np.argwhere(link) if e[0] < e[1]])
    assert sum(by[i].component_id == want[i] for i in want) >= 0.99 * len(x)
    assert all(by[i].kept == (by[i].component_id == i) for i in range(len(x)))
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(5000, 5007))
    assert multiindex.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(5)
    a, b = rng.random((40, 7)), rng.random((40, 5))
    got = multiindex.sequence(a, b, 12)
    whole = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    assert np.allclose(np.take_along_axis(whole, got, 1), np.sort(whole, axis=1)[:, :12])


def test_pipeline(docs_of, prose, spark, tmp_path):
    from pyspark.sql import functions as F  # noqa: F811

    bad = "grumble snarkly blockhead"
    shared, item = prose(7077, 70), prose(8088, 25)
    rows = [(i, prose(i, 60) + (f" {bad} {prose(500 + i, 9)}" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200, edited(prose(1, 60), 0.02, 1)), (201, prose(601, 50) + " " + shared), (202, prose(602, 50) + " " + shared), (203, prose(603, 50) + " " + item), (204, None), (205, ""), (206, prose(606, 60)), (206, prose(606, 60))]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: sorted(r.doc_id for r in seen[n].select("doc_id").collect())
    clean = [i for i in range(120) if i % 4]
    assert ids("toxicity") == sorted(clean + [*range(200, 207), 206])
    assert ids("near_copies") == sorted(clean + list(range(201, 207)))
    text = {r.doc_id: r for r in seen["repeated_passages"].collect()}
    assert text[202].text.split() == prose(602, 50).split() and text[202].n_chars == len(text[202].text) and text[201].text == rows[-7][1]
    assert ids("decontamination") == sorted(clean + [201, 202, 204, 205, 206])
    assert seen["encoding"].where("NOT round_trip").isEmpty() and ids("encoding") == ids("decontamination")


def test_pipeline_keeps_clean_rows_of_a_dropped_key(docs_of, prose, spark, tmp_path):
    bad, item = "grumble snarkly blockhead", prose(8088, 25)
    rows = [(i, prose(i, 60) + (f" {bad}" if i % 4 == 0 else "")) for i in range(120)]
    odd = [(None, prose(700, 40)), (None, prose(701, 40)), (7, prose(702, 40)), (None, None)]
    toxic, leaking = [(k, f"{prose(710, 30)} {bad}") for k in (None, 7)], [(k, f"{prose(720, 30)} {item}") for k in (None, 7)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs_of(rows + odd + toxic), str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == {r for r in rows if r[0] % 4} | set(odd)
    left = corpus_pipeline.drop_leaks(spark, docs_of(odd + leaking), str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == set(odd)
