"""Nulls, ties, repeats, empty tables, clashing names; plain versions of what has no SQL."""

import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import chat, common, licenses, multiindex, nearjoin, passages, pieces, sharding, toxicity, wordpiece

CLASHING = ("_near", "_own", "_f_word", "_f_spot", "_ck", "_cut", "_d_key", "_h", "_x", "_copy", "text_hash")


def with_clashes(df):
    return df.withColumns({c: F.lit(f"kept {c}") for c in CLASHING if c not in df.columns})


# ---- shared helpers -------------------------------------------------------------------------------------------------


def test_without_compares_keys_and_keeps_columns(spark):
    rows = with_clashes(spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a"), (2, "a")], "doc_id long, text string"))
    dropped = spark.createDataFrame([(1, "b"), (None, "a"), (2, "a"), (9, "z")], "k long, t string")
    left = common.without(rows, dropped, {"k": F.col("doc_id"), "t": F.col("text")})
    assert left.columns == rows.columns and {(r.doc_id, r.text) for r in left.collect()} == {(1, "a"), (None, None)}
    assert all(r[c] == f"kept {c}" for r in left.collect() for c in CLASHING)
    assert common.without(rows, dropped.limit(0), {"k": F.col("doc_id"), "t": F.col("text")}).count() == 6


def test_intermediate_tables_are_written_in_small_arrow_batches(spark):
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(80, numPartitions=1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    sizes = common.materialize(rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches), "n long, size long")).collect()
    assert sum(r.n for r in sizes) == 80 and max(r.size for r in sizes) < 6_000_000
    assert spark.conf.get(name) == before


# ---- substring dedup ------------------------------------------------------------------------------------------------


def test_a_passage_survives_earlier_slices_of_it(docs_of, prose):
    shared = prose(4000, 100).split()
    rows = [(50, prose(4001, 30) + " " + " ".join(shared)), (51, " ".join(shared) + " " + prose(4002, 30))]
    rows += [(i, prose(4100 + i, 20) + " " + " ".join(shared[8 * i : 8 * i + 19]) + " " + prose(4200 + i, 20)) for i in range(11)]
    got = {r.doc_id: r for r in passages.find_passages(docs_of(rows)).collect()}
    assert set(got) == {51} and (got[51].start_word, got[51].end_word) == (0, 100) and 50 in got[51].sources


def test_slices_between_two_holders_hide_no_exact_passage(docs_of, prose):
    shared = prose(4300, 90).split()
    slices = [(20 + i, prose(4400 + i, 25) + " " + " ".join(shared[7 * i : 7 * i + 15]) + " " + prose(4500 + i, 25)) for i in range(11)]
    rows = [(i, t) for i, t in slices[:5]] + [(30, " ".join(shared))] + [(40 + i, t) for i, t in slices] + [(90, prose(4600, 10) + " " + " ".join(shared))]
    got = {r.doc_id: r for r in passages.find_passages(docs_of(rows)).collect()}
    assert 90 in got and got[90].start_word == 10 and got[90].end_word == 100


@pytest.mark.parametrize("n", [120, 360])
def test_repeated_windows_are_covered(docs_of, prose, n):
    """Against all windows of 50 words, in documents that share parts of passages."""
    rng = random.Random(n)
    stock = [prose(5000 + i, 120).split() for i in range(n // 6)]
    rows = []
    for i in range(n):
        words = prose(6000 + i, 40).split()
        for _ in range(rng.randint(0, 2)):
            s, at, size = rng.choice(stock), rng.randrange(0, 60), rng.randint(30, 60)
            words[rng.randrange(len(words)) :][:0] = s[at : at + size]
            words += s[at : at + size]
        rows.append((i, " ".join(words)))
    reported = defaultdict(list)
    for r in passages.find_passages(docs_of(rows)).collect():
        reported[r.doc_id].append((r.start_word, r.end_word))
    seen, wanted, covered = set(), 0, 0
    for i, t in rows:
        w = t.split()
        windows = [tuple(w[p : p + 50]) for p in range(len(w) - 49)]
        for p, x in enumerate(windows):
            if x in seen:
                wanted += 1
                covered += any(s <= p and p + 50 <= e for s, e in reported[i])
        seen |= set(windows)
    assert wanted > 20 and covered >= 0.98 * wanted


def test_holders_of_a_seed_hide_no_exact_passage(docs_of, prose):
    """Documents before and behind the only other holder hold runs of 44 words of it, from different places."""
    shared = prose(7000, 60).split()
    slices = [(i, prose(7100 + i, 30) + " " + " ".join(shared[at : at + 44]) + " " + prose(7200 + i, 30)) for i, at in enumerate((0, 4, 8, 12, 16))]
    middle = (50, prose(7300, 20) + " " + " ".join(shared) + " " + prose(7301, 20))
    rows = [*slices, middle, *[(60 + i, t) for i, t in slices], (90, prose(7400, 10) + " " + " ".join(shared))]
    got = {r.doc_id: r for r in passages.find_passages(docs_of(rows)).collect()}
    assert 90 in got and (got[90].start_word, got[90].end_word, got[90].sources) == (10, 70, [50]) and got[90].identity == 1.0


def test_windows_that_cross_the_end_of_a_run():
    rng = np.random.default_rng(4)
    d = rng.integers(-99, 99, 140).astype(np.int32)
    a = np.concatenate([rng.integers(100, 200, 30), d[20:65], rng.integers(200, 300, 30)]).astype(np.int32)
    at, hashes = passages.crossing(d, a, [(30, 40)])
    assert at.tolist() == [p for p in range(10, 26) if any(20 <= p + i and p + i + 40 <= 65 for i in range(11))] and len(set(hashes.tolist())) == len(at)
    again, same = passages.crossing(np.concatenate([[7] * 3, d]).astype(np.int32), a, [(33, 40)])
    assert again.tolist() == (at + 3).tolist() and same.tolist() == hashes.tolist()
    assert not len(passages.crossing(d, d.copy(), [(3, 3)])[0]) and not len(passages.crossing(d[:40], a, [(30, 40)])[0])


def test_passages_do_not_depend_on_the_order_of_rows(docs_of, prose):
    rows = [(7, prose(1, 80) + " " + prose(2, 30)), (7, prose(3, 20) + " " + prose(1, 80)), (8, prose(1, 80)), (None, prose(1, 60)), *[(9, prose(4, 70))] * 2]
    show = lambda df: sorted(map(repr, passages.find_passages(df).collect()))
    assert show(docs_of(rows)) == show(docs_of(rows[::-1])) == show(docs_of(rows).repartition(5)) and len(show(docs_of(rows))) == 4


def test_round_trips_by_units(monkeypatch):
    """Texts are decoded as a whole only where a unit's own ids do not decode to it."""
    p = pieces.Pieces(pieces.MODEL)
    decoded = []
    whole = p.decode
    monkeypatch.setattr(p, "decode", lambda ids: decoded.append(len(ids)) or whole(ids))
    for t in ("", "the cat sat  on the mat\n", "naïve 中文 🙂 " * 9, "x\ud800y the cat", "literal ▁ blank", "\x00\t", "w" * 60 + " " + "z" * 60):
        s = pieces.normalise(t)
        for _ in range(2):
            cost, ids, same = p.checked(s)
            assert (cost, ids) == p.encode(s) and same == (whole(ids) == s)
    p.checked(s := pieces.normalise("the cat sat on the mat"))
    decoded.clear()
    assert p.checked(s)[2] and not decoded


def test_cutting_overlapping_ranges(docs_of, spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = with_clashes(docs_of([(1, words), (2, None), (None, words)]))
    h = docs.where("doc_id = 1").select(F.xxhash64("text")).first()[0]
    found = spark.createDataFrame([(1, 2, 8, h), (1, 3, 5, h), (1, 6, 10, h), (1, 18, 20, h)], "doc_id long, start_word long, end_word long, text_hash long")
    got = {r.doc_id: r for r in passages.cut_passages(docs, found).collect()}
    assert got[1].text.split() == [f"w{i}" for i in [0, 1, *range(10, 18)]] and got[None].text == words and got[2].text is None
    assert got[1]["_cut"] == "kept _cut" and set(got[1].asDict()) == set(docs.columns)


# ---- near join ------------------------------------------------------------------------------------------------------


def test_a_chained_group_is_compared_by_proposed_pairs_only(docs_of, prose, monkeypatch):
    """Each text shares most shingles with the next, so that all are connected; comparisons grow with the pairs proposed."""
    words = prose(9000, 700).split()
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(150)]
    got = {r.doc_id: r for r in nearjoin.jaccard_join(docs_of(rows), block_shingles=1500).collect()}
    whole = {r.doc_id: r for r in nearjoin.jaccard_join(docs_of(rows)).collect()}
    s = [set(tuple(t.split()[i : i + 5]) for i in range(96)) for _, t in rows]
    for i in range(150):
        want = sum(len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in range(150) if j != i)
        assert got[i].n_links == whole[i].n_links == want and got[i].class_id == whole[i].class_id == 0
    block = nearjoin.Block(list(range(150)), [t for _, t in rows], [1] * 150, nearjoin._coefficients(140), 5)
    proposed = sum(len(block.sharing(c)) for c in block.cells)
    assert proposed < 0.25 * 150 * 150


# ---- embeddings -----------------------------------------------------------------------------------------------------


def test_links_count_on_both_sides(spark):
    rng = np.random.default_rng(17)
    n = 3000
    a = rng.normal(size=(n, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9505, 0.96, n)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise])
    x = np.concatenate([x, x[:5], x[:2] * 3])  # equal vectors, and parallel ones
    got = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * want.sum()
    members = Counter(r.component_id for r in got.values())
    assert all((got[i].n_links > 0) == (members[got[i].component_id] > 1) for i in range(len(x)))
    pairs = [(i, i + n) for i in range(n) if want[i] == 1 and want[i + n] == 1]
    assert all(got[i].n_links == got[j].n_links for i, j in pairs) and len(pairs) > 2000


def test_recall_is_what_was_asked(spark):
    rng = np.random.default_rng(2)
    index = multiindex.Index(multiindex.unit(rng.normal(size=(6000, 64))), 10_000_000, 0.95, 0.998)
    assert index.recall >= 0.998 and index.parts > 1


def test_workers_need_no_path_to_the_library(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(__import__('pathlib').Path(__file__).parents[2])!r})
from tempora.session import get_session
from tempora.llm.multiindex import near_vectors
s = get_session("local[2]", 2, "2g")
print("ROWS", near_vectors(s.range(64).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> cast(hash(id, i) AS double)) AS embedding")).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS 64" in done.stdout, done.stderr[-2000:]


# ---- sharding -------------------------------------------------------------------------------------------------------


def test_shards_against_a_walk_round_the_ring(docs_of, spark):
    """Row by row: in each round every arc's remaining rows, in order, try the arc's next point."""
    rows = [(i, f"t{i}") for i in range(700)] + [(3, "again")] * 200
    docs, n, vnodes = docs_of(rows), 7, 5
    got = defaultdict(list)
    for r in sharding.shard_rows(docs, n, vnodes=vnodes).collect():
        got[r.doc_id, r["size"], r.text_crc32].append((r.shard, r.slot))
    points = sharding.ring_points(spark, n, vnodes)
    keyed = docs.select("doc_id", sharding.row_size().alias("s"), F.crc32(F.col("text").cast("binary")).alias("c")).withColumn("h", F.xxhash64("doc_id", "s", "c")).collect()
    arcs = defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.h, r.doc_id)):
        arcs[next((i for i, (p, _) in enumerate(points) if p >= r.h), 0)].append((r.doc_id, r.s, r.c))
    room, want, step = sharding.capacities(len(rows), n, 1.0), defaultdict(list), 0
    used = [0] * n
    while any(arcs.values()):
        for a in sorted(arcs):
            shard = points[(a + step) % len(points)][1]
            while arcs[a] and used[shard] < room[shard]:
                want[arcs[a].pop(0)].append((shard, used[shard]))
                used[shard] += 1
        step += 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_million_copies_of_a_row(spark):
    docs = spark.range(0, 1_000_000, 1, 8).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text")).union(spark.range(1000).select("id", F.lit("other")))
    got = sharding.shard_rows(docs).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert len(got) == 40 and sum(r.n for r in got) == 1_001_000 and all(r.n == r.s == r.m + 1 and r.n in (25_025, 25_024, 25_026) for r in got)


def test_movement_at_the_registered_load_factor(docs_of):
    """Exact balance moves more than the ring's own share of 1 / 41, and far less than dealing all rows anew."""
    d = docs_of([(i, f"t{i}") for i in range(4000)])
    a, b = (sharding.shard_rows(d, n) for n in (40, 41))
    moved = a.select("doc_id", F.col("shard").alias("a")).join(b.select("doc_id", F.col("shard").alias("b")), "doc_id").where("a <> b").count()
    assert moved < 0.5 * 4000


# ---- toxicity -------------------------------------------------------------------------------------------------------


def restorer(text):
    cells = np.concatenate([np.bincount(toxicity._ngrams(toxicity._folded(text), k + 1), minlength=b) for k, b in enumerate(toxicity.BUCKETS)])
    return toxicity.Restorer(toxicity.CharModel(cells))


@pytest.mark.parametrize("n", [41, 60, 500, 5000])
def test_chunks_of_any_length_are_read(prose, n):
    r = restorer(prose(1, 3000) + " you are stupid and worthless" * 60)
    words = ("stupid worthless " * (n // 15 + 1)).split()
    glued = "".join(words)[:n]
    assert "".join(r.words(".".join(glued))) == glued and "".join(r.words(" ".join(glued))) == glued
    assert "stupid" in " ".join(r.words(" ".join("x" * (n - 6) + "stupid")))


def test_restore_texts_and_scores_by_hand(docs_of, spark, prose):
    bad = ["grumble", "snarkly"]
    rows = [(i, prose(100 + i, 25) + (" " + " ".join(bad) if i % 3 == 0 else "")) for i in range(240)] + [(500, "kato grumbl3 rimu"), (501, None), (502, ""), (500, "kato grumbl3 rimu"), (None, prose(3, 9)), (503, prose(7, 20_000))]
    docs = with_clashes(docs_of(rows))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    restored = {r.doc_id: r.restored for r in toxicity.restore_texts(docs).collect()}
    assert restored[500] == "kato grumble rimu" and restored[501] == "" and len(restored) == 245
    got = toxicity.score_toxicity(docs, labels).collect()
    again = toxicity.score_toxicity(docs.repartition(7), labels).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_hash or 0)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    scores, others = ({key(r): r.score for r in x} for x in (got, again))
    assert all(scores[k] == pytest.approx(others[k], abs=1e-9) for k in scores)
    by = {r.doc_id: r.score for r in got}
    # A text's score depends on its restored words alone.
    assert by[500] >= 0.5 and by[501] == by[502] < 0.5
    assert all((by[i] >= 0.5) == (i % 3 == 0) for i in range(240))


def test_equal_texts_with_different_labels(docs_of, spark, prose):
    rows = [(i, prose(i % 60, 20) + (" snarkly" if i % 2 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 2 and i < 230)) for i in range(240)], "doc_id long, toxic int")
    a, b = ({r.doc_id: round(r.score, 9) for r in toxicity.score_toxicity(docs_of(x).repartition(n), labels).collect()} for x, n in ((rows, 2), (rows[::-1], 5)))
    assert a == b


# ---- scans ----------------------------------------------------------------------------------------------------------


def test_scans_of_odd_tables(docs_of):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "cc by 4.0"), (2, None), (3, "word " * 30_000)]
    for scan in (licenses.scan_licenses, wordpiece.count_tokens):
        docs = with_clashes(docs_of(rows))
        got = scan(docs).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and scan(docs.limit(0)).count() == 0
        assert [r for r in got if r.doc_id == 1][0] == [r for r in got if r.doc_id == 1][1]
        assert {r.doc_id: r.n_words for r in got}[3] in (30_000, 30_001) and {r.doc_id: r.n_words for r in got}[2] == 0


def test_decoding_of_odd_tables(spark, docs_of, prose):
    ids = spark.createDataFrame([(1, None), (2, []), (None, None)], "doc_id long, ids array<int>").withColumn("_ids", F.lit(3))
    assert {(r.doc_id, r.text) for r in pieces.decode_ids(ids).collect()} == {(1, None), (2, ""), (None, None)}
    assert pieces.decode_ids(ids.limit(0)).count() == 0
    text = prose(5, 4000)
    coded = pieces.encode_texts(with_clashes(docs_of([(1, text), (1, text), (None, text[:70])])), chunk=997)
    assert sorted(r.text for r in pieces.decode_ids(coded).collect()) == sorted([text, text, text[:70]])


# ---- chats ----------------------------------------------------------------------------------------------------------


def test_chats_with_ties_and_without_ids(spark):
    rng = random.Random(12)
    rows = [(None, rng.choice([None, 0, 1]), rng.choice(["user", None]), f"m{rng.randrange(400)}") for _ in range(900)]
    rows += [(1, 0, "user", x) for x in "cab"] + [(2, 0, "user", x) for x in "abc"] + [(2, 1, "user", "d"), (3, None, "user", "long " * 20_000)]
    rows += [(10 + c, t, "user", "hi" if t == 0 else f"{c} {t}") for c in range(30) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_c", "_near", "_h", "_h1", "_pos", "_kept", "_l")})
    got = chat.format_chats(df.repartition(6)).collect()
    shown = {(r.conv_id, r.part): (r.n_turns, r.rendered) for r in got}
    line = lambda r, x: f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n"
    want = {k: (n, "".join(line(*turn) for turn in parts)) for k, (n, parts) in brute_parts(rows).items()}
    assert shown == want and len(got) == len(want)


def brute_parts(rows):
    by = defaultdict(set)
    for c, t, r, x in rows:
        by[c].add((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seen = {c: tuple(v[2:] for v in sorted(s)) for c, s in by.items()}
    first = {}
    for c in sorted(seen, key=lambda v: (v is not None, v or 0)):
        first.setdefault(seen[c], c)
    kept = {c: s for s, c in first.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in seen.values())}
    return {(c, p // 256): (len(s), [(r if a else None, x if b else None) for a, r, b, x in s[p : p + 256]]) for c, s in kept.items() for p in range(0, len(s), 256)}


# ---- the pipeline ---------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, docs_of, prose, tmp_path):
    def make(rows, items=("nothing of the kind stands in any of these texts at all",)):
        docs = with_clashes(docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars"))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_run_applies_all_stages(spark, folder, prose):
    shared, item = prose(7077, 70), prose(8088, 25)
    rows = [(i, prose(i, 60) + (" grumble snarkly blockhead" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(None, prose(900, 30)), (None, prose(901, 30)), (None, None), (200, ""), (201, prose(1, 60)), (202, prose(602, 40) + " " + shared), (203, prose(603, 40) + " " + shared), (204, f"{prose(604, 40)} {item}"), (205, prose(605, 40)), (205, prose(605, 40)), (206, prose(606, 9000))]
    out = corpus_pipeline.run(spark, folder(rows, [item]))
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())
    want = [(True, i) for i in range(120) if i % 4] + [(False, 0)] * 3 + [(True, i) for i in (200, 202, 203, 205, 206)]
    assert got == sorted(want)
    texts = {r.doc_id: r.text for r in pieces.decode_ids(out).collect()}
    assert texts[203].split() == prose(603, 40).split() and texts[206] == prose(606, 9000)


def test_stages_keep_columns_and_take_empty_tables(spark, folder, prose):
    base = folder([(i, prose(i, 60)) for i in range(6)] + [(None, None), (None, "x"), (1, prose(1, 60))])
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, base)
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
            found = out.collect()
            assert all(r[c] == f"kept {c}" for r in found for c in CLASHING), name
            assert len(found) == (0 if rows is not docs else 8 if name == "near_copies" else 9 if name != "repeated_passages" else len(found))
        assert corpus_pipeline.encode(spark, rows, base).count() == rows.count()


def test_crc_of_rows_is_that_of_zlib(docs_of):
    rows = [(1, "é☃"), (2, None), (2, None)]
    assert sorted(r.text_crc32 for r in sharding.shard_rows(docs_of(rows)).collect()) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)


def test_scores_against_a_plain_scorer(docs_of, spark, prose):
    """Every text of a table: restore, look up its words' weights, add them."""
    import math

    rows = [(i, prose(300 + i, 30) + (" you snarkly grumble" if i % 3 == 0 else "")) for i in range(300)] + [(900, "kato g-r-u-m-b-l-e rimu"), (901, None), (902, "snaarkly")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    model_of = toxicity.char_model(docs)
    chosen = docs.join(labels, "doc_id").where(~toxicity.held_out("doc_id")).select("text", "toxic")
    weights = toxicity.fit(chosen, model_of)
    bias, _ = weights.pop("")
    r = toxicity.Restorer(model_of())
    assert weights and all(not k.isdigit() for k in weights)
    for i, t in rows:
        found = [weights[f] for f in toxicity.features(r.words(t)) if f in weights]
        s = max([bias + sum(w for w, _ in found), *(alone for _, alone in found)])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, s))))), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_ngrams_of_a_text_depend_on_nothing_beside_it(docs_of, prose):
    """Counts of long and short texts, in one partition and in many, against those of each text alone."""
    rows = [(1, (prose(7, 4000) + " Äpfel ") * 40), (2, "a"), (3, ""), (4, None), *((i, prose(500 + i, 5).title()) for i in range(5, 300))]
    assert len(rows[0][1]) > 1 << 20
    plain = np.zeros(sum(toxicity.BUCKETS), np.int64)
    base = np.concatenate([[0], np.cumsum(toxicity.BUCKETS)])
    for _, t in rows:
        for k in range(4 if t else 0):
            cp = toxicity._folded("\n\n\n" + t + "\n" * k)
            plain[base[k] : base[k + 1]] += np.bincount(toxicity._ngrams(cp, k + 1), minlength=toxicity.BUCKETS[k])
    for docs in (docs_of(rows).coalesce(1), docs_of(rows).repartition(5)):
        got = {r.cell: r.n for r in toxicity.ngram_counts(docs).collect()}
        assert got == {int(c): int(plain[c]) for c in np.flatnonzero(plain)}
