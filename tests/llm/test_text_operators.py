import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from tempora.llm import chat, licenses, pieces, sharding, templates, toxicity, wordpiece

ODD = [(None, "no key"), (1, None), (2, ""), (3, "   \n\t "), (4, "é☃ \U0001f600 ﷽"), (4, "é☃ \U0001f600 ﷽"), (5, "a " * 3000), (6, "x" * 5000)]


# ---- sharding -------------------------------------------------------------------------------------------------------


def test_shards_hold_their_law(docs_of):
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "same")] * 150 + [(None, f"n{i}") for i in range(20)] + ODD
    got = sharding.shard_rows(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_shards_of_nothing_and_movement(docs_of, spark):
    assert sharding.shard_rows(docs_of([(1, "a")]).limit(0)).count() == 0
    d = docs_of([(i, f"t{i}") for i in range(2000)])
    a, b = (sharding.shard_rows(d, n, load_factor=1.25) for n in (20, 21))
    assert max(r["count"] for r in a.groupBy("shard").count().collect()) <= 125
    moved = a.select("doc_id", F.col("shard").alias("a")).join(b.select("doc_id", F.col("shard").alias("b")), "doc_id").where("a <> b").count()
    assert moved < 0.25 * 2000


def test_settling_is_first_come_clockwise():
    rng = random.Random(3)
    points = sorted((rng.random(), s) for s in range(5) for _ in range(4))
    counts = {a: rng.randint(0, 9) for a in range(20)}
    room = sharding.capacities(sum(counts.values()), 5, 1.0)
    dealt = sharding.settle(points, counts, room)
    used = [0] * 5
    for a, runs in dealt.items():
        assert [r[0] for r in runs][0] == 0 and all(x[1] == y[0] for x, y in zip(runs, runs[1:])) and runs[-1][1] == counts[a]
        for lo, hi, s, _ in runs:
            used[s] += hi - lo
    assert used == room


# ---- licenses -------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, v) for p, v in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({v for _, v in places}))


def test_licenses(docs_of):
    notice = licenses.TEMPLATES["isc-text"].replace("<<opt>>or<<end>> ", "or ").replace("<<var 8>>", "the author").capitalize()
    assert notice.count("hereby") == 1 and "<" not in notice
    rows = [*ODD, (10, "Licensed under the Apache License, Version 2.0."), (11, "apache license 2.0 and MIT-License, cc by cc-by-nc 4.0"), (12, notice), (13, notice.replace("hereby", "")), (15, notice.replace("performance of this software", "performance of it")), (14, "xapache license mit licenses GNU general PUBLIC License ")]
    got = {}
    for r in licenses.scan_licenses(docs_of(rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t), i
    assert got[10].labels == "apache,apache-2.0" and got[10].score == 1.0
    assert got[11].labels == "apache,apache-2.0,cc-by,cc-by-nc-4.0,mit"
    assert got[15].labels == ""
    assert got[12].labels == "isc-text" and got[13].labels == "" and got[13].score == 0.0 and got[14].labels == "gpl"


def test_automaton_regions():
    a = licenses.Automaton("start <<opt>>maybe this<<end>> middle <<var 3>> end")
    w = lambda s: licenses.words_of(s)
    for good in ("start middle end", "x start maybe this middle a b c end y", "start middle end end"):
        assert a.accepts(w(good)), good
    for bad in ("start maybe middle end", "start middle a b c d end", "start end", ""):
        assert not a.accepts(w(bad)), bad


# ---- token counts ---------------------------------------------------------------------------------------------------


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_longest_match_against_greedy():
    rng = random.Random(5)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        machine = wordpiece.LongestMatch(vocabulary)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert machine.count(w) == greedy(w, vocabulary, 5), (vocabulary, w)


def test_token_counts(docs_of, prose):
    import regex

    vocabulary = set(wordpiece.load_vocabulary())
    rows = [*ODD, (20, "Hello  world!\n\nIt's 12345 cafés " + prose(1, 200))]
    got = {r.doc_id: r for r in wordpiece.count_tokens(docs_of(rows)).collect()}
    for i, t in rows:
        words = [w.encode() for w in regex.findall(wordpiece.WORDS, t or "")]
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(w, vocabulary, 130) for w in words)), i


# ---- encoding -------------------------------------------------------------------------------------------------------


def library(path=pieces.MODEL):
    """The library's own unigram search over the same pieces and scores."""
    p = pieces.Pieces(path)
    vocabulary = [("<unk>", 0.0)]
    for piece, (cost, _) in ((x, n) for x, n in _leaves(p.trie)):
        vocabulary.append((piece, -(cost >> pieces.TIE) / pieces.SCALE))
    return p, tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, False))


def _leaves(node, prefix=""):
    for c, below in node.items():
        if c == "":
            yield prefix, below
        else:
            yield from _leaves(below, prefix + c)


def test_scores_equal_the_librarys(prose):
    p, t = library()
    scores = {x: -(c >> pieces.TIE) for x, (c, _) in _leaves(p.trie)}
    for seed in range(20):
        s = pieces.normalise(prose(seed, 30) + " The end, with (signs) and 1234.")
        found = sum(scores[x.value if hasattr(x, "value") else x] for x in t.encode(s).tokens)
        assert abs(found + (p.encode(s)[0] >> pieces.TIE)) <= 2


def test_chunks_do_not_change_results():
    p, rng = pieces.Pieces(pieces.MODEL), random.Random(2)
    for _ in range(60):
        s = pieces.normalise("".join(rng.choice(["ab", " ", "   ", "the ", "\n", "aaaa", "é", "☃", "tion", "%%", "=="]) for _ in range(rng.randint(1, 60))))
        cost, ids = p.encode(s)
        assert p.decode(ids) == s
        for size in (1, 5, 17, 64):
            parts = list(pieces.split(s, size, p.width))
            matrices = [pieces.transfer(p, c, n, r) for _, c, n, r in parts]
            at = pieces.states(matrices, 0, 0)
            assert b"".join(pieces.trace(p, c, n, r, at[k], at[k + 1]) for k, c, n, r in parts) == ids
            whole = matrices[0]
            for m in matrices[1:]:
                whole = pieces.combine(whole, m)
            assert whole[0, 0] >> pieces.TIE == cost >> pieces.TIE


def test_encode_and_decode(docs_of, prose):
    rows = [*ODD, (20, prose(1, 900)), (20, prose(2, 900)), (21, "%" * 4000 + " end"), (22, "under▁score")]
    got = pieces.encode_texts(docs_of(rows), chunk=512)
    whole = pieces.encode_texts(docs_of(rows), chunk=1 << 20)
    show = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids), round(r.score, 3), r.round_trip) for r in df.collect())
    assert show(got) == show(whole) and all(x[3] for x in show(got)) and len(show(got)) == len(rows)
    back = pieces.decode_ids(got.select("doc_id", "ids")).collect()
    assert sorted(r.text for r in back) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert pieces.encode_texts(docs_of(rows).limit(0)).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def insults(docs_of, spark, prose):
    rng = random.Random(8)
    bad = ["grumble", "snarkly", "blockhead"]
    rows, labels = [], []
    for i in range(400):
        words = prose(1000 + i, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, "kato gr4mbl3 rimu"), (1001, "kato b l o c k h e a d rimu"), (1002, "kato snnnnarkly rimu"), (1003, prose(9, 40)), *ODD[:4]]
    return rows, spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(docs_of, insults):
    rows, labels = insults
    got = [r for r in toxicity.score_toxicity(docs_of(rows), labels).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [by[i] for i in range(400) if by[i].held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert by[1001].predicted == 1 and by[1002].predicted == 1 and by[1003].predicted == 0
    assert by[2].score == by[3].score < 0.5  # few words, no sign
    assert toxicity.score_toxicity(docs_of(rows), labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs_of(rows).limit(0), labels).count() == 0


def test_restoring(docs_of, insults):
    rows, _ = insults
    text = " ".join(t or "" for _, t in rows[:400]) + " idiot stupid loser"
    cells = np.zeros(sum(toxicity.BUCKETS), np.int64)
    base = np.concatenate([[0], np.cumsum(toxicity.BUCKETS)])
    cp = toxicity._folded(text)
    for k in range(4):
        cells[base[k] : base[k + 1]] = np.bincount(toxicity._ngrams(cp, k + 1), minlength=toxicity.BUCKETS[k])
    r = toxicity.Restorer(toxicity.CharModel(cells))
    assert r.words("an 1d10t l0$er s.t.u.p.i.d i d i o t stuuupid") == ["an", "idiot", "loser", "stupid", "idiot", "stupid"]
    assert r.words("plain words, kept!! 12 %% a@b") [:3] == ["plain", "words", "kept"]
    assert r.words(None) == [] and r.words("") == []


def test_restoring_long_and_partly_changed_words(insults):
    rows, _ = insults
    text = " ".join(t or "" for _, t in rows[:400]) + " you are stupid and worthless asshole hello idiot" * 60
    cells = np.concatenate([np.bincount(toxicity._ngrams(toxicity._folded(text), k + 1), minlength=b) for k, b in enumerate(toxicity.BUCKETS)])
    r = toxicity.Restorer(toxicity.CharModel(cells))
    whole = ["you", "are", "stupid", "and", "worthless"]
    assert "".join(r.words(".".join("youarestupidandworthless"))) == "".join(whole)
    assert r.words("stu" + "u" * 40 + "pid") == ["stupid"]
    assert "".join(r.words(" ".join("stupidworthless" * 8))) == "stupidworthless" * 8
    for spelled, word in (("a$$hole", "asshole"), ("s--t--u--p--i--d", "stupid"), ("stuupid", "stupid"), ("wortthless", "worthless"), ("st.upid", "stupid"), ("wor-thless", "worthless"), ("hello", "hello")):
        assert r.words(spelled) == [word]


def test_lattice_search_is_exact():
    rng = random.Random(4)
    m = toxicity.CharModel(np.array([rng.randrange(9) for _ in range(sum(toxicity.BUCKETS))]))
    for _ in range(20):
        slots = [[(rng.choice("abc "), rng.random()), (rng.choice(["", "a", "bc"]), rng.random())] for _ in range(6)]

        def cost(path):
            h, s = " ", 0.0
            for letters, c in path:
                s += c
                for x in letters:
                    s += m.cost(h, x)
                    h = (h + x)[-3:]
            return s + m.cost(h, " ")

        import itertools

        best = min(itertools.product(*slots), key=cost)
        out = m.read(slots)
        assert min(cost(p) for p in itertools.product(*slots) if "".join(x for x, _ in p) == out) == pytest.approx(cost(best))


# ---- templates and chats --------------------------------------------------------------------------------------------


def test_leaks(docs_of, spark, prose):
    q = "Ask how far Alice Smith travels in 5 km if she walks 12 hours each day and rests on 5 of them before reaching home"
    bench = spark.createDataFrame([(1, q), (2, prose(3, 20)), (3, None), (4, ""), (5, "too short item"), (6, prose(3, 20))], "item_id long, text string")
    renamed = q.replace("Alice Smith", "Bob Jones").replace(" 5 ", " 7 ").replace("12", "9.5")
    torn = q.replace("in 5 km", "in 8 km")  # one value of the item became two
    rows = [*ODD, (10, prose(5, 50) + " " + q + " " + prose(6, 50)), (11, prose(7, 30) + ". " + renamed), (12, torn), (13, prose(8, 80)), (14, prose(3, 20).upper()), (15, "it is too short item here"), (10, "other text")]
    got = {(r.doc_id, r.item_id): r for r in templates.find_leaks(docs_of(rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 2), (14, 6), (15, 5)}
    assert got[11, 1].n_slots >= 4 and got[14, 2].coverage == 1.0
    assert templates.find_leaks(docs_of(rows), bench.limit(0)).count() == 0
    assert templates.find_leaks(docs_of(rows).limit(0), bench).count() == 0


def test_leaks_with_names_that_begin_sentences(docs_of, spark):
    q = "Alice has 3 apples and buys some more at noon. Alice gives a few to the old man nearby. Carol sells the rest of them for 9 coins. Alice counts what is left of it now."
    bench = spark.createDataFrame([(1, q)], "item_id long, text string")
    renamed = q.replace("Alice", "Bob").replace("Carol", "Dave").replace("3", "5")
    rows = [(1, q), (2, renamed), (3, "Words before it. " + renamed), (4, q.replace("Alice gives", "Bob gives").replace("Carol", "Eve").replace("Alice counts", "Dan counts"))]
    got = {r.doc_id: r for r in templates.find_leaks(docs_of(rows), bench).collect()}
    assert {1, 2, 3} <= set(got) and got[2].coverage == 1.0 and got[2].n_slots >= 3


def test_leaks_of_items_with_few_literal_words(docs_of, spark):
    items = ["What is 12 + 15 * 3?", "Solve 12 x + 7 = 43", "1 2 3 4 5 6 7 8 9 10"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = [(i, f"kato rimu. {q} Selo mune.") for i, q in enumerate(items)] + [(10, "What is 13 + 15 * 3?"), (11, "solve 12 y + 7 = 43"), (12, None)]
    got = {(r.doc_id, r.item_id): r.coverage for r in templates.find_leaks(docs_of(rows), bench).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}


def test_large_benchmark_is_not_broadcast(docs_of, spark, prose, monkeypatch):
    q = "Ask how far Alice Smith travels in 5 km if she walks 12 hours each day and rests on 5 of them before reaching home"
    bench = spark.createDataFrame([(2, prose(3, 20)), (3, q), (4, "too short item"), (5, "What is 12 + 15 * 3?")], "item_id long, text string")
    rows = [(1, prose(3, 20)), (2, f"{prose(50, 10_000)}. {q.replace('12', '9.5').replace('Alice Smith', 'Bob Jones')} {prose(51, 10_000)}"), (None, q), (None, q), (3, "it is too short item here"), (4, "so: what is 12 + 15 * 3?"), *ODD]
    show = lambda: sorted(map(repr, templates.find_leaks(docs_of(rows), bench).collect()))
    sent = show()
    monkeypatch.setattr(templates, "BROADCAST", 0)
    assert show() == sent and len(sent) == 5


def brute_chats(rows):
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seen = {c: tuple((v[2:]) for v in sorted(turns)) for c, turns in by.items()}
    kept = {}
    for c, s in seen.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seen.values()):
            kept.setdefault(s, []).append(c)
    out = {}
    for s, cs in kept.items():
        c = min(cs, key=lambda v: (v is not None, v or 0))
        for p in range(0, len(s), chat.BLOCK):
            part = s[p : p + chat.BLOCK]
            out[c, p // chat.BLOCK] = (len(s), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, _, x in part))
    return out


def test_chats(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        n = rng.randint(1, 6)
        rows += [(c, t + c % 2, "user" if t % 2 == 0 else "assistant", rng.choice("ab")) for t in range(n)]
    rows += [(100, t, "user", str(t)) for t in range(600)] + [(101, t, "user", str(t)) for t in range(300)] + [(102, 0, None, None), (103, 0, "", ""), (None, 1, "user", "lost"), (104, None, "user", "x"), (104, 1, "user", "y")]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_c", F.lit(1)).withColumn("part", F.lit(2))
    got = {(r.conv_id, r.part): (r.n_turns, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == brute_chats(rows) and (101, 0) not in got and (100, 2) in got
    assert chat.format_chats(df.limit(0)).count() == 0
