"""Toxicity with noisy-channel deobfuscation.

Obfuscated writing is undone before it is scored. Suspicious stretches of a text (letters written as digits or signs,
letters drawn apart, letters repeated) become lattices of what each sign may stand for; a Viterbi search under a
character language model, counted over all documents, finds the likeliest reading. A sparse logistic model over the
restored words and their beginnings gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, materialize, ship

ship(__name__)

# Signs and the letters they are written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
# Signs that are put between letters.
APART = ".-_*~^'`·#/\\:,;=&%"

#: n-grams are counted in so many buckets; orders 1 to 4. It bounds the model, whatever the alphabet.
BUCKETS = (1 << 12, 1 << 16, 1 << 18, 1 << 19)
BACKOFF = 6.0
#: Costs and readings that a worker remembers; beyond it the memory starts anew. It bounds memory, not results.
REMEMBERED = 100_000
#: Characters whose n-grams are counted at a time. It bounds memory, not results.
STRETCH = 1 << 16
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1", re.S)
_SIGNS = re.compile(r"^(?:([^\w\s])\1+)+|(?:([^\w\s])\2+)+$")  # a run of one sign at an edge is noise, not a letter
_PARTED = re.compile(rf"[^\W\d_][{re.escape(APART)}]+[^\W\d_]")
_MIXED = re.compile(r"[^\W\d_]")


def _folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for all that is no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (cp >= 97) & (cp <= 122) | (cp >= 0xC0) & (cp != 0xD7) & (cp != 0xF7)
    return np.where(letters, cp, 0).astype(np.uint64)


def _ngrams(cp: np.ndarray, order: int) -> np.ndarray:
    """Buckets of all n-grams of this order."""
    n = len(cp) - order + 1
    h = cp[:n].copy()
    for k in range(1, order):
        h = (h * np.uint64(MIX[k - 1]) + cp[k : n + k]) & np.uint64(0xFFFFFFFF)
    h ^= h >> np.uint64(15)
    return (h % np.uint64(BUCKETS[order - 1])).astype(np.int64)


def add_ngrams(texts: list[str], total: list[np.ndarray], stretch: int = STRETCH) -> None:
    """Add the n-grams of texts to `total`, those that begin in one stretch at a time.

    Each text has three line ends around it, so no n-gram spans two: counts depend neither on neighbours nor stretches.
    """
    whole = "".join([x for t in texts for x in ("\n\n\n", t)]).lower()
    size, whole = len(whole), whole + "\n\n\n"
    for at in range(0, size, stretch):
        n = min(stretch, size - at)
        cp = _folded(whole[at : at + n + 3])
        for k in range(4):
            np.add.at(total[k], _ngrams(cp[: n + k], k + 1), 1)


def ngram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cell, n): counts of character n-grams over all documents; summed per task before the shuffle."""
    base = np.concatenate([[0], np.cumsum(BUCKETS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b, np.int64) for b in BUCKETS]
        for b in by_few(batches):
            add_ngrams([t for t in b.column(0).to_pylist() if t], total)
        cells = [np.flatnonzero(t) for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c + base[k] for k, c in enumerate(cells)])), pa.array(np.concatenate([total[k][c] for k, c in enumerate(cells)]))], ["cell", "n"]
        )

    counted = docs.select(F.col(text)).mapInArrow(run, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


class CharModel:
    """A character language model of order 4 with interpolated backoff; log probabilities are remembered."""

    def __init__(self, counts: np.ndarray):
        base = np.concatenate([[0], np.cumsum(BUCKETS)])
        self.counts = [counts[base[k] : base[k + 1]] for k in range(4)]
        self.total = max(1, int(self.counts[0].sum()))
        self.known: dict[str, float] = {}

    def _count(self, gram: str) -> int:
        h = 0
        for k, c in enumerate(gram):
            v = 0 if c == " " else ord(c)
            h = v if not k else (h * MIX[k - 1] + v) & 0xFFFFFFFF
        h ^= h >> 15
        return int(self.counts[len(gram) - 1][h % BUCKETS[len(gram) - 1]])

    def cost(self, past: str, c: str) -> float:
        """-log P(c | past), past being up to three characters."""
        if (got := self.known.get(past + c)) is None:
            p = (self._count(c) + 0.1) / (self.total + 10.0)
            for k in range(1, len(past) + 1):
                p = (self._count(past[-k:] + c) + BACKOFF * p) / (self._count(past[-k:]) + BACKOFF)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[past + c] = -math.log(min(1.0, p))
        return got

    def read(self, slots: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading of a lattice: each slot offers (letters, channel cost). Exact Viterbi over histories."""
        best: dict[str, tuple[float, tuple]] = {" ": (0.0, ())}  # a reading is (reading before, letters): long ones share their beginnings
        for slot in slots:
            after: dict[str, tuple[float, tuple]] = {}
            for past, (spent, out) in best.items():
                for letters, cost in slot:
                    h, s = past, spent + cost
                    for c in letters:
                        s += self.cost(h, c)
                        h = (h + c)[-3:]
                    if h not in after or s < after[h][0]:
                        after[h] = (s, (out, letters) if letters else out)
            best = after
        _, out = min(((s + self.cost(h, " "), out) for h, (s, out) in best.items()), key=lambda x: x[0])
        read = []
        while out:
            out, letters = out
            read.append(letters)
        return "".join(reversed(read))


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """What each sign of a lower-cased chunk may stand for, with channel costs."""
    slots: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", chunk, re.S):
        c, n = m[1], len(m[0])
        if c in LEET:
            slots += [[(x, 0.7) for x in LEET[c]] + ([("", 2.5)] if not c.isdigit() else [])] * min(n, 2)
        elif c in APART or c.isspace():
            slots.append([("", 0.7), (" ", 0.7)])
        elif n >= 3:
            slots.append([(c, 0.5), (c + c, 0.7)])
        elif n == 2 and c.isalpha():
            slots.append([(c + c, 0.0), (c, 2.5)])
        else:
            slots += [[(c, 0.0)]] * n
    return slots


class Restorer:
    """Restores whole texts to words; remembers the readings of short chunks."""

    def __init__(self, model: CharModel, remembered: int = REMEMBERED):
        self.model, self.known, self.remembered = model, {}, remembered

    def _read(self, chunk: str) -> list[str]:
        if (got := self.known.get(chunk)) is None:
            got = _WORD.findall(self.model.read(lattice(chunk)))
            if len(chunk) > 64:
                return got
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[chunk] = got
        return got

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        lone: list[str] = []  # single characters in a row: letters drawn apart

        def flush() -> None:
            if len(lone) >= 3 and sum(c.isalpha() for c in lone) >= 2:
                out.extend(self._read(" ".join(lone)))
            else:
                out.extend(c for c in lone if c.isalpha())
            lone.clear()

        for chunk in (text or "").lower().split():
            if chunk.isalpha() and not _RUN.search(chunk):
                if len(chunk) == 1:
                    lone.append(chunk)
                    continue
                if lone:
                    flush()
                out.append(chunk)
                continue
            if len(chunk) == 1:
                lone.append(chunk)
                continue
            if lone:
                flush()
            chunk = _SIGNS.sub("", chunk)
            for part in chunk.split():
                core = part.strip(".,;:?!\"'()[]{}*&%#~^|<>“”«»")
                if core.isalpha() and not _RUN.search(core):
                    out.append(core)
                elif not _MIXED.search(core):
                    out.extend(_WORD.findall(core))
                elif _suspicious(core):
                    out.extend(self._read(part if part[-1:] in "!$@|+(" or part[:1] in "!$@|+(" else core))
                else:
                    out.extend(_WORD.findall(core))
        flush()
        return out


def _suspicious(core: str) -> bool:
    """Letters mixed with signs that stand for letters, letters twice in a row, or letters set apart by signs."""
    return bool(_RUN.search(core) or any(c in LEET for c in core) or _PARTED.search(core))


def features(words: list[str]) -> set[str]:
    """Presence of words and of their first 4, 5 and 6 letters (marked with a star)."""
    found = set(words)
    for k in (4, 5, 6):
        found |= {w[:k] + "*" for w in set(words) if len(w) > k}
    return found


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(sample: DataFrame, model_of, *, width: int = 4096, least: int = 5) -> dict[str, tuple[float, float]]:
    """Fit a sparse logistic model on (text, toxic): feature -> (weight, logit when it stands alone), "" -> intercept.

    The `width` features with the largest likelihood ratio enter; an L1 penalty leaves few of them. Signs of toxicity
    come together in the sample, so weights alone underrate a text with one sign: its own smoothed odds are kept too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model_of())
        for b in by_few(batches):
            found = [list(features(restorer.words(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1), b.column(2)], ["f", "toxic", "id"])

    # Equal texts count once, as toxic if one of them is.
    seen = sample.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("id", F.xxhash64("text"))
    rows = materialize(seen.mapInArrow(run, "f array<string>, toxic int, id long"))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {"": (4.0 if n1 and not n0 else -4.0, 0.0)}
    a, b = F.col("a"), F.col("b")
    ratio = lambda x, m: F.when(x > 0, x * F.log(x * (n1 + n0) / ((a + b) * m))).otherwise(0.0)
    counted = rows.select(F.explode("f").alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    top = counted.where(a + b >= least).where(a * n0 > 2 * b * n1).withColumn("g", ratio(a, n1) + ratio(b, n0)).where("g > 12")
    rare = max(6.0, 0.003 * n0)
    # Only a sign that 19 of 20 texts with it bear out may decide alone.
    alone = {r.w: math.log((r.a + 0.5) / (r.b + rare)) if r.a >= 19 * (r.b + 1) else -30.0 for r in top.orderBy(F.desc("g"), "w").limit(width).collect()}
    names = list(alone)
    index = {w: i for i, w in enumerate(names)}
    kept = F.filter("f", lambda w: w.isin(names)) if len(names) <= 64 else F.array_intersect("f", F.lit(names))
    data = [([index[w] for w in r.f], r.toxic) for r in rows.select(kept.alias("f"), "toxic", "id").orderBy("id").collect()]
    *weights, bias = _logistic(data, len(names))
    return {n: (w, alone[n]) for n, w in zip(names, weights, strict=True) if w} | {"": (bias, 0.0)}


def _logistic(data: list[tuple[list[int], int]], width: int, penalty: float = 1.5e-3, rows: float = 4.0) -> list[float]:
    """Sparse logistic regression; the bias comes last.

    An L1 penalty chooses the features: each has to explain `rows` rows, or the share `penalty` of them if that is
    more. What is chosen is fitted again under a slight L2 penalty, which undoes the shrinking.
    """
    at = np.repeat(np.arange(len(data)), [len(f) for f, _ in data])
    col = np.array([c for f, _ in data for c in f], np.int64)
    y = np.array([t for _, t in data], float)
    lr = 8.0 / max(1.0, float(np.quantile(np.bincount(at, minlength=len(data)), 0.99)))

    def descend(use: np.ndarray, l1: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
        """Proximal gradient steps with momentum."""
        w, b, vw, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
        for k in range(rounds):
            uw, ub = w + k / (k + 3) * vw, b + k / (k + 3) * vb
            p = 1 / (1 + np.exp(-np.clip(np.bincount(at, uw[col], len(data)) + ub, -30, 30)))
            e = (p - y) / len(data)
            nw = uw - lr * (np.bincount(col, e[at], width) + l2 * uw)
            nw = np.where(use, np.sign(nw) * np.maximum(np.abs(nw) - lr * l1, 0), 0.0)
            nb = ub - lr * e.sum()
            vw, vb, w, b = nw - w, nb - b, nw, nb
        return w, b

    w, _ = descend(np.ones(width, bool), max(penalty, rows / len(data)), 0.0, 500)
    w, b = descend(w > 0, 0.0, 1.0 / len(data), 500)
    return [*map(float, w), float(b)]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """Score every whole text: (key, held_out, score, predicted, n_restored, text_hash).

    The language model counts all documents. The classifier is fitted on at most `fit_rows` labelled rows (those of
    the smallest hash), none of which is held out; labels and keys choose those rows and are no inputs of a score.
    A null or empty text gets the score of a text without signs of toxicity. A null key counts as "" for `held_out`
    and has no label; of several labels for a key the largest counts, null labels are none. Repeated rows are scored
    alike (`text_hash` tells rows of one key apart), an empty table gives none, without labels every score is that of the intercept. `n_restored` counts the
    words after restoring. Only the named columns are read, whatever else the tables hold.
    """
    spark = docs.sparkSession
    model_of = char_model(docs, text)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("toxic"))
    known = known.where(~held_out("_key"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
    sample = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_key").select("text", "toxic")
    shared = spark.sparkContext.broadcast(fit(sample, model_of))  # at most `width` features
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tv"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weights = Restorer(model_of()), dict(shared.value)
        bias, _ = weights.pop("")
        lengths = sorted({len(x) - 1 for x in weights if x.endswith("*")})
        for b in by_few(batches):
            scores, sizes = [], []
            for t in b.column(1).to_pylist():
                words = restorer.words(t)
                seen = set(words)
                hits = seen & weights.keys()
                for k in lengths:
                    hits |= {x[:k] + "*" for x in seen if len(x) > k} & weights.keys()
                found = [weights[x] for x in sorted(hits)]
                s = max([bias + sum(w for w, _ in found), *(one for _, one in found)])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), b.column(2)], ["_key", "score", "n_restored", "text_hash"])

    scored = rows.mapInArrow(run, f"_key {kind}, score double, n_restored long, text_hash long")
    return scored.select(
        F.col("_key").alias(key), held_out("_key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_restored", "text_hash"
    )


def char_model(docs: DataFrame, text: str = "text"):
    """Count the corpus; return a function that gives the model on a worker. The counts have a fixed number of cells."""
    counts = np.zeros(sum(BUCKETS), np.int64)
    counted = ngram_counts(docs, text).toArrow()  # as many rows as cells at most
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    return lambda: CharModel(shared.value)


def restore_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The restored text of every document: (key, restored); null texts come back empty."""
    model_of = char_model(docs, text)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model_of())
        for b in by_few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(restorer.words(t)) for t in b.column(1).to_pylist()], pa.string())], ["_key", "restored"])

    return rows.mapInArrow(run, f"_key {kind}, restored string").withColumnRenamed("_key", key)
