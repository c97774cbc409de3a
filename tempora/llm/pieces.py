"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into the pieces of the largest total score (the unigram model's Viterbi path). Giant texts are split into
chunks. A piece may stick out of its chunk by some characters: that number is the state at the boundary. Each chunk
yields a matrix of the best score from every entry state to every exit state; matrices combine associatively, in two
levels, which settles all boundary states; then every chunk is backtraced on its own. Scores are integers, so the split
cannot change a result. Scores stand for log probabilities; here costs, their negatives, are minimised.
"""

from __future__ import annotations

import math
import pickle
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, materialize, ship

ship(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SCALE = 1 << 16
#: A cost is (negative log probability) << TIE, plus a number that depends on where pieces end: equal scores are told
#: apart by it, in the same way however a text is split.
TIE = 44
REMEMBERED = 100_000  # units that a worker remembers, of the latest twice as many at most
BLOCK = 64  # chunks whose matrices are combined in one step

#: No piece joins Latin letters to anything but blanks before them, goes on after a blank or holds a line end: a unit
#: is what lies between such places. It is checked when a model is loaded.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNIT = re.compile(f"\n|{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}\n{LETTERS}]+|{SPACE}+")
_LETTER = re.compile(f"[{LETTERS}]")


def tie(at: int) -> int:
    """20 bits for a piece that ends `at` characters into its unit."""
    return (at * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44


_TIES = [tie(i) for i in range(4096)]


class Pieces:
    """The pieces of a model file. Its own scores rank merges; the probability of a piece follows Zipf's law by rank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.trie: dict = {}
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.width = 1
        size = model.get_piece_size()
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
                continue
            if len(_UNIT.findall(piece)) != 1:
                raise ValueError(f"piece {piece!r} spans two units")
            self.bytes_of.append(piece.encode())
            self.width = max(self.width, len(piece))
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (round(math.log(i + 2) * SCALE) << TIE, np.int32(i).tobytes())
        self.unknown = round((math.log(size + 1) + 10) * SCALE) << TIE
        self.single = {c for c, node in self.trie.items() if "" in node}
        self.known: dict[str, tuple[int, bytes]] = {}
        self.older: dict[str, tuple[int, bytes]] = {}
        self.faulty = 0  # units met so far whose ids do not decode to them; they are not remembered

    def forward(self, s: str, a: int, rel: int, n: int, stop: int) -> tuple[list[int | None], list]:
        """Least costs from position a of s, and how they are reached; pieces start before n and end by `stop`.

        Lists start at a; rel is a's place in its unit.
        """
        s, n = s[a:stop], min(n, stop) - a
        size, trie, best, back = len(s), self.trie, [None] * (len(s) + 1), [None] * (len(s) + 1)
        ties = _TIES[rel : rel + size + 1] if rel + size < len(_TIES) else [tie(rel + i) for i in range(size + 1)]
        best[0] = 0
        for i in range(n):
            if (spent := best[i]) is None:
                continue
            node, j = trie, i
            while j < size:
                if (node := node.get(s[j])) is None:
                    break
                j += 1
                if "" in node:
                    cost, ids = node[""]
                    cost += spent + ties[j]
                    if (old := best[j]) is None or cost < old:
                        best[j], back[j] = cost, (i, ids)
            if s[i] not in self.single:
                cost = spent + self.unknown + ties[i + 1]
                if (old := best[i + 1]) is None or cost < old:
                    ids = [self.byte_id[b] for b in s[i].encode("utf-8", "surrogatepass")]
                    best[i + 1], back[i + 1] = cost, (i, np.array(ids, np.int32).tobytes())
        return best, back

    def span(self, s: str, a: int, b: int, rel: int, n: int) -> tuple[int, bytes]:
        """(cost, ids) of the best path from a to b."""
        best, back = self.forward(s, a, rel, n, b)
        at, out = b - a, []
        while at:
            at, ids = back[at]
            out.append(ids)
        out.reverse()
        return best[-1], b"".join(out)

    def unit(self, u: str) -> tuple[int, bytes]:
        if (got := self.known.get(u)) is None:
            if (got := self.older.get(u)) is None:
                got = self.span(u, 0, len(u), 0, len(u))
                if self.decode(got[1]) != u:
                    self.faulty += 1
                    return got
            if len(u) <= 48:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[u] = got
        return got

    def encode(self, s: str) -> tuple[int, bytes]:
        """(cost, ids) of a whole text: no piece spans two units, so the best paths of units add up."""
        known, unit = self.known.get, self.unit
        got = [known(u) or unit(u) for u in _UNIT.findall(s)]
        return sum([g[0] for g in got]), b"".join([g[1] for g in got])

    def checked(self, s: str) -> tuple[int, bytes, bool]:
        """(cost, ids, whether the ids decode to the text): they do if those of every unit do; else it is tried."""
        before = self.faulty
        cost, ids = self.encode(s)
        return cost, ids, self.faulty == before or self.decode(ids) == s

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, np.int32).tolist()]).decode("utf-8", "replace")


def loaded(path: str) -> Pieces:
    """The pieces of a model, kept by the worker process: what it remembers serves its later tasks too."""
    kept = sys.modules.setdefault("_tempora_pieces", types.ModuleType("_tempora_pieces")).__dict__
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def normalise(text: str | None) -> str:
    """The form that is encoded: blanks visible, one in front. An empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def restore(s: str) -> str:
    return s[1:].replace(SPACE, " ") if s else ""


def forced(s: str, p: int) -> bool:
    """Whether every path has a piece boundary at p: the edges of units."""
    if p <= 0 or p >= len(s):
        return True
    a, b = s[p - 1], s[p]
    if a == "\n" or b == "\n" or a == SPACE or b == SPACE:
        return a == "\n" or b == "\n" or a != SPACE
    return (_LETTER.match(a) is None) != (_LETTER.match(b) is None)


def split(s: str, size: int, width: int) -> Iterator[tuple[int, str, int, int]]:
    """(k, chunk with what may stick out, its own length, place of its start in its unit)."""
    start = 0
    for k, at in enumerate(range(0, len(s), size)):
        rel = 0
        if not forced(s, at):
            p = at
            while p > start and not forced(s, p):
                p -= 1
            rel = at - p
            start = p
        yield k, s[at : at + size + width], min(size, len(s) - at), rel


def _edges(s: str, n: int, rel: int) -> tuple[int | None, int | None]:
    """The first and last forced boundary of a chunk, its own edges included."""
    inner = [m.start() for m in _UNIT.finditer(s, 0, n)]
    found = [p for p in inner if p or not rel]
    if forced(s, n):
        found.append(n)
    return (found[0], found[-1]) if found else (None, None)


def transfer(pieces: Pieces, s: str, n: int, rel: int) -> dict[tuple[int, int], int]:
    """(entry state, exit state) -> least cost of a chunk."""
    first, last = _edges(s, n, rel)
    stop = min(len(s), n + pieces.width - 1)
    if first is None:
        out = {}
        for i in range(min(pieces.width, n)):
            best, _ = pieces.forward(s, i, rel + i, n, stop)
            out |= {(i, p): c for p, c in enumerate(best[n - i :]) if c is not None}
        return out | {(i, i - n): 0 for i in range(n, pieces.width)}
    head = {0: 0}
    if first:
        head = {i: c for i in range(min(pieces.width - 1, first) + 1) if (c := pieces.forward(s, i, rel + i, first, first)[0][-1]) is not None}
    middle = pieces.encode(s[first:last])[0]
    tail = {0: 0} if last == n else {p: c for p, c in enumerate(pieces.forward(s, last, 0, n, stop)[0][n - last :]) if c is not None}
    return {(i, j): h + middle + t for i, h in head.items() for j, t in tail.items()}


def combine(a: dict[tuple[int, int], int], b: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """The product of two transfer matrices; associative."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (i, j), c in b.items():
        rows.setdefault(i, []).append((j, c))
    out: dict[tuple[int, int], int] = {}
    for (i, j), c in a.items():
        for k, d in rows.get(j, ()):
            if (i, k) not in out or c + d < out[i, k]:
                out[i, k] = c + d
    return out


def states(matrices: list[dict[tuple[int, int], int]], entry: int, leave: int) -> list[int]:
    """The states at all boundaries of a row of chunks, its outer ones given: a Viterbi path over matrices."""
    best, backs = {entry: 0}, []
    for m in matrices:
        after: dict[int, tuple[int, int]] = {}
        for (i, j), c in m.items():
            if i in best and (j not in after or (best[i] + c, i) < after[j]):
                after[j] = (best[i] + c, i)
        backs.append({j: i for j, (_, i) in after.items()})
        best = {j: c for j, (c, _) in after.items()}
    path = [leave]
    for back in reversed(backs):
        path.append(back[path[-1]])
    return path[::-1]


def trace(pieces: Pieces, s: str, n: int, rel: int, entry: int, leave: int) -> bytes:
    """Ids of a chunk between its two states."""
    if entry >= n:
        return b""
    first, last = _edges(s, n, rel)
    if first is None:
        return pieces.span(s, entry, n + leave, rel + entry, n)[1]
    head = pieces.span(s, entry, first, rel + entry, first)[1] if entry < first else b""
    tail = pieces.span(s, last, n + leave, 0, n)[1] if last < n else b""
    return head + pieces.encode(s[first:last])[1] + tail


def _ids(column: list[bytes]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) // 4 for x in column])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(column), np.int32)))


def _cost(c: int) -> float:
    return (c >> TIE) / SCALE


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL, chunk: int = 32_768) -> DataFrame:
    """Encode every whole text: (key, ids array<int>, score double, round_trip boolean).

    `round_trip` says that the ids decode to the text (a literal U+2581 decodes to a blank). Texts longer than `chunk`
    characters go through the parallel scan; the result does not depend on `chunk`. A null or empty text has no ids
    and score 0. Null keys and repeated rows come back row by row, an empty table gives none; only the two named
    columns are read. `model` is a file that every worker can open.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    long = F.coalesce(F.length("_text"), F.lit(0)) >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in by_few(batches, pieces=True):
            got = [pieces.checked(normalise(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _ids([i for _, i, _ in got]), pa.array([-_cost(c) for c, _, _ in got], pa.float64()), pa.array([r for *_, r in got], pa.bool_())], ["_key", "ids", "score", "round_trip"]
            )

    out = f"_key {kind}, ids array<int>, score double, round_trip boolean"
    short = rows.where(~long).mapInArrow(whole, out)

    # Giant texts get a row number, which has to stay the same in all that follows: hence the table.
    giant = materialize(rows.where(long).withColumn("_row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in by_few(batches, pieces=True):
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, s, n, rel in split(normalise(t), chunk, pieces.width):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([s]), pa.array([n]), pa.array([rel])], ["_row", "k", "s", "n", "rel"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in by_few(batches, pieces=True):
            made = [pickle.dumps(transfer(pieces, s, n, rel)) for s, n, rel in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["_row", "k", "m"])

    def by_group(batches: Iterator[pa.RecordBatch], made: Callable[[list[tuple]], list[tuple]], kinds: list[tuple[str, pa.DataType]], keys: int) -> Iterator[pa.RecordBatch]:
        """What `made` makes of each group of rows that agree in their first columns."""
        rows = (r for b in by_few(batches, pieces=True) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:keys]):
            columns = zip(*made(list(group)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple]) -> list[tuple]:
            m = pickle.loads(group[0][3])
            for r in group[1:]:
                m = combine(m, pickle.loads(r[3]))
            return [(*group[0][:2], pickle.dumps(m))]

        return by_group(batches, made, [("_row", pa.int64()), ("b", pa.int64()), ("m", pa.binary())], 2)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple]) -> list[tuple]:
            path = states([pickle.loads(r[2]) for r in group], 0, 0)
            return [(*r[:2], i, j) for r, i, j in zip(group, path[:-1], path[1:], strict=True)]

        return by_group(batches, made, [("_row", pa.int64()), ("b", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64())], 1)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple]) -> list[tuple]:
            path = states([pickle.loads(r[3]) for r in group], *group[0][4:])
            return [(r[0], r[2], i, j) for r, i, j in zip(group, path[:-1], path[1:], strict=True)]

        return by_group(batches, made, [("_row", pa.int64()), ("k", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64())], 2)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in by_few(batches, pieces=True):
            ids, same, costs = [], [], []
            for s, n, rel, i, j in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5, 6)), strict=True):
                ids.append(trace(pieces, s, n, rel, i, j))
                same.append(pieces.decode(ids[-1]) == s[i : n + j])
                costs.append(_path_cost(pieces, ids[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _ids(ids), pa.array(same, pa.bool_()), pa.array(costs, pa.int64())], ["_row", "k", "ids", "same", "cost"])

    # A table: what follows reads chunks, dealt out evenly, and no task holds the pieces twice, to cut and to measure.
    chunks = materialize(giant.select("_row", "_text").mapInArrow(cut, "_row long, k long, s string, n long, rel long").repartition("_row", "k"))
    matrices = materialize(chunks.mapInArrow(measure, "_row long, k long, m binary").withColumn("b", (F.col("k") / BLOCK).cast("long")))
    ordered = lambda df, *by: df.repartition(*[c for c in by if c != "k"]).sortWithinPartitions(*by)
    blocks = ordered(matrices.select("_row", "b", "k", "m"), "_row", "b", "k").mapInArrow(product, "_row long, b long, m binary")
    ends = blocks.repartition("_row").sortWithinPartitions("_row", "b").mapInArrow(outer, "_row long, b long, entry long, leave long")
    bounds = ordered(matrices.join(ends, ["_row", "b"]).select("_row", "b", "k", "m", "entry", "leave"), "_row", "b", "k").mapInArrow(inner, "_row long, k long, entry long, leave long")
    traced = chunks.join(bounds, ["_row", "k"]).select("_row", "k", "s", "n", "rel", "entry", "leave").mapInArrow(finish, "_row long, k long, ids array<int>, same boolean, cost long")
    joined = traced.groupBy("_row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"),  # the ids of one text
        (-F.sum("cost") / F.lit(float(SCALE))).alias("score"),
        F.bool_and("same").alias("round_trip"),
    )
    long_ones = giant.select("_row", "_key").join(joined, "_row").select("_key", "ids", "score", "round_trip")
    return short.unionByName(long_ones).withColumnRenamed("_key", key)


def _path_cost(pieces: Pieces, ids: bytes) -> int:
    """The scaled cost of ids: pieces by rank, runs of byte pieces by the characters they spell."""
    total, raw = 0, b""
    for i in np.frombuffer(ids, np.int32).tolist():
        if pieces.byte_id.get(pieces.bytes_of[i][0]) == i:
            raw += pieces.bytes_of[i]
        else:
            total += round(math.log(i + 2) * SCALE)
    return total + len(raw.decode("utf-8", "replace")) * (pieces.unknown >> TIE)


def decode_ids(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The text of ids: (key, text), row by row.

    Null ids give a null text, no ids an empty one; null keys and repeated rows are kept; an empty table gives none; a
    long list is decoded as a whole; only the two named columns are read.
    """
    rows = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in by_few(batches, pieces=True):
            texts = [None if x is None else restore(pieces.decode(np.array(x, np.int32).tobytes())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    return rows.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
