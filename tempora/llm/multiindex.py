"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of a vector, form a product grid of cells (Babenko and Lempitsky, "The Inverted
Multi-Index"). A vector is stored in its nearest cell and searches the nearest cells in the order of the multi-sequence
algorithm, as many as the target recall asks for; every candidate is verified by its exact cosine. Neighbouring cells
share a block, so that a search travels once for all the cells it visits there; blocks of many rows are cut; pairs
never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, materialize, ship
from tempora.llm.components import components

ship(__name__)

THRESHOLD = 0.95
RECALL = 0.998
SAMPLE = 20_000  # vectors that the codebooks and the number of visits are fitted on
PER_CELL = 200  # vectors aimed at for a cell: the grid grows with the table
MOST_WORDS = 1024  # code words of a half
PROBES = 4000  # vectors of the sample whose partners say how many cells a search has to visit
MEMBERS, SEARCHES = 1 << 20, 1 << 22  # numbers of a block: rows times their length
PAIRS = 1 << 20  # cosines computed at a time
ROUNDING = 1e-9  # cosines so near to the threshold are computed again, in one order of the two vectors


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        for c in range(k):
            if len(own := x[near == c]):
                centres[c] = own.mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def sequence(first: np.ndarray, second: np.ndarray, visits: int) -> np.ndarray:
    """The `visits` nearest cells of each vector, nearest first, from its distances to the code words of both halves.

    The n-th cell in order can only be one whose ranks in the two halves multiply to n at most, so the heap of the
    multi-sequence algorithm is a look at these.
    """
    k = first.shape[1]
    visits = min(visits, k * second.shape[1])
    pairs = np.array([(i, j) for i in range(min(k, visits)) for j in range(min(second.shape[1], visits // (i + 1)))])
    a, b = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
    total = np.take_along_axis(first, a, 1)[:, pairs[:, 0]] + np.take_along_axis(second, b, 1)[:, pairs[:, 1]]
    order = total.argsort(axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(a, pairs[order, 0], 1) * second.shape[1] + np.take_along_axis(b, pairs[order, 1], 1)


class Index:
    """Codebooks for vectors of one length, how many cells a search visits, how many blocks a row of cells makes."""

    def __init__(self, sample: np.ndarray, n_rows: int, threshold: float, recall: float):
        rng = np.random.default_rng(11)
        half = max(1, sample.shape[1] // 2)
        k = int(max(1, min(MOST_WORDS, len(sample) // 4, math.sqrt(n_rows / PER_CELL))))
        self.books = [kmeans(np.ascontiguousarray(x), k, rng) for x in (sample[:, :half], sample[:, half:])]
        # Partners at the threshold itself, the hardest ones: in which visit would they be found?
        own = sample[: min(len(sample), PROBES)]
        noise = rng.normal(size=own.shape)
        noise -= (noise * own).sum(1)[:, None] * own
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-30)[:, None]
        target = cells_of(self.books, threshold * own + math.sqrt(1 - threshold * threshold) * noise, 1)
        visits = 16
        while True:
            seen = cells_of(self.books, own, visits) == target
            self.recall = float(seen.any(axis=1).mean())
            if self.recall >= recall or visits >= k * k:
                break
            visits *= 2
        rank = np.where(seen.any(axis=1), seen.argmax(axis=1), seen.shape[1] - 1)
        self.visits = int(min(seen.shape[1], np.quantile(rank, min(1.0, recall), method="higher") + 1))
        self.parts = int(min(k, max(1, math.ceil(n_rows * sample.shape[1] / (k * MEMBERS)))))

    def plain(self) -> tuple[list[np.ndarray], int, int]:
        """What workers need, without this class."""
        return self.books, self.visits, self.parts


def cells_of(books: list[np.ndarray], x: np.ndarray, visits: int) -> np.ndarray:
    half = books[0].shape[1]
    return sequence(distances(x[:, :half], books[0]), distances(x[:, half:], books[1]), visits)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1)[:, None]  # first, so that squares neither vanish nor overflow
    x = x / top
    return x / np.linalg.norm(x, axis=1)[:, None]


def rows_of_equal_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each length in a list column without nulls, read as whole arrays."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, values[offsets[at][:, None] + np.arange(n)]


def near_vectors(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE
) -> DataFrame:
    """Link vectors of cosine >= threshold: (key, n_links, component_id, kept), one row for each row of `vectors`.

    Equal vectors are one node of the search; `n_links` counts all other rows linked directly, `component_id` is the
    smallest key reachable. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    and neither do vectors of different lengths. The index is fitted on at most `sample` vectors (those of the smallest
    hash) and holds every row. A row with a null key takes part; a component of null keys only has a null id and is not
    kept apart. An empty table gives none. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = F.col("_x").isNotNull() & ~F.exists("_x", bad) & F.exists("_x", lambda v: v != 0)
    rows = rows.withColumn("_good", F.coalesce(fine, F.lit(False)))
    # Hashes of equal vectors are equal; the vectors themselves are compared too.
    named = rows.where("_good").withColumn("_v", F.xxhash64("_x")).groupBy("_v", "_x").agg(F.count(F.lit(1)).alias("_copies"), F.min("_key").alias("_least"))
    nodes = materialize(named.withColumn("_id", F.monotonically_increasing_id()))

    lengths = nodes.groupBy(F.size("_x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    totals = {r.n: r.rows for r in lengths.orderBy(F.desc("rows"), "n").limit(64).collect()}
    chosen = nodes.orderBy("_v", "_id").limit(sample).select("_x").toArrow().column(0).combine_chunks()
    indexes = {x.shape[1]: Index(unit(x), totals[x.shape[1]], threshold, recall) for _, x in rows_of_equal_length(chosen) if len(x) >= 8 and x.shape[1] > 1 and x.shape[1] in totals}
    shared = spark.sparkContext.broadcast({n: i.plain() for n, i in indexes.items()})  # 2 * 1024 code words at most for each length

    element = nodes.schema["_x"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in by_few(batches, 2048):
            # Of each row its cell, its block, and the blocks that it searches with the cells there.
            own, home, blocks, cells = [0] * b.num_rows, [0] * b.num_rows, [[0]] * b.num_rows, [[[0]]] * b.num_rows
            for at, x in rows_of_equal_length(b.column(1)):
                if x.shape[1] not in known:
                    continue
                books, visits, parts = known[x.shape[1]]
                k = len(books[1])
                found = cells_of(books, unit(x), visits)
                block = found // k * parts + found % k * parts // k
                order = np.argsort(block, axis=1, kind="stable")
                found, block, first = np.take_along_axis(found, order, 1), np.take_along_axis(block, order, 1), (found[:, 0], block[:, 0])
                for i, c, g, row, named in zip(at.tolist(), first[0].tolist(), first[1].tolist(), found.tolist(), block.tolist(), strict=True):
                    cuts = [j for j in range(len(named)) if not j or named[j] != named[j - 1]] + [len(named)]
                    own[i], home[i] = c, g
                    blocks[i], cells[i] = [named[j] for j in cuts[:-1]], [row[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            lists = [pa.array(blocks, pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.int32()), pa.array(home, pa.int32()), *lists], ["_id", "_x", "_copies", "_own", "_home", "_blocks", "_cells"])

    placed = nodes.select("_id", "_x", "_copies").mapInArrow(place, f"_id long, _x {element}, _copies long, _own int, _home int, _blocks array<int>, _cells array<array<int>>")
    placed = materialize(placed).withColumn("_n", F.size("_x"))
    members = placed.select("_n", F.col("_home").alias("_g"), "_id", "_copies", "_own", F.flatten("_cells").alias("_cells"), "_x")
    searches = placed.select("_n", "_id", "_copies", "_own", "_x", F.explode(F.arrays_zip("_blocks", "_cells")).alias("_s"))
    searches = searches.select("_n", F.col("_s._blocks").alias("_g"), "_id", "_copies", "_own", F.col("_s._cells").alias("_cells"), "_x")
    m_sizes = members.groupBy("_n", "_g").agg(F.ceil(F.sum("_n") / F.lit(MEMBERS)).cast("int").alias("_mb"))
    s_sizes = placed.select("_n", F.explode("_blocks").alias("_g")).groupBy("_n", "_g").agg(F.ceil(F.sum("_n") / F.lit(SEARCHES)).cast("int").alias("_sb"))
    # A table: its size is known when the join is planned, so that searches are not shuffled for it while it is small.
    grid = materialize(m_sizes.join(s_sizes, ["_n", "_g"]))

    def dealt(side: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        side = side.join(grid, ["_n", "_g"])
        block = F.pmod(F.xxhash64("_id"), F.col(own)).cast("int")
        side = side.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = (block, F.col("_o")) if kind == 0 else (F.col("_o"), block)
        return side.select("_n", "_g", i.alias("_i"), j.alias("_j"), F.lit(kind).alias("_kind"), "_id", "_copies", "_own", "_cells", "_x")

    blocks = dealt(members, 0, "_mb", "_sb").union(dealt(searches, 1, "_sb", "_mb"))
    order = ["_n", "_g", "_i", "_j"]
    blocks = blocks.repartition(*order).sortWithinPartitions(*order, "_kind", "_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: tuple, sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                yield _block(*(Side(parts, key[0]) for parts in sides), threshold)

        now, sides = None, ([], [])
        for b in by_few(batches, 8192):
            heads = np.stack([b.column(c).to_numpy() for c in range(5)], axis=1)
            cut = np.concatenate([[0], np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1, [len(heads)]])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if x == y:
                    continue
                *key, kind = heads[x].tolist()
                if key != now:
                    yield from made(now, sides)
                    now, sides = key, ([], [])
                sides[kind].append(tuple(b.column(c).slice(x, y - x) for c in range(5, 10)))
        yield from made(now, sides)

    found = materialize(blocks.mapInArrow(compare, "id long, links long, root long"))
    classes = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("id").alias("_lid")).agg(F.sum("links").alias("_links"))
    member = nodes.select("_id", "_v", "_x", "_copies", "_least").join(classes, F.col("_id") == F.col("id"), "left").join(links, F.col("_id") == F.col("_lid"), "left")
    member = member.withColumn("_class", F.coalesce("component", "_id"))
    heads = member.groupBy("_class").agg(F.min("_least").alias("_head"))
    member = member.join(heads, "_class").select(F.col("_v").alias("_mv"), F.col("_x").alias("_mx"), "_head", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    hashed = rows.withColumn("_v", F.when(F.col("_good"), F.xxhash64("_x")))
    out = hashed.join(member, (F.col("_v") == F.col("_mv")) & (F.col("_x") == F.col("_mx")), "left")
    component = F.when(F.col("_good"), F.col("_head")).otherwise(F.col("_key"))
    return out.select(F.col("_key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_key").eqNullSafe(component)).alias("kept"))


class Side:
    """The members or the searches of a block: ids, numbers of copies, own cells, cells searched, unit vectors."""

    def __init__(self, parts: list[tuple[pa.Array, ...]], n: int):
        whole = [pa.concat_arrays([p[c] for p in parts]) for c in range(5)]
        self.ids, self.copies, self.own = (whole[c].to_numpy() for c in range(3))
        self.cells = whole[3].values.to_numpy()
        self.ends = whole[3].offsets.to_numpy()
        x = whole[4]
        self.x = unit(x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()].reshape(-1, n))

    def searching(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell, row) of all cells searched, by cell."""
        rows = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        cells = self.cells[self.ends[0] : self.ends[-1]]
        order = np.argsort(cells, kind="stable")
        return cells[order], rows[order]


def _block(members: Side, searches: Side, threshold: float) -> pa.RecordBatch:
    """(id, links counting copies, root) of all vectors of a block that are linked.

    A pair is found by either of the two, or by both. A search counts what it finds; where the found one does not
    search the cell of the finder, the link is counted for it too.
    """
    ids, where = np.unique(np.concatenate([members.ids, searches.ids]), return_inverse=True)
    of_member, of_search = where[: len(members.ids)], where[len(members.ids) :]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    by_cell = np.argsort(members.own, kind="stable")
    stored = members.own[by_cell]
    cells, rows = searches.searching()
    # Which member searches which cell, as sorted numbers.
    width = 1 + max(int(x.max(initial=0)) for x in (members.cells, searches.own))
    asked = np.sort(np.repeat(np.arange(len(members.ids)), np.diff(members.ends)) * width + members.cells[members.ends[0] : members.ends[-1]])
    for cell in np.unique(stored).tolist():
        own = by_cell[np.searchsorted(stored, cell) : np.searchsorted(stored, cell, "right")]
        asking = rows[np.searchsorted(cells, cell) : np.searchsorted(cells, cell, "right")]
        x = members.x[own]
        step = max(1, PAIRS // len(own))
        for start in range(0, len(asking), step):
            some = asking[start : start + step]
            cosine = searches.x[some] @ x.T
            q, m = np.nonzero(cosine >= threshold - ROUNDING)
            near = cosine[q, m]
            q, m = some[q], own[m]
            a, b = of_search[q], of_member[m]
            unsure = np.flatnonzero(np.abs(near - threshold) <= ROUNDING)
            if len(unsure):
                first = (a < b)[unsure, None]
                u, v = searches.x[q[unsure]], members.x[m[unsure]]
                near[unsure] = (np.where(first, u, v) * np.where(first, v, u)).sum(axis=1)
            keep = (near >= threshold) & (a != b)
            q, m, a, b = q[keep], m[keep], a[keep], b[keep]
            if not len(q):
                continue
            np.add.at(links, a, members.copies[m])
            # Does the member search the finder's own cell, so that it counts the link itself?
            wanted = m * width + searches.own[q]
            one_way = asked[np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)] != wanted
            np.add.at(links, b[one_way], searches.copies[q[one_way]])
            root = joined(root, a, b)
    touched = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(links[touched]), pa.array(ids[root[touched]])], ["id", "links", "root"])


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each element's component after the edges (a, b), given those before."""
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, root[side], least)
        new = new[new]
        if (new == root).all():
            return new
        root = new
