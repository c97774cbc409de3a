"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word shingles are one node. MinHash bands propose pairs: those that share a cell, that is a
band's values. Proposed pairs are compared by MinHash values, some at a time: a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below a tolerance. What is left is verified on the sets.

Texts that proposals connect meet in one block, where each travels once. Where these are too many for a block, they meet
by cells, and a pair is compared in the first cell that it shares; a cell of too many texts is cut into blocks. Only
proposed pairs are ever compared, and they never become rows: a block gives one row for each of its texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, materialize, ship, with_near
from tempora.llm.components import components
from tempora.llm.shingles import runs, words

ship(__name__)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5  # a pair at the threshold is proposed with probability 1 - (1 - 0.8**5)**28 = 0.99999
STEP = 20  # MinHash values compared before each look at the posterior
TOLERANCE = 1e-5
SALTS = 16  # parts of a cell that different tasks deal out
BLOCK_SHINGLES = 250_000  # a block of texts holds about so many


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return np.unique(runs(words(text)[0], k))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] * a + b) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def least_matches(threshold: float, total: int, step: int, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): below it P(similarity >= threshold | matches) < tolerance, prior uniform."""
    out = []
    for n in range(step, total + 1, step):
        m = 0
        # 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m)
        while sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def cells_of(signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A number for each band of signatures: (texts, bands)."""
    h = signs.astype(np.uint64).reshape(len(signs), -1, rows)
    cell = np.zeros(h.shape[:2], np.uint64)
    for r in range(rows):
        cell = cell * np.uint64(0xD6E8FEB86659FD93) + h[:, :, r] + np.uint64(1)
    return (cell ^ (cell >> np.uint64(29))).view(np.int64)


class Block:
    """Texts that meet: shingle sets, MinHash values, cells, number of copies."""

    def __init__(self, ids: list[int], texts: list[str], copies: list[int], coefficients: tuple[np.ndarray, np.ndarray], k: int, rows: int = ROWS):
        self.ids, self.copies = ids, np.array(copies, np.int64)
        self.sets = [shingle_set(t, k) for t in texts]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.signs = np.stack([signature(s, *coefficients) for s in self.sets])
        self.cells = cells_of(self.signs, rows)
        self._order = self.cells.argsort(axis=0, kind="stable")
        self._sorted = np.take_along_axis(self.cells, self._order, 0)

    def sharing(self, cells: np.ndarray) -> np.ndarray:
        """The texts that share a cell with one whose cells these are, in order."""
        found = []
        for band, c in enumerate(cells.tolist()):
            column = self._sorted[:, band]
            x, y = np.searchsorted(column, c), np.searchsorted(column, c, "right")
            if x < y:
                found.append(self._order[x:y, band])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def linked(x: Block, y: Block, threshold: float, looks: list[tuple[int, int]], band: int = -1) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of x the texts of y that it is linked to; if y is x, only later ones.

    Pairs are those that share a cell; with a `band`, in which all of these texts share one, those that share none before.
    """
    everything, place = np.unique(np.concatenate(y.sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(y.sizes)])
    mark = np.zeros(len(everything) + 1, bool)
    for i, own in enumerate(x.sets):
        left = np.arange(len(y.ids)) if band >= 0 else y.sharing(x.cells[i])
        if y is x:
            left = left[left > i]
        n = len(own)
        left = left[(y.sizes[left] >= threshold * n - 1e-9) & (y.sizes[left] * threshold <= n + 1e-9)]
        if band > 0:
            left = left[~(y.cells[left, :band] == x.cells[i, :band]).any(axis=1)]
        done, same = 0, np.zeros(len(left), np.int64)
        for upto, least in looks:
            if not len(left):
                break
            same = same + (y.signs[left, done:upto] == x.signs[i, done:upto]).sum(axis=1)
            keep = same >= least
            left, same, done = left[keep], same[keep], upto
        if not len(left):
            continue
        at = np.searchsorted(everything, own)
        at = at[(at < len(everything)) & (everything[np.minimum(at, len(everything) - 1)] == own)]
        mark[at] = True
        sizes = y.sizes[left]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) + np.repeat(first[left] - (ends - sizes), sizes)
        shared = np.add.reduceat(mark[place[spots]].astype(np.int64), ends - sizes)
        mark[at] = False
        # shared / union >= threshold, without rounding at the threshold
        found = left[shared + 1e-9 >= threshold * (n + sizes - shared)]
        if len(found):
            yield i, found


def compare_blocks(x: Block, y: Block, threshold: float, looks: list[tuple[int, int]], band: int = -1) -> Iterator[tuple[int, int, int]]:
    """(id, links to texts of the other block counting copies, smallest id it is joined to in these two blocks)."""
    alone = y is x
    ids = x.ids if alone else x.ids + y.ids
    links = np.zeros(len(ids), np.int64)
    root = list(range(len(ids)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    shift = 0 if alone else len(x.ids)
    for i, found in linked(x, y, threshold, looks, band):
        links[i] += y.copies[found].sum()
        links[found + shift] += x.copies[i]
        for j in (found + shift).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for v, w in enumerate(ids):
        r = find(v)
        least[r] = min(w, least.get(r, w))
    for v, w in enumerate(ids):
        if links[v]:
            yield w, int(links[v]), least[find(v)]


def jaccard_join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
    bands: int = BANDS, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Group documents by links of Jaccard similarity >= threshold: (key, class_id, n_links, kept, text_hash).

    One row for each row of `docs`. `n_links` counts the other documents it is linked to directly, exact copies
    included; `class_id` is the smallest key reachable by links; `kept` marks one text of each class, that with the
    smallest key (rows that repeat key and text share the mark); `text_hash` tells rows of one key apart. Shingles are runs of five words without case; a shorter text is one shingle. Texts without
    words (null and empty ones too) have no links and stay; their class is their own key. Rows with null keys take part;
    a class of null keys only has a null class id. An empty table gives none. Only the two named columns are read.
    """
    n_hashes = bands * rows
    looks = least_matches(threshold, n_hashes, STEP, tolerance)
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tv"))
    kind = source.schema["_key"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(n_hashes)
        for batch in by_few(batches, 1024):
            nodes, cells, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, shingle)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    cells.append(None)
                    continue
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                cells.append(cells_of(signature(s, a, b)[None], rows)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["_key", "_tv", "_node", "_n", "_cells"]
            )

    marks = materialize(source.mapInArrow(sign, f"_key {kind}, _tv long, _node binary, _n long, _cells array<long>"))
    named = marks.where("_node is not null").groupBy("_node").agg(
        F.count(F.lit(1)).alias("_copies"), F.min("_key").alias("_least"), F.first("_n").alias("_n"),
        F.min(F.struct(F.col("_key").isNull(), "_key", "_tv")).alias("_one"), F.first("_cells").alias("_cells"),
    )
    nodes = materialize(named.withColumn("_id", F.monotonically_increasing_id()))

    cells = nodes.select("_id", F.posexplode("_cells").alias("_band", "_cell"))
    least = cells.groupBy("_band", "_cell").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    shared = materialize(cells.join(least, ["_band", "_cell"]))
    groups = components(shared.select(F.col("_first").alias("a"), F.col("_id").alias("b")))
    inside = materialize(groups.join(nodes.select("_id", "_n", "_copies", "_one"), F.col("id") == F.col("_id")).select("_id", "component", "_n", "_copies", F.col("_one._key").alias("_k"), F.col("_one._tv").alias("_v")))
    total = inside.groupBy("component").agg(F.sum("_n").alias("_total"))
    sized = inside.select("_id", "component", "_n").join(total, "component").select("_id", "component", "_n", (F.col("_total") > block_shingles).alias("_large"))
    together = sized.where("NOT _large").select("_id", F.col("component").alias("_g"), F.lit(-1).alias("_band"), F.lit(0).alias("_i"), F.lit(0).alias("_j"), F.lit(0).alias("_own"))
    # Large groups meet by cells.
    by_cell = sized.where("_large").select("_id", "_n").join(shared.select("_id", "_band", "_cell"), "_id")
    cuts = by_cell.groupBy("_band", "_cell").agg(F.ceil(F.sum("_n") / F.lit(block_shingles)).cast("int").alias("_blocks"))
    # A cell may hold a large share of all rows: its number of blocks is sent to several tasks.
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_cell = by_cell.withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(SALTS)).cast("int"))
    by_cell = by_cell.join(cuts, ["_band", "_cell", "_salt"]).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    by_cell = by_cell.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    by_cell = by_cell.select("_id", F.col("_cell").alias("_g"), "_band", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own")
    # Few texts are wanted: the others do not enter the join's shuffle.
    texts = with_near(source, F.col("_tv"), inside, "_v").where("_near").join(inside.select("_id", "_copies", "_k", "_v"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_tv") == F.col("_v")))
    texts = texts.select("_id", "_copies", "_text").dropDuplicates(["_id"])
    dealt = together.unionByName(by_cell).join(texts, "_id").select("_g", "_band", "_i", "_j", "_own", "_id", "_copies", "_text")
    dealt = dealt.repartition("_g", "_band", "_i", "_j").sortWithinPartitions("_g", "_band", "_i", "_j", "_own", "_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = _coefficients(n_hashes)

        def rows_of() -> Iterator[tuple]:
            for batch in by_few(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)

        out: list[tuple[int, int, int]] = []
        for (_, band, first, second), group in groupby(rows_of(), key=lambda r: r[:4]):
            parts = [Block([r[5] for r in part], [r[7] for r in part], [r[6] for r in part], coefficients, shingle, rows) for part in (list(g) for _, g in groupby(group, key=lambda r: r[4]))]
            i, j = parts[0], parts[-1]
            if len(parts) == 1 and first != second:
                continue  # one of the two blocks is empty
            out += compare_blocks(i, j, threshold, looks, band)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    found = materialize(dealt.mapInArrow(compare, "id long, links long, root long"))
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("_links")).withColumnRenamed("id", "_lid")
    member = nodes.select("_id", "_node", "_copies", "_least", "_one").join(classes, F.col("_id") == F.col("id"), "left").join(links, F.col("_id") == F.col("_lid"), "left")
    member = member.withColumn("_class", F.coalesce("component", "_id"))
    heads = member.groupBy("_class").agg(F.min("_least").alias("_head"), F.min(F.struct(F.col("_least").isNull(), "_least", "_id")).alias("_best"))
    member = member.join(heads, "_class").select("_node", "_head", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), "_one", (F.col("_best._id") == F.col("_id")).alias("_first"))
    member = member.withColumnRenamed("_node", "_member")
    rows_out = marks.select("_key", "_tv", "_node").join(member, F.col("_node") == F.col("_member"), "left")
    return rows_out.select(
        F.col("_key").alias(key),
        F.when(F.col("_node").isNull(), F.col("_key")).otherwise(F.col("_head")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).alias("n_links"),
        F.when(F.col("_node").isNull(), True).otherwise(F.col("_first") & F.col("_key").eqNullSafe(F.col("_one._key")) & (F.col("_tv") == F.col("_one._tv"))).alias("kept"),
        F.col("_tv").alias("text_hash"),
    )


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "root"])
