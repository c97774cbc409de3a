"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` hashed points of a 64-bit ring. A row walks clockwise from the hash of its key to the next
point and enters that point's shard, unless the shard is full: then it continues clockwise. Which rows overflow is
settled from the row counts of the arcs between points alone, so the rows themselves are shuffled once, without text.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING_BITS = 14  # the ring is indexed by the leading bits of a hash
SPAN_BITS = 16  # rows are ranked within spans of the ring that share so many leading bits
RUN = 4096  # copies of a row that one task spreads out


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the row itself."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(16)).cast("long")


def ring_points(spark: SparkSession, n_shards: int, vnodes: int, seed: int = 7) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in clockwise order; n_shards * vnodes of them, whatever the data's size."""
    rows = spark.range(n_shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("node"))
    rows = rows.select(F.xxhash64(F.lit(seed), "shard", "node").alias("point"), "shard")
    return sorted((r.point, r.shard) for r in rows.collect())


def capacities(n_rows: int, n_shards: int, load_factor: float) -> list[int]:
    """Rows each shard may hold. At load factor 1 they sum to n_rows exactly, so that counts differ by one at most."""
    if load_factor <= 1:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    return [int(-(-n_rows * load_factor // n_shards))] * n_shards


def settle(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Deal the rows of each arc out to shards: arc -> [(first rank, end rank, shard, slot of the first rank)].

    In round t what is left of arc a asks the shard of point a + t; arcs ask in ring order. A shard that is full
    passes the rest on. The work depends on the number of points only.
    """
    room, used, done = list(room), [0] * len(room), defaultdict(int)
    dealt: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    left, step = {a: n for a, n in sorted(counts.items()) if n}, 0
    while left:
        if step > len(points):
            raise ValueError("the shards cannot hold all rows")
        for a in list(left):
            shard = points[(a + step) % len(points)][1]
            if n := min(left[a], room[shard]):
                dealt[a].append((done[a], done[a] + n, shard, used[shard]))
                done[a] += n
                used[shard] += n
                room[shard] -= n
                left[a] -= n
                if not left[a]:
                    del left[a]
        step += 1
    return dealt


def _inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small literal table, without RDD or Arrow."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_rows(
    docs: DataFrame, n_shards: int = 40, *, vnodes: int = 64, load_factor: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Assign every row of `docs` to a shard: (key, size, text_crc32, law, shard, slot, grown_shard).

    The law is `rows`: with load factor 1 (the default) the counts of shards differ by one at most; a larger factor
    moves fewer rows when shards are added, and bounds each shard by factor * rows / shards. Slots are gapless from 0
    in each shard. `grown_shard` is null, as only the `key` law can promise it.

    Nulls: a null key is a key like any other; a null text counts no bytes and has the checksum of no bytes. A long text
    is measured where it is read. Repeated rows each get a slot of their own: they are counted before the shuffle and
    spread out after it, by runs in several tasks. No text hash is compared, so ties of hashes only share an arc. An empty table
    gives an empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    points = ring_points(spark, n_shards, vnodes)
    cells: dict[int, list[int]] = defaultdict(list)
    for p, _ in points:
        cells[p >> (64 - RING_BITS)].append(p)
    half = 1 << (RING_BITS - 1)
    flat = [p for p, _ in points]
    ring = _inline(
        spark,
        [{"_cell": c, "_start": bisect_left(flat, c << (64 - RING_BITS)), "_points": cells[c]} for c in range(-half, half)],
        "_cell int, _start int, _points array<bigint>",
    )
    keys = docs.select(F.col(key).alias("_key"), row_size(text).alias("_size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"))
    # A key that many rows repeat meets in one row before the shuffle. The checksum spreads rows that share a null key.
    keys = keys.groupBy("_key", "_size", "_crc").agg(F.count(F.lit(1)).alias("_copies"))
    keys = keys.withColumn("_h", F.xxhash64("_key", "_size", "_crc")).withColumn("_cell", F.shiftright("_h", 64 - RING_BITS).cast("int"))
    after = F.size(F.filter("_points", lambda p: p < F.col("_h")))
    keys = keys.join(F.broadcast(ring), "_cell").withColumn("_arc", F.pmod(F.col("_start") + after, F.lit(len(points))).cast("int"))
    keys = keys.select("_key", "_size", "_crc", "_copies", "_h", "_arc", F.shiftright("_h", 64 - SPAN_BITS).cast("int").alias("_span"))

    # Rows are counted by arc and span: as many numbers as points and spans together, whatever the number of rows.
    spans = keys.groupBy("_arc", "_span").agg(F.sum("_copies").alias("_n"))
    counts = {r._arc: r.n for r in spans.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}  # a number for each point
    before = Window.partitionBy("_arc").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_arc", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    total = sum(counts.values())
    dealt = settle(points, counts, capacities(total, n_shards, load_factor))
    plan = _inline(
        spark,
        [{"_arc": a, "_runs": [{"lo": lo, "hi": hi, "shard": s, "slot": slot} for lo, hi, s, slot in runs]} for a, runs in dealt.items()],
        "_arc int, _runs array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>",
    )
    order = Window.partitionBy("_arc", "_span").orderBy("_h", "_key", "_size", "_crc").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("_first", F.sum("_copies").over(order) - F.col("_copies")).join(F.broadcast(spans), ["_arc", "_span"])
    keys = keys.withColumn("_first", F.col("_first") + F.col("_skip")).drop("_skip", "_span", "_h")
    # Many copies of one row are cut into runs, which are dealt out before they are spread.
    many = keys.where(F.col("_copies") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {RUN}"))))
    many = many.withColumn("_first", F.col("_first") + F.col("_run") * RUN).withColumn("_copies", F.least(F.lit(RUN), F.col("_copies") - F.col("_run") * RUN))
    many = many.repartition("_key", "_run").select(*keys.columns)
    runs = keys.where(F.col("_copies") <= RUN).unionByName(many)
    rows = runs.withColumn("_rank", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)))
    rows = rows.join(F.broadcast(plan), "_arc")
    run = F.element_at(F.filter("_runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"])), 1)
    return rows.withColumn("_run", run).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_run.shard").cast("int").alias("shard"),
        (F.col("_run.slot") + F.col("_rank") - F.col("_run.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
