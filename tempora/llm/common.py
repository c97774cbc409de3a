"""What the operators share: reading tables, intermediate tables in the shared folder, shipping code to workers."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ship(name: str) -> None:
    """Have the functions of module `name` travel to Python workers by value, so that workers need no path to it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and return the reread table: see `tempora.session`."""
    return stored(df)


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, with as many underscores behind it as make it no column of these frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a membership filter: two megabytes of broadcast rows at most, whatever the data's size.
FILTER_BITS = 1 << 23


def with_near(rows: DataFrame, key: Column, wanted: DataFrame, hashes: str, name: str = "_near") -> DataFrame:
    """Add the column `name`: true for all rows whose hash `key` is in wanted[hashes], false for most others.

    The filter is a bit map of fixed size, made and broadcast by Spark: what it lets through needs a join still, but
    wide rows that are not wanted never enter a shuffle. The more there are in `wanted`, the more it lets through;
    results do not depend on it. Columns of `rows` stay as they are, whatever their names, but for `name` itself.
    """
    spot = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    at, word, bit, one, bits = (unused(f"_f_{c}", rows) for c in ("spot", "word", "bit", "one", "bits"))
    marks = wanted.select((spot(F.col(hashes)) / 64).cast("int").alias(word), F.lit(1).cast("long").alias(one), (spot(F.col(hashes)) % 64).cast("int").alias(bit))
    marks = marks.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.col(one), F.col(bit))).alias(bits))  # FILTER_BITS / 64 rows at most
    out = rows.withColumn(at, spot(key)).withColumn(word, (F.col(at) / 64).cast("int"))
    out = out.join(F.broadcast(marks), word, "left")
    near = F.coalesce(F.getbit(bits, (F.col(at) % 64).cast("int")) == 1, F.lit(False))
    kept = [c for c in rows.columns if c != name]
    return out.select(*[F.col(f"`{c}`") for c in kept], near.alias(name))


def without(rows: DataFrame, dropped: DataFrame, own: dict[str, Column]) -> DataFrame:
    """The rows whose values `own` are no row of `dropped`, whose columns have the names of `own`; nulls are equal.

    Rows far from all of them skip the shuffle.
    """
    names = {c: unused(f"_d_{c}", rows) for c in own}
    hashed, near, mine = (unused(c, rows) for c in ("_d_hash", "_d_near", "_d_own"))
    dropped = dropped.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    dropped = materialize(dropped.withColumn(hashed, F.xxhash64(*names.values())))
    marked = with_near(rows, F.xxhash64(*own.values()), dropped, hashed, near)
    some = marked.where(near)
    same = F.lit(True)
    for i, (c, n) in enumerate(names.items()):
        some = some.withColumn(f"{mine}{i}", own[c])
        same = same & F.col(f"{mine}{i}").eqNullSafe(F.col(n))
    left = some.join(dropped, same, "left_anti")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(~F.col(near)).select(*columns).unionByName(left.select(*columns))


def trim() -> None:
    """On a worker: hand back to the system what earlier work has freed; a worker process serves many stages."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def by_few(batches: Iterator[pa.RecordBatch], size: int = 256, *, pieces: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects at a time.

    Work that does not use the `pieces` of an encoding lets go of those that an earlier task left in the process.
    """
    if not pieces and sys.modules.pop("_tempora_pieces", None):
        gc.collect()
    trim()
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
    trim()
