"""Append-only Parquet tables, the ingestion log, and files.

A batch is written beside its table, in a folder that readers pass over, and its files are then renamed into their
partitions, each with path, size, hash and number of rows known. Loads repeat safely: rows that are stored already are
left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.bitemporal import without_persisted
from tempora.sources import schemas

TABLES = {
    "market_ohlcv": (schemas.OHLCV, "trade_date", ("year", "month")),
    "corporate_actions": (schemas.ACTIONS, "ex_date", ("year",)),
    "entity_map": (schemas.ENTITY_MAP, None, ()),
    "fundamentals": (schemas.FUNDAMENTALS, "fiscal_period_end", ("year",)),
}


def root_of(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, base: str, table: str, start=None, end=None) -> DataFrame:
    """A stored table, or an empty one of its schema. Dates also become conditions on partitions, so files are skipped."""
    schema, day, parts = TABLES[table]
    path = root_of(base, table)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {', '.join(f'{p} int' for p in parts)}" if parts else schema).parquet(path)
    for bound, over in ((start, True), (end, False)):
        if bound is not None and day:
            value = F.lit(bound).cast("date")
            keep = (lambda a, b: a >= b) if over else (lambda a, b: a <= b)
            rows = rows.where(keep(F.col(day), value) & keep(F.col("year"), F.year(value)))
    return rows.select(*[c for c in rows.columns if c not in parts])


@dataclass(frozen=True)
class WrittenFile:
    """A file of a batch."""

    path: str
    size_bytes: int
    sha256: str
    row_count: int


def append_table(new: DataFrame, base: str, table: str, seq: int = 0) -> list[WrittenFile]:
    """Append the rows that are not stored yet; the files written, none if there was nothing new. One writer at a time."""
    spark = new.sparkSession
    schema, day, parts = TABLES[table]
    names = spark.createDataFrame([], schema).columns
    new = new.select(*names)
    path = root_of(base, table)
    if exists(spark, path):
        new = without_persisted(new, read_table(spark, base, table))
    if "year" in parts:
        new = new.withColumn("year", F.year(day))
    if "month" in parts:
        new = new.withColumn("month", F.month(day))
    batch = f"batch_{seq:06d}_{uuid.uuid4().hex[:8]}"
    beside = f"{path}/_{batch}"
    # One file for each partition and batch.
    (new.repartition(*parts) if parts else new.coalesce(1)).write.partitionBy(*parts).parquet(beside)
    counts = {r.f: r.n for r in spark.read.schema(names_of(schema, names)).parquet(beside).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    jvm = spark.sparkContext._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    fs = path_of(beside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = []
    for i, (name, rows) in enumerate(sorted((f, n) for f, n in counts.items() if n)):
        source = path_of(jvm.java.net.URI.create(name))
        inside = [x for x in name.split("/")[:-1] if x.partition("=")[0] in parts]
        target = path_of("/".join([path, *inside, f"{batch}_{i:05d}.parquet"]))
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{name} could not be moved to {target.toString()}")
        written.append((target, rows))
    fs.delete(path_of(beside), True)
    with ThreadPoolExecutor(8) as pool:
        hashes = list(pool.map(lambda x: file_sha256(spark, x[0].toString()), written))
    return [WrittenFile(p.toString(), fs.getFileStatus(p).getLen(), h, n) for (p, n), h in zip(written, hashes, strict=True)]


def names_of(schema: str, names: Sequence[str]) -> str:
    """The first column of a schema: enough to count rows."""
    return next(c for c in schema.split(", ") if c.startswith(f"{names[0]} "))


def read_parquet(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """A file or a folder of files with schemas merged."""
    if not exists(spark, path):
        raise ValueError(f"no Parquet files for {what} at {path}")
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)


def splits_only(actions: DataFrame, sec_ids: Sequence[str] | None = None, end=None) -> DataFrame:
    """(sec_id, ex_date, split_ratio, known_from) of the splits among corporate actions."""
    rows = actions.where(F.upper("action_type") == "SPLIT")
    if sec_ids is not None:
        rows = rows.where(F.col("sec_id").isin(list(sec_ids)))
    if end is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(end).cast("date"))
    return rows.select("sec_id", "ex_date", "split_ratio", "known_from")


def optional_splits(spark: SparkSession, path: str, sec_ids: Sequence[str], end) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    return splits_only(read_parquet(spark, path, "splits"), sec_ids, end)


def file_sha256(spark: SparkSession, path: str) -> str:
    """The hash of one file, read as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


class IngestionLog:
    """What was loaded when. One writer at a time: the next sequence is the largest plus one."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/metadata/ingestion_log"

    def history(self, table: str | None = None) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schemas.LOG)
        rows = self.spark.read.schema(schemas.LOG).parquet(self.path)
        return rows.where(F.col("table_name") == table) if table else rows

    def latest_seq(self) -> int:
        return self.history().agg(F.coalesce(F.max("ingestion_seq"), F.lit(0)).alias("m")).first().m

    def next_seq(self) -> int:
        return self.latest_seq() + 1

    def record(self, table: str, source: str, row_count: int, files: Sequence[tuple[str, str]] = (), seq: int | None = None) -> int:
        seq = seq or self.next_seq()
        row = (seq, datetime.now(UTC).replace(tzinfo=None), table, source, row_count, len(files), [f for f, _ in files], [h for _, h in files])
        self.spark.createDataFrame([row], schemas.LOG).coalesce(1).write.mode("append").parquet(self.path)
        return seq
