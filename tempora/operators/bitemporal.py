"""Append-only facts: upper bounds are derived, never stored."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.intervals import contains


def _keys(partition_by: str | Sequence[str]) -> list[str]:
    return [partition_by] if isinstance(partition_by, str) else list(partition_by)


def _derive(df: DataFrame, partition_by: str | Sequence[str], start: str, seq: str, end: str) -> DataFrame:
    order = Window.partitionBy(*_keys(partition_by)).orderBy(start, seq)
    return df.withColumn(end, F.lead(start).over(order))


def derive_known_to(df: DataFrame, partition_by: str | Sequence[str], known_from: str = "known_from", seq: str = "ingestion_seq", known_to: str = "known_to") -> DataFrame:
    """A fact is known until the next fact of its key is; the last one is open. Ties go by ingestion sequence."""
    return _derive(df, partition_by, known_from, seq, known_to)


def derive_valid_to(df: DataFrame, partition_by: str | Sequence[str], valid_from: str = "valid_from", seq: str = "ingestion_seq", valid_to: str = "valid_to") -> DataFrame:
    return _derive(df, partition_by, valid_from, seq, valid_to)


def view_sql(source: str, partition_by: str | Sequence[str], start: str = "known_from", seq: str = "ingestion_seq", end: str = "known_to", columns: Sequence[str] | None = None) -> str:
    """The derivation as a SELECT, in SQL that any engine with window functions runs."""
    listed = ", ".join(columns) if columns else "*"
    return f"SELECT {listed}, LEAD({start}) OVER (PARTITION BY {', '.join(_keys(partition_by))} ORDER BY {start}, {seq}) AS {end} FROM {source}"


def register_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    view = spark.sql(sql)
    view.createOrReplaceTempView(name)
    return view


def point_in_time(df: DataFrame, as_of: datetime | str, known_from: str = "known_from", known_to: str = "known_to") -> DataFrame:
    """The facts known at one moment."""
    return df.where(contains(F.col(known_from), F.col(known_to), F.lit(as_of).cast("timestamp_ntz")))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("known_from", "ingestion_seq")) -> DataFrame:
    """The last row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def without_persisted(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of `new` that `stored` does not hold yet, compared on all shared columns but the sequence; nulls are equal."""
    shared = [c for c in new.columns if c in stored.columns and c != "ingestion_seq"]
    other = stored.select(*[F.col(c).alias(f"_s_{c}") for c in shared]).distinct()
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return new.join(other, same, "left_anti")


def merged_union(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
