"""Permanent security ids and the tickers they carried over time."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.intervals import contains
from tempora.operators.bitemporal import view_sql


def sec_id_of(ticker: Column) -> Column:
    """SEC_<TICKER>_001."""
    return F.concat(F.lit("SEC_"), F.upper(F.trim(ticker)), F.lit("_001"))


def normalise_tickers(tickers: list[str]) -> list[str]:
    out = [t.strip().upper() for t in tickers]
    if not all(out):
        raise ValueError("a ticker is empty")
    if len(set(out)) < len(out):
        raise ValueError("a ticker is named twice")
    return out


def ticker_map_sql(source: str = "dim_security_ticker_raw") -> str:
    return view_sql(source, "sec_id", "valid_from", "ingestion_seq", "valid_to", ["sec_id", "ticker", "valid_from", "ingestion_seq"])


def _resolve(mapping: DataFrame, wanted: str, given: str, value: str, as_of: date | datetime | str) -> str | None:
    at = F.lit(as_of).cast("timestamp_ntz")
    name = value.strip().upper() if given == "ticker" else value.strip()
    column = F.upper(F.trim(F.col(given))) if given == "ticker" else F.trim(F.col(given))
    rows = mapping.where((column == name) & contains(F.col("valid_from"), F.col("valid_to"), at))
    row = rows.orderBy(F.desc("valid_from"), F.desc("ingestion_seq")).select(wanted).first()
    return row[0] if row else None


def resolve_sec_id(mapping: DataFrame, ticker: str, as_of: date | datetime | str) -> str | None:
    """The security that carried a ticker; of several the one that took it last."""
    return _resolve(mapping, "sec_id", "ticker", ticker, as_of)


def resolve_ticker(mapping: DataFrame, sec_id: str, as_of: date | datetime | str) -> str | None:
    return _resolve(mapping, "ticker", "sec_id", sec_id, as_of)


def resolve_many(requests: DataFrame, mapping: DataFrame, given: str, wanted: str, at: str = "as_of") -> DataFrame:
    """All requests at once: (given, at, wanted), null where nothing held the name at that time."""
    asked = requests.select(given, at).distinct()
    held = mapping.select(F.col(given).alias("_g"), F.col(wanted).alias("_w"), "valid_from", "valid_to", "ingestion_seq")
    match = (F.col(given) == F.col("_g")) & contains(F.col("valid_from"), F.col("valid_to"), F.col(at))
    best = Window.partitionBy(given, at).orderBy(F.desc("valid_from"), F.desc("ingestion_seq"))
    return asked.join(held, match, "left").withColumn("_r", F.row_number().over(best)).where("_r = 1").select(given, at, F.col("_w").alias(wanted))
