"""Loading vendor data. The vendor is a callable that is handed in; there is no network here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.calendar import calendar_days, with_actionable
from tempora.operators.adjustment import undo_adjustment
from tempora.operators.entity import normalise_tickers
from tempora.sources import schemas
from tempora.sources.catalog import Catalog
from tempora.sources.storage import IngestionLog, append_table

FIRST_DAY = datetime(1980, 1, 1)


class TickerRegistry:
    """Ids of tickers: SEC_<TICKER>_001."""

    def sec_id(self, ticker: str) -> str:
        return f"SEC_{ticker.strip().upper()}_001"

    def mapping(self, spark: SparkSession, tickers: Sequence[str], valid_from: date | datetime = FIRST_DAY, seq: int = 1) -> DataFrame:
        start = valid_from if isinstance(valid_from, datetime) else datetime.combine(valid_from, datetime.min.time())
        return spark.createDataFrame([(self.sec_id(t), t, start, seq) for t in normalise_tickers(list(tickers))], schemas.ENTITY_MAP)


def calendar_of(spark: SparkSession, frames: Sequence[DataFrame]) -> DataFrame | None:
    """The calendar over all days that the first columns of these frames span, found by one job; None if they hold none."""
    days = None
    for f in frames:
        own = f.select(F.col(f.columns[0]).cast("date").alias("day"))
        days = own if days is None else days.unionByName(own)
    span = None if days is None else days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return None if span is None or span.a is None else calendar_days(spark, span.a, span.b)


def _known(df: DataFrame, day: str, calendar: DataFrame | None) -> DataFrame:
    """When a day's data was confirmed: its session's close and a quarter of an hour."""
    if calendar is None and (calendar := calendar_of(df.sparkSession, [df.select(day)])) is None:
        return df.withColumn("known_from", F.lit(None).cast("timestamp_ntz"))
    noon = df.withColumn("_noon", F.col(day).cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"))  # midday in New York
    return with_actionable(noon, "_noon", calendar, market_data=True, name="known_from").drop("_noon")


def parse_bars(raw: DataFrame, ticker: str, sec_id: str, seq: int, splits: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Vendor bars (date, open, high, low, close, volume in any case) in the stored schema, as traded."""
    rows = raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns])
    rows = rows.withColumnRenamed("date", "trade_date").withColumn("trade_date", F.col("trade_date").cast("date"))
    rows = _known(rows.withColumn("sec_id", F.lit(sec_id)).where("close is not null"), "trade_date", calendar).withColumn("ingestion_seq", F.lit(seq).cast("long"))
    rows = rows.withColumn("volume", F.col("volume").cast("long"))
    if splits is not None:
        rows = undo_adjustment(rows, splits)
    return rows.select("sec_id", "trade_date", "open", "high", "low", "close", "volume", "known_from", "ingestion_seq")


def _actions(raw: DataFrame, sec_id: str, seq: int, kind: str, start: date | None, end: date | None, calendar: DataFrame | None) -> DataFrame:
    rows = raw.select(F.col(raw.columns[0]).cast("date").alias("ex_date"), F.col(raw.columns[1]).cast("double").alias("_value")).where("_value > 0")
    if start is not None:
        rows = rows.where(F.col("ex_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(end))
    empty = F.lit(None).cast("double")
    return _known(rows, "ex_date", calendar).select(
        F.lit(sec_id).alias("sec_id"), F.lit(kind).alias("action_type"), "ex_date",
        (F.col("_value") if kind == "SPLIT" else empty).alias("split_ratio"), (F.col("_value") if kind == "CASH_DIVIDEND" else empty).alias("cash_amount"),
        F.col("ex_date").alias("announcement_date"), "known_from", F.lit(seq).cast("long").alias("ingestion_seq"),
    )


def parse_splits(raw: DataFrame, sec_id: str, seq: int, start: date | None = None, end: date | None = None, calendar: DataFrame | None = None) -> DataFrame:
    return _actions(raw, sec_id, seq, "SPLIT", start, end, calendar)


def parse_dividends(raw: DataFrame, sec_id: str, seq: int, start: date | None = None, end: date | None = None, calendar: DataFrame | None = None) -> DataFrame:
    return _actions(raw, sec_id, seq, "CASH_DIVIDEND", start, end, calendar)


#: ticker -> (bars, splits, dividends), each a frame or None
Vendor = Callable[[str], tuple[DataFrame | None, DataFrame | None, DataFrame | None]]


def _store(spark: SparkSession, frames: list[DataFrame], base: str, table: str, source: str, seq: int) -> int | None:
    if not frames:
        return None
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    files = append_table(whole, base, table, seq)
    return IngestionLog(spark, base).record(table, source, sum(f.row_count for f in files), [(f.path, f.sha256) for f in files], seq)


def ingest_bars(spark: SparkSession, tickers: Sequence[str], vendor: Vendor, base: str, source: str = "vendor") -> int | None:
    """Load bars of all tickers; the log's sequence, or None if the vendor had nothing."""
    seq, registry, frames = IngestionLog(spark, base).next_seq(), TickerRegistry(), []
    append_table(registry.mapping(spark, tickers, seq=seq), base, "entity_map", seq)
    given = [(registry.sec_id(t), t, *vendor(t)[:2]) for t in normalise_tickers(list(tickers))]
    by_day = lambda f: f.select(next(c for c in f.columns if c.lower() == "date"))
    days = calendar_of(spark, [f for _, _, b, s in given if b is not None for f in (by_day(b), s) if f is not None])
    for sec, t, bars, splits in given:
        if bars is not None:
            history = None if splits is None else parse_splits(splits, sec, seq, calendar=days).select("sec_id", "ex_date", "split_ratio", "known_from")
            frames.append(parse_bars(bars, t, sec, seq, history, days))
    return _store(spark, frames, base, "market_ohlcv", source, seq)


def ingest_actions(spark: SparkSession, tickers: Sequence[str], vendor: Vendor, base: str, source: str = "vendor", start: date | None = None, end: date | None = None) -> int | None:
    seq, registry, frames = IngestionLog(spark, base).next_seq(), TickerRegistry(), []
    given = [(registry.sec_id(t), *vendor(t)[1:]) for t in normalise_tickers(list(tickers))]
    days = calendar_of(spark, [f for _, *two in given for f in two if f is not None])
    for sec, splits, dividends in given:
        frames += [parse(f, sec, seq, start, end, days) for parse, f in ((parse_splits, splits), (parse_dividends, dividends)) if f is not None]
    return _store(spark, frames, base, "corporate_actions", source, seq)


def load_preadjusted(spark: SparkSession, tickers: Sequence[str], vendor: Callable[[str], DataFrame | None], start: date | None = None, end: date | None = None) -> DataFrame:
    """(sec_id, trade_date, close) of closes that a vendor adjusted for all splits: what a careless pipeline starts from.

    `vendor` gives a frame with a date and a close for a ticker, or None; `end` is not included.
    """
    registry, out = TickerRegistry(), spark.createDataFrame([], "sec_id string, trade_date date, close double")
    for t in normalise_tickers(list(tickers)):
        if (raw := vendor(t)) is None:
            continue
        rows = raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns])
        rows = rows.select(F.lit(registry.sec_id(t)).alias("sec_id"), F.col("date").cast("date").alias("trade_date"), F.col("close").cast("double").alias("close"))
        if start is not None:
            rows = rows.where(F.col("trade_date") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("trade_date") < F.lit(end))
        out = out.unionByName(rows)
    return out


def check_price_basis(catalog: Catalog, ranges: dict[str, tuple[float, float]], day: date) -> dict[str, float]:
    """The stored closes of securities on one day; raises if one lies outside its (low, high): stored prices are as traded.

    A security without a bar on that day is passed over.
    """
    rows = catalog.query("SELECT sec_id, close FROM fact_market_ohlcv_raw WHERE trade_date = ?", [day]).where(F.col("sec_id").isin(list(ranges)))
    found = {r.sec_id: r.close for r in rows.collect()}  # one bar for each security named
    for sec, close in found.items():
        low, high = ranges[sec]
        if not low < close < high:
            raise RuntimeError(f"{sec} closed at {close} on {day}, not between {low} and {high}: the prices stored are not as traded")
    return found
