"""Split adjustment: cumulative factors from the splits known at the time, and the way back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.temporal import to_utc
from tempora.operators.bitemporal import latest_per_key


def require(df: DataFrame, columns: set[str], what: str) -> None:
    if missing := columns - set(df.columns):
        raise ValueError(f"{what} lack {sorted(missing)}")


def split_events(splits: DataFrame) -> DataFrame:
    """Distinct splits with the time each was first known: copies of an event count once."""
    require(splits, {"sec_id", "ex_date", "split_ratio", "known_from"}, "splits")
    rows = to_utc(splits, "known_from").where(F.col("split_ratio").isNotNull())
    return rows.groupBy(F.col("sec_id").cast("string").alias("sec_id"), "ex_date", "split_ratio").agg(F.min("known_from").alias("known_from"))


def latest_bars(prices: DataFrame) -> DataFrame:
    """The last bar of each security and day, as it became known or was ingested.

    Where prices say neither, two bars of a day cannot be told apart: the plan fails on them.
    """
    order = [c for c in ("known_from", "ingestion_seq") if c in prices.columns]
    if order:
        return latest_per_key(prices, ["sec_id", "trade_date"], order)
    rows = prices.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("sec_id", "trade_date")))
    twice = F.raise_error(F.lit("a security has two bars of a day and nothing says which came last")).cast("boolean")
    return rows.where(F.when(F.col("_bars") > 1, twice).otherwise(True)).drop("_bars")


def factor(ratio: Column, applies: Column, power: int = -1) -> Column:
    """Product of ratio ** power over the rows where a condition holds; 1 if none."""
    value = F.try_divide(F.lit(1.0), ratio) if power < 0 else ratio
    return F.coalesce(F.product(F.when(applies, value)), F.lit(1.0))


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds `_splits`, the list of a security's distinct splits, which are few by nature: rows look their factors up in it."""
    s = split_events(splits).groupBy(F.col("sec_id").alias("_sec")).agg(F.collect_list(F.struct("ex_date", "known_from", "split_ratio")).alias("_of_sec"))
    nothing = F.array().cast(s.schema["_of_sec"].dataType)
    return rows.join(s, F.col("sec_id") == F.col("_sec"), "left").withColumn("_splits", F.coalesce("_of_sec", nothing)).drop("_sec", "_of_sec")


def product_of(test: Callable[[Column], Column], power: int = -1, of: str = "_splits") -> Column:
    """Product of ratio ** power over the splits in the list for which a condition holds; 1 if none."""

    def step(acc: Column, x: Column) -> Column:
        value = F.try_divide(F.lit(1.0), x["split_ratio"]) if power < 0 else x["split_ratio"]
        return F.when(test(x) & value.isNotNull(), acc * value).otherwise(acc)

    return F.aggregate(of, F.lit(1.0), step)


def caf_scalar(splits: DataFrame, sec_id: str, price_date: date, observed: datetime) -> float:
    """The factor of one price as seen at one time."""
    day = observed.date()
    s = split_events(splits).where(F.col("sec_id") == sec_id)
    hit = (F.col("ex_date") > F.lit(price_date)) & (F.col("ex_date") <= F.lit(day)) & (F.col("known_from") <= F.lit(observed).cast("timestamp_ntz"))
    return s.agg(factor(F.col("split_ratio"), hit).alias("caf")).first().caf


def caf_matrix(prices: DataFrame, splits: DataFrame, observations: DataFrame) -> DataFrame:
    """(sec_id, observation_timestamp, trade_date, close, caf, adj_close) for all bars of each observed security."""
    require(prices, {"sec_id", "trade_date", "close"}, "prices")
    require(observations, {"sec_id", "observation_timestamp"}, "observations")
    seen = to_utc(observations.select("sec_id", "observation_timestamp").distinct(), "observation_timestamp")
    bars = latest_bars(prices).select("sec_id", "trade_date", "close")
    at = F.col("observation_timestamp")
    seen = with_splits(seen, splits).withColumn("_splits", F.filter("_splits", lambda x: (x["ex_date"] <= F.to_date(at)) & (x["known_from"] <= at)))
    # A factor is a step function of the date: each bar looks it up in the short list of its observation.
    rows = seen.join(bars, "sec_id").withColumn("caf", product_of(lambda x: x["ex_date"] > F.col("trade_date")))
    return rows.select("sec_id", "observation_timestamp", "trade_date", "close", "caf", (F.col("close") * F.col("caf")).alias("adj_close"))


def adjusted_close_as_of(prices: DataFrame, splits: DataFrame, observed: datetime, sec_id: str) -> DataFrame:
    """The adjusted series of one security as seen at one time, by date."""
    bars = prices.where(F.col("sec_id") == sec_id)
    at = bars.select("sec_id").distinct().withColumn("observation_timestamp", F.lit(observed).cast("timestamp_ntz"))
    return caf_matrix(bars, splits, at).orderBy("trade_date")


def adj_close_pit(prices: DataFrame, splits: DataFrame | None) -> DataFrame:
    """(sec_id, trade_date, known_from, adj_close): each bar adjusted by the splits known when the bar was."""
    bars = to_utc(latest_bars(prices), "known_from").select("sec_id", "trade_date", "known_from", "close")
    if splits is None:
        return bars.withColumnRenamed("close", "adj_close")
    known = product_of(lambda x: (F.col("trade_date") < x["ex_date"]) & (x["known_from"] <= F.col("known_from")))
    return with_splits(bars, splits).select("sec_id", "trade_date", "known_from", (F.col("close") * known).alias("adj_close"))


def undo_adjustment(bars: DataFrame, splits: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """As-traded prices from prices that a vendor adjusted for all splits: times the ratios of later ex-dates."""
    rows = with_splits(bars, splits).withColumn("undo_factor", product_of(lambda x: x["ex_date"] > F.col("trade_date"), 1)).drop("_splits")
    for c in columns:
        if c in bars.columns:
            rows = rows.withColumn(c, F.col(c) * F.col("undo_factor"))
    return rows
