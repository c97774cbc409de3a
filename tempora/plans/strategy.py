"""Momentum strategy with inverse-volatility weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.temporal import iso_weekday
from tempora.operators.adjustment import require

FLAT = 1e-12  # a deviation below it is that of a flat series


@dataclass(frozen=True)
class StrategyConfig:
    top_n: int = 10
    rebalance_frequency: str = "daily"
    weekly_rebalance_day: int = 0
    require_eps_above: float | None = None
    level_column: str = "close"
    require_price_above: float | None = None
    carry_forward: bool = True

    def __post_init__(self) -> None:
        if self.top_n < 1:
            raise ValueError("top_n must be 1 or more")
        if self.rebalance_frequency not in ("daily", "weekly"):
            raise ValueError("rebalance_frequency is daily or weekly")
        if not 0 <= self.weekly_rebalance_day <= 6:
            raise ValueError("weekly_rebalance_day lies in 0..6")
        for v in (self.require_eps_above, self.require_price_above):
            if v is not None and v <= 0:
                raise ValueError("thresholds are positive")


def price_column_of(df: DataFrame, wanted: str | None = None) -> str:
    for c in [wanted] if wanted else ["adj_close", "price", "close"]:
        if c in df.columns:
            return c
    raise ValueError("features have no price column")


def eligible(config: StrategyConfig, price: str) -> Column:
    """Whether a row may be held: warm indicators, some volatility, price above its average, and what the config asks."""
    tests = [
        F.col("momentum_20d").isNotNull(), F.coalesce(F.col("volatility_20d") > FLAT, F.lit(False)),
        F.coalesce(F.col(price) > F.col("sma_50d"), F.lit(False)),
    ]
    if config.require_eps_above is not None:
        tests.append(F.coalesce(F.col("metric_value") > config.require_eps_above, F.lit(False)))
    if config.require_price_above is not None:
        tests.append(F.coalesce(F.col(config.level_column) > config.require_price_above, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def momentum_rank(*also: str) -> Column:
    """Rank by momentum among the rows of a time, and of what else is named; ties by security."""
    return F.row_number().over(Window.partitionBy("observation_timestamp", *also).orderBy(F.desc("momentum_20d"), "sec_id"))


def top_momentum(features: DataFrame, config: StrategyConfig | None = None, *, price_column: str | None = None) -> DataFrame:
    """The eligible rows of each time with the best `momentum_rank`, top_n at most; each task keeps no more of a time."""
    config = config or StrategyConfig()
    rows = features.where(eligible(config, price_column_of(features, price_column)))
    return rows.withColumn("momentum_rank", momentum_rank()).where(F.col("momentum_rank") <= config.top_n)


def target_weights(features: DataFrame, config: StrategyConfig | None = None, *, price_column: str | None = None) -> DataFrame:
    """(observation_timestamp, sec_id, weight): the top names by momentum, weighted by inverse volatility.

    Conditional windows over one time do it without a join. In weekly mode a name keeps its last weight until it gets
    another (`carry_forward`), and only the rebalancing weekday stays.
    """
    config = config or StrategyConfig()
    price = price_column_of(features, price_column)
    require(features, {"observation_timestamp", "sec_id", "momentum_20d", "volatility_20d", "sma_50d"}, "features")
    day = iso_weekday(F.col("observation_timestamp")) == config.weekly_rebalance_day + 1
    weekly = config.rebalance_frequency == "weekly"
    test = eligible(config, price) & day if weekly else eligible(config, price)
    rows = features.withColumn("_ok", test)
    rows = rows.withColumn("_held", F.col("_ok") & (momentum_rank("_ok") <= config.top_n))
    inverse = F.when(F.col("_held"), F.try_divide(F.lit(1.0), F.col("volatility_20d")))
    rows = rows.withColumn("_inv", inverse)
    total = F.sum("_inv").over(Window.partitionBy("observation_timestamp"))
    rows = rows.withColumn("weight", F.coalesce(F.try_divide(F.col("_inv"), total), F.lit(0.0)))
    if weekly:
        if config.carry_forward:
            past = Window.partitionBy("sec_id").orderBy("observation_timestamp").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("weight", F.coalesce(F.last(F.nullif(F.col("weight"), F.lit(0.0)), ignorenulls=True).over(past), F.lit(0.0)))
        rows = rows.where(day)
    return rows.select("observation_timestamp", "sec_id", "weight")


def held_weights(features: DataFrame, config: StrategyConfig | None = None, *, price_column: str | None = None) -> DataFrame:
    """The rows of `target_weights` that are not 0. In daily mode no more than top_n rows of a time leave a task."""
    config = config or StrategyConfig()
    if config.rebalance_frequency == "weekly":
        return target_weights(features, config, price_column=price_column).where("weight != 0")
    require(features, {"observation_timestamp", "sec_id", "momentum_20d", "volatility_20d", "sma_50d"}, "features")
    rows = top_momentum(features, config, price_column=price_column).withColumn("_inv", F.try_divide(F.lit(1.0), F.col("volatility_20d")))
    total = F.sum("_inv").over(Window.partitionBy("observation_timestamp"))
    rows = rows.withColumn("weight", F.coalesce(F.try_divide(F.col("_inv"), total), F.lit(0.0)))
    return rows.select("observation_timestamp", "sec_id", "weight").where("weight != 0")
