"""One strategy on two data pipelines: as it was known, and as a careless pipeline would have it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.temporal import at_time, start_of_day, to_utc
from tempora.operators.asof import asof_join_many
from tempora.plans.features import DEFAULT_FEATURES, features_as_of
from tempora.plans.simulation import SimulationConfig, simulate
from tempora.plans.strategy import StrategyConfig, held_weights, target_weights
from tempora.session import stored

DEFAULT_UNIVERSE = ("AAPL", "MSFT", "NVDA", "META", "GOOGL")


@dataclass(frozen=True)
class Arm:
    features: DataFrame
    weights: DataFrame
    simulation: DataFrame


@dataclass(frozen=True)
class Comparison:
    leaky: Arm
    corrected: Arm


def universe_ids(universe: Sequence[str]) -> list[str]:
    """Security ids of a universe that may name bare tickers."""
    return [u if u.startswith("SEC_") else f"SEC_{u.strip().upper()}_001" for u in universe]


def observation_grid(prices: DataFrame, sec_ids: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Every security at 21:30 UTC of every day that any security traded; both sides are short lists."""
    rows = universe_between(prices, sec_ids, start, end)
    days = rows.select("trade_date").distinct()
    secs = rows.select("sec_id").distinct()
    return secs.crossJoin(F.broadcast(days)).select("sec_id", at_time(F.col("trade_date"), 21, 30).alias("observation_timestamp"))


def universe_between(prices: DataFrame, sec_ids: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Bars of some securities within inclusive dates; both conditions reach the scan."""
    if sec_ids is not None:
        prices = prices.where(F.col("sec_id").isin(list(sec_ids)))
    if start is not None:
        prices = prices.where(F.col("trade_date") >= F.lit(start))
    if end is not None:
        prices = prices.where(F.col("trade_date") <= F.lit(end))
    return prices


def require_tickers(prices: DataFrame, sec_ids: Sequence[str]) -> None:
    found = {r.sec_id for r in prices.where(F.col("sec_id").isin(list(sec_ids))).select("sec_id").distinct().collect()}
    if missing := sorted(set(sec_ids) - found):
        raise ValueError(f"no prices for {missing}")


def leaky_prices(prices: DataFrame) -> DataFrame:
    """Closes as if known when their day began."""
    if missing := {"sec_id", "trade_date", "close"} - set(prices.columns):
        raise ValueError(f"prices lack {sorted(missing)}")
    return prices.withColumn("known_from", F.col("trade_date").cast("timestamp_ntz"))


def leaky_view(view: DataFrame) -> DataFrame:
    """Facts as if known when the day of their knowledge began."""
    return to_utc(view, "known_from").withColumn("known_from", start_of_day(F.col("known_from")))


def simulation_prices(features: DataFrame, column: str = "adj_close") -> DataFrame:
    return features.select("observation_timestamp", "sec_id", F.col(column).alias("price")).dropna(subset=["price"])


def corrected_features(observations: DataFrame, prices: DataFrame, splits: DataFrame | None = None, names: Sequence[str] = DEFAULT_FEATURES, views: Sequence[DataFrame] = ()) -> DataFrame:
    return asof_join_many(features_as_of(observations, names, prices, splits), views)


def leaky_features(observations: DataFrame, preadjusted: DataFrame, names: Sequence[str] = DEFAULT_FEATURES, views: Sequence[DataFrame] = (), universe: Sequence[str] = DEFAULT_UNIVERSE) -> DataFrame:
    seen = observations.where(F.col("sec_id").isin(universe_ids(universe)))
    return asof_join_many(features_as_of(seen, names, leaky_prices(preadjusted)), [leaky_view(v) for v in views])


def run_comparison(
    observations: DataFrame, raw: DataFrame, preadjusted: DataFrame, splits: DataFrame | None = None, strategy: StrategyConfig | None = None, simulation: SimulationConfig | None = None,
    names: Sequence[str] = DEFAULT_FEATURES, leaky_views: Sequence[DataFrame] = (), corrected_views: Sequence[DataFrame] = (), leaky_universe: Sequence[str] = DEFAULT_UNIVERSE, raw_is_preadjusted: bool = False,
) -> Comparison:
    """Both arms with the same settings. Adjusted prices carry their splits already, so only the other arm applies them.

    Features are written to the shared folder once: weights, prices and what follows from them read them several times.
    """
    a = stored(leaky_features(observations, preadjusted, names, leaky_views, leaky_universe))
    b = stored(corrected_features(observations, raw, splits, names, corrected_views))
    wa, wb = target_weights(a, strategy), target_weights(b, strategy)
    return Comparison(
        Arm(a, wa, simulate(held_weights(a, strategy), simulation_prices(a), simulation, within=wa)),
        Arm(b, wb, simulate(held_weights(b, strategy), simulation_prices(b), simulation, None if raw_is_preadjusted else splits, within=wb)),
    )


def compare_arms(comparison: Comparison, columns: Sequence[str] = ("net_return", "equity", "turnover")) -> DataFrame:
    """(observation_timestamp, <column>_leaky, <column>_corrected, <column>_delta): every time that either arm has."""
    a, b = (arm.simulation.select("observation_timestamp", *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n, arm in (("leaky", comparison.leaky), ("corrected", comparison.corrected)))
    both = a.join(b, "observation_timestamp", "full")
    return both.select("*", *[(F.col(f"{c}_corrected") - F.col(f"{c}_leaky")).alias(f"{c}_delta") for c in columns])


def demo(spark: SparkSession, start, end, tickers: Sequence[str] = DEFAULT_UNIVERSE, top_n: int = 3, cost_bps: float = 5.0, seed: int | None = None) -> Comparison:
    """The comparison on the seeded market."""
    from tempora.plans import synthetic

    ids = tuple(universe_ids(tickers))
    raw, adjusted, splits, filings = synthetic.market(spark, ids, start, end, seed or synthetic.SEED)
    grid = observation_grid(raw)
    keep = ["sec_id", "metric_value", "known_from", "ingestion_seq"]
    return run_comparison(
        grid, raw, adjusted, splits, StrategyConfig(top_n=top_n, require_eps_above=synthetic.EPS_SCREEN), SimulationConfig(cost_bps),
        leaky_views=(synthetic.leaky_fundamentals(filings).select(*keep),), corrected_views=(filings.select(*keep, "known_to"),), leaky_universe=ids,
    )
