"""The built-in features and their as-of computation for observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.adjustment import adj_close_pit
from tempora.operators.asof import asof_join, observation_matrix
from tempora.operators.indicators import pit_indicators
from tempora.plans.registry import FeatureContext, FeatureRegistry, global_registry, register

DEFAULT_FEATURES = ("adj_close", "momentum_20d", "volatility_20d", "sma_50d", "ema_50d")
KEYS = ("sec_id", "trade_date", "known_from")


def _indicators(ctx: FeatureContext) -> DataFrame:
    """All indicators come from one frame, made once for a context."""
    if "indicators" not in ctx.custom:
        ctx.custom["indicators"] = pit_indicators(ctx.resolve_prices(), ctx.resolve_splits())
    return ctx.custom["indicators"]


@register(name="adj_close", version="2.0.0", description="close adjusted by the splits known when the bar was")
def adj_close(ctx: FeatureContext) -> DataFrame:
    """From the indicators' frame where that is made anyway."""
    return _indicators(ctx).select(*KEYS, "adj_close") if ctx.custom.get("wide") else adj_close_pit(ctx.resolve_prices(), ctx.resolve_splits())


@register(name="momentum_20d", version="2.0.0", dependencies=["adj_close"])
def momentum_20d(ctx: FeatureContext) -> DataFrame:
    return _indicators(ctx).select(*KEYS, "momentum_20d")


@register(name="volatility_20d", version="2.0.0", dependencies=["adj_close"])
def volatility_20d(ctx: FeatureContext) -> DataFrame:
    return _indicators(ctx).select(*KEYS, "volatility_20d")


@register(name="sma_50d", version="2.0.0", dependencies=["adj_close"])
def sma_50d(ctx: FeatureContext) -> DataFrame:
    return _indicators(ctx).select(*KEYS, "sma_50d")


@register(name="ema_50d", version="2.0.0", dependencies=["adj_close"])
def ema_50d(ctx: FeatureContext) -> DataFrame:
    return _indicators(ctx).select(*KEYS, "ema_50d")


def features_as_of(
    observations: DataFrame, names: Sequence[str] = DEFAULT_FEATURES, prices: DataFrame | None = None, splits: DataFrame | None = None, *, catalog=None, registry: FeatureRegistry | None = None
) -> DataFrame:
    """Observations with the last value of each feature that was known at the time.

    Features are computed in dependency order. Those whose rows are keyed like bars are joined as one wide frame, so
    that any number of them costs one as-of join; others are joined one by one. Observations without a key or a time
    make the plan fail.
    """
    seen = observation_matrix(observations, reject_nulls=True)
    ctx = FeatureContext(observations=seen, prices=prices, splits=splits, catalog=catalog)
    registry = registry or global_registry()
    order = registry.execution_order(names)
    wide = [adj_close, momentum_20d, volatility_20d, sma_50d, ema_50d]
    ctx.custom["wide"] = any(f in wide[1:] for f in order)
    for f in order:
        ctx.custom[f.name] = f.compute_fn(ctx)
    indicators = [n for n in names if "indicators" in ctx.custom and registry.get(n) in wide]
    out = seen
    if indicators:
        frame = ctx.custom["indicators"].select(*KEYS, *indicators)
        out = asof_join(out, frame.withColumn("ingestion_seq", F.datediff("trade_date", F.lit("1970-01-01"))), right_on="known_from", payload=indicators)
    for n in names:
        if n not in indicators:
            frame = ctx.custom[n]
            out = asof_join(out, frame, payload=[n] if n in frame.columns else None)
    return out.select(*seen.columns, *[n for n in names if n in out.columns], *[c for c in out.columns if c not in seen.columns and c not in names])
