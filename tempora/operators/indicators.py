"""Rolling indicators on prices as they were known: each bar looks back on a series adjusted by the splits known then.

A knowledge state is the number of splits of a security known at a time. If a bar knows all splits that went ex up to its
day, its series is that adjusted for all splits of the security times one factor: the ratios of later splits that it does
not know yet. So one series for each security serves all such bars. Only for bars that lack a past split is the series
rebuilt in their states, and windows run within (security, state). One plan, no loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions.temporal import to_utc
from tempora.operators.adjustment import latest_bars, product_of, split_events, with_splits

EMA_BLOCK = 4096  # the closed form of the EMA stays in range of a double for so many rows


def rank_splits(splits: DataFrame) -> DataFrame:
    """Splits with their number in the order in which they became known."""
    order = Window.partitionBy("sec_id").orderBy("known_from", "ex_date", "split_ratio")
    return split_events(splits).withColumn("split_number", F.row_number().over(order))


def known_split_count(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with `known_splits`, the number of splits known when the bar was."""
    bars = to_utc(prices, "known_from").withColumn("sec_id", F.col("sec_id").cast("string"))
    s = split_events(splits).groupBy("sec_id").agg(F.array_sort(F.collect_list("known_from")).alias("_times"))  # a security's splits
    count = F.size(F.filter("_times", lambda t: t <= F.col("known_from")))
    return bars.join(s, "sec_id", "left").withColumn("known_splits", F.coalesce(F.when(F.col("_times").isNotNull(), count), F.lit(0))).drop("_times")


def by_state(prices: DataFrame, splits: DataFrame | None) -> DataFrame:
    """(sec_id, trade_date, known_from, close, known_splits, state, adj): all bars of a security in each of its states."""
    bars = latest_bars(prices).select("sec_id", "trade_date", "known_from", "close")
    if splits is None:
        bars = to_utc(bars, "known_from").withColumn("sec_id", F.col("sec_id").cast("string"))
        return bars.withColumns({"known_splits": F.lit(0), "state": F.lit(0), "adj": F.col("close")})
    bars = known_split_count(bars, splits)
    return _in_states(bars, bars.select("sec_id", F.col("known_splits").alias("state")).distinct(), splits)


def _in_states(bars: DataFrame, states: DataFrame, splits: DataFrame) -> DataFrame:
    s = rank_splits(splits).select(F.col("sec_id").alias("_sec"), F.col("ex_date").alias("_ex"), F.col("split_ratio").alias("_ratio"), "split_number")
    # One factor for each (security, state, split date): bars look theirs up in a short sorted list.
    steps = states.join(s, (F.col("sec_id") == F.col("_sec")) & (F.col("split_number") <= F.col("state")), "left")
    steps = steps.groupBy("sec_id", "state").agg(F.collect_list(F.when(F.col("_ex").isNotNull(), F.struct("_ex", "_ratio"))).alias("_steps"))
    rows = bars.join(steps, "sec_id")
    share = F.aggregate("_steps", F.lit(1.0), lambda acc, x: F.when(x["_ex"] > F.col("trade_date"), acc / x["_ratio"]).otherwise(acc))
    return rows.withColumn("adj", F.col("close") * share).drop("_steps")


def ema(x: Column, n: Column, order: WindowSpec, span: int) -> tuple[Column, Column]:
    """(term, local): see `pit_indicators`. n counts rows from 0."""
    alpha, beta = 2 / (span + 1), (span - 1) / (span + 1)
    m = n % EMA_BLOCK
    term = F.when(n == 0, x).otherwise(alpha * x * F.pow(F.lit(beta), -m))
    return term, F.pow(F.lit(beta), m)


def _rolling(rows: DataFrame, by: list[str], scale: Column) -> DataFrame:
    """Adds the indicators of the series `adj` within `by`; `scale` is the factor from its level to that of a bar's own."""
    order = Window.partitionBy(*by).orderBy("trade_date")
    last = lambda n: order.rowsBetween(1 - n, 0)
    rows = rows.withColumn("_ln", F.when(F.col("adj") > 0, F.log("adj")))
    rows = rows.select("*", (F.row_number().over(order) - 1).alias("_n"), (F.col("_ln") - F.lag("_ln", 1).over(order)).alias("log_return"), (F.exp(F.col("_ln") - F.lag("_ln", 20).over(order)) - 1).alias("momentum_20d"))
    # Within a block of rows the EMA is a running sum; of earlier blocks only the last value still counts in a double.
    term, weight = ema(F.col("adj"), F.col("_n"), order, 50)
    rows = rows.withColumn("_block", F.floor(F.col("_n") / EMA_BLOCK)).withColumn("_term", term)
    rows = rows.select(
        "*", F.when(F.count("log_return").over(last(20)) == 20, F.stddev_samp("log_return").over(last(20)) * math.sqrt(252)).alias("volatility_20d"),
        F.when(F.count("adj").over(last(50)) == 50, F.avg("adj").over(last(50)) * scale).alias("sma_50d"),
    )
    block = Window.partitionBy(*by, "_block").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("_term").over(block) * weight)
    ends = F.when(F.col("_n") % EMA_BLOCK == EMA_BLOCK - 1, F.struct("_n", "_local"))
    rows = rows.withColumn("_end", F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    carried = F.coalesce(F.col("_end._local") * F.pow(F.lit(49 / 51), F.col("_n") % EMA_BLOCK + 1), F.lit(0.0))
    rows = rows.withColumn("ema_50d", F.when(F.col("_n") >= 49, (F.col("_local") + carried) * scale))
    return rows.withColumn("adj_close", F.col("adj") * scale)


def pit_indicators(prices: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(sec_id, trade_date, known_from, known_splits, adj_close, log_return, momentum_20d, volatility_20d, sma_50d, ema_50d).

    adj_close: the bar's close in its own state; momentum: growth over 20 bars; volatility: sample deviation of 20 log
    returns, a year's; sma: mean of 50; ema: of span 50, seeded with the first price. Each is null until its window is
    full.
    """
    shown = ["sec_id", "trade_date", "known_from", "known_splits", "adj_close", "log_return", "momentum_20d", "volatility_20d", "sma_50d", "ema_50d"]
    bars = to_utc(latest_bars(prices).select("sec_id", "trade_date", "known_from", "close"), "known_from").withColumn("sec_id", F.col("sec_id").cast("string"))
    if splits is None:
        return _rolling(bars.withColumns({"known_splits": F.lit(0), "adj": F.col("close")}), ["sec_id"], F.lit(1.0)).select(*shown)
    known = lambda x: x["known_from"] <= F.col("known_from")
    later = lambda x: x["ex_date"] > F.col("trade_date")
    rows = with_splits(bars, splits)
    rows = rows.select(
        *bars.columns, F.size(F.filter("_splits", known)).alias("known_splits"), F.exists("_splits", lambda x: ~later(x) & ~known(x)).alias("_late"),
        (F.col("close") * product_of(later)).alias("adj"), product_of(lambda x: later(x) & ~known(x), 1).alias("_scale"),
    )
    most = _rolling(rows, ["sec_id"], F.col("_scale")).where("NOT _late").select(*shown)
    # A bar that does not know a past split yet looks back on a series of its own; few bars do.
    late = rows.where("_late").select("sec_id", F.col("known_splits").alias("state")).distinct()
    rest = _rolling(_in_states(rows.drop("adj", "_scale"), late, splits), ["sec_id", "state"], F.lit(1.0))
    return most.unionByName(rest.where("_late AND known_splits = state").select(*shown))
