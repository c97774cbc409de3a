"""Portfolio simulation: split-neutral returns, drifted weights, turnover, costs, equity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.adjustment import factor, require, split_events
from tempora.session import stored

BITS = 64  # rebalancing times that one number marks for a security
FEW = 200_000  # rows that are sent to every task, at most; more are dealt out by their keys


@dataclass(frozen=True)
class SimulationConfig:
    transaction_cost_bps: float = 5.0
    price_column: str = "price"
    initial_capital: float = 1.0

    def __post_init__(self) -> None:
        if self.transaction_cost_bps < 0 or not self.price_column or self.initial_capital <= 0:
            raise ValueError("cost is 0 or more, capital positive, the price column named")


def unique_keys(df: DataFrame, what: str) -> None:
    """Raise if a (time, security) stands twice; runs a job."""
    if not df.groupBy("observation_timestamp", "sec_id").count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"{what} hold a (time, security) twice")


def one_row_each(df: DataFrame, value: str, what: str) -> DataFrame:
    """(observation_timestamp, sec_id, value); the plan fails on a (time, security) that stands twice."""
    rows = df.groupBy("observation_timestamp", "sec_id").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit(f"{what} hold a (time, security) twice")).cast(df.schema[value].dataType)
    return rows.select("observation_timestamp", "sec_id", F.when(F.col("_n") == 1, F.col(value)).otherwise(twice).alias(value))


def next_times(weights: DataFrame) -> DataFrame:
    """(observation_timestamp, next_timestamp): one row for each rebalancing time but the last."""
    order = Window.orderBy("observation_timestamp")  # as many rows as rebalancing times
    times = weights.select("observation_timestamp").distinct()
    return times.withColumn("next_timestamp", F.lead("observation_timestamp").over(order)).where("next_timestamp is not null")


def period_returns(prices: DataFrame, times: DataFrame, price: str = "price", splits: DataFrame | None = None) -> DataFrame:
    """(observation_timestamp, next_timestamp, sec_id, asset_return), neutral to splits that go ex at the next time."""
    # The times of a simulation are few, by nature; the last one has prices too, but no next time.
    last = times.select(F.max("next_timestamp").alias("observation_timestamp"), F.lit(None).cast("timestamp_ntz").alias("next_timestamp"))
    p = prices.select("observation_timestamp", "sec_id", F.col(price).alias("current_price")).join(F.broadcast(times.unionByName(last)), "observation_timestamp")
    line = Window.partitionBy("sec_id").orderBy("observation_timestamp")
    after = F.lead(F.struct("observation_timestamp", "current_price")).over(line)
    rows = p.withColumn("_after", after).where(F.col("_after.observation_timestamp") == F.col("next_timestamp"))
    rows = rows.select("next_timestamp", "sec_id", "observation_timestamp", "current_price", F.col("_after.current_price").alias("next_price"))
    if splits is None:
        rows = rows.withColumn("split_ratio", F.lit(1.0))
    else:
        s = split_events(splits)
        day = s.select(F.col("sec_id").alias("_sec"), "ex_date", F.col("split_ratio").alias("_ratio"), "known_from")
        hit = (F.col("sec_id") == F.col("_sec")) & (F.col("ex_date") == F.to_date("next_timestamp")) & (F.col("known_from") <= F.col("next_timestamp"))
        keys = ["observation_timestamp", "next_timestamp", "sec_id", "current_price", "next_price"]
        rows = rows.join(day, hit, "left").groupBy(*keys).agg(factor(F.col("_ratio"), F.col("_ratio").isNotNull(), 1).alias("split_ratio"))
    value = F.try_divide(F.col("next_price"), F.col("current_price")) * F.col("split_ratio") - 1
    return rows.select("observation_timestamp", "next_timestamp", "sec_id", value.alias("asset_return"))


def drifted_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(observation_timestamp, next_timestamp, sec_id, weight, asset_return, drifted_weight)."""
    rows = weights.select("observation_timestamp", "sec_id", "weight").join(returns, ["observation_timestamp", "sec_id"])
    whole = F.sum(F.col("weight") * F.col("asset_return")).over(Window.partitionBy("observation_timestamp"))
    return rows.withColumn("drifted_weight", F.try_divide(F.col("weight") * (1 + F.col("asset_return")), 1 + whole))


def turnover_of(weights: DataFrame, drifted: DataFrame) -> DataFrame:
    """(observation_timestamp, turnover): how far weights are from what the last ones drifted to."""
    d = drifted.select(F.col("next_timestamp").alias("observation_timestamp"), "sec_id", "drifted_weight")
    rows = weights.join(d, ["observation_timestamp", "sec_id"], "left")
    return rows.groupBy("observation_timestamp").agg(F.sum(F.abs(F.col("weight") - F.coalesce("drifted_weight", F.lit(0.0)))).alias("turnover"))


def gross_returns(drifted: DataFrame) -> DataFrame:
    return drifted.groupBy("observation_timestamp").agg(F.sum(F.col("weight") * F.col("asset_return")).alias("gross_return"))


def equity_curve(returns: DataFrame, initial_capital: float = 1.0) -> DataFrame:
    """Adds `equity`, the running product of 1 + net_return; one row for each time."""
    past = Window.orderBy("observation_timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.product(1 + F.col("net_return")).over(past) * initial_capital)


def _slots(cells: DataFrame) -> DataFrame:
    """(observation_timestamp, next_timestamp, _cells, _word, _bit): the rebalancing times, numbered by word and bit."""
    rows = cells.where("observation_timestamp is not null").groupBy("observation_timestamp").agg(F.count(F.lit(1)).alias("_cells"))
    order = Window.orderBy("observation_timestamp")  # as many rows as rebalancing times
    rows = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("next_timestamp", F.lead("observation_timestamp").over(order))
    return rows.select("observation_timestamp", "next_timestamp", "_cells", F.floor(F.col("_n") / BITS).cast("int").alias("_word"), (F.col("_n") % BITS).alias("_bit"))


def _presence(cells: DataFrame, prices: DataFrame, price: str, slots: DataFrame) -> DataFrame:
    """(_word, _paired, _valued, _twice): the times at which a security has a weight and two prices, and has a return.

    Rows become bits of a security before they are dealt out, so that a shuffle carries one row for BITS times. A
    (time, security) that stands twice shows as more rows than bits.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    flag = lambda c: F.when(c, one).otherwise(none)
    marks = cells.select("observation_timestamp", "sec_id", one.alias("_c"), none.alias("_p"), none.alias("_now"), none.alias("_then"))
    given = F.col(price).isNotNull()
    marks = marks.union(prices.select("observation_timestamp", "sec_id", none, one, flag(given & (F.col(price) != 0)), flag(given)))
    marks = marks.join(F.broadcast(slots.select("observation_timestamp", "_word", "_bit")), "observation_timestamp")
    names = ["_c", "_p", "_now", "_then"]
    bits = [F.bit_or(F.call_function("shiftleft", F.col(c), F.col("_bit"))).alias(c) for c in names]
    rows = marks.groupBy("sec_id", "_word").agg(F.sum("_c").alias("_cs"), F.sum("_p").alias("_ps"), *bits)
    rows = rows.withColumn("_next", F.lead(F.struct("_word", "_p", "_then")).over(Window.partitionBy("sec_id").orderBy("_word")))

    def at_next(c: str):
        first = F.when(F.col("_next._word") == F.col("_word") + 1, F.col(f"_next.{c}").bitwiseAND(one)).otherwise(none)
        return F.shiftrightunsigned(c, 1).bitwiseOR(F.call_function("shiftleft", first, F.lit(BITS - 1)))

    named = F.col("sec_id").isNotNull()
    paired = F.when(named, F.col("_c").bitwiseAND(F.col("_p")).bitwiseAND(at_next("_p"))).otherwise(none)
    valued = F.when(named, F.col("_c").bitwiseAND(F.col("_now")).bitwiseAND(at_next("_then"))).otherwise(none)
    twice = (F.col("_cs") > F.bit_count("_c")) | (F.col("_ps") > F.bit_count("_p"))
    return rows.groupBy("_word").agg(F.bit_or(paired).alias("_paired"), F.bit_or(valued).alias("_valued"), F.max(twice).alias("_twice"))


@dataclass(frozen=True)
class _Held:
    """What is held and what it drifts to: (observation_timestamp, sec_id, weight) of names held or held the time before."""

    cells: DataFrame
    slots: DataFrame
    drifted: DataFrame
    turnover: DataFrame


def _held(weights: DataFrame, prices: DataFrame, price: str, splits: DataFrame | None, within: DataFrame | None) -> _Held:
    """Weights of 0 count for nothing, unless the security was held the time before: others never enter a shuffle."""
    keys = ["observation_timestamp", "sec_id"]
    cells = (weights if within is None else within).select(*keys)
    held = stored(one_row_each(weights.where(~F.col("weight").eqNullSafe(F.lit(0.0))), "weight", "weights"))
    slots = stored(_slots(cells))
    times = slots.where("next_timestamp is not null").select("observation_timestamp", "next_timestamp")
    few = held.count() <= FEW
    sent = F.broadcast if few else lambda rows: rows
    after = held.join(F.broadcast(times), "observation_timestamp").select(F.col("next_timestamp").alias("observation_timestamp"), "sec_id")
    left = after.join(held, keys, "left_anti")
    some = stored(held.unionByName(cells.join(sent(left), keys, "left_semi").withColumn("weight", F.lit(0.0))))
    priced = stored(prices.select(*keys, price).join(sent(held.select(*keys).union(left)), keys, "left_semi"))
    returns = period_returns(one_row_each(priced, price, "prices"), times, price, splits)
    drifted = drifted_weights(some, returns)
    unknown = held.where("weight is null").groupBy("observation_timestamp").agg(F.count(F.lit(1)).alias("_unknown"))
    turned = slots.select("observation_timestamp", "_cells").join(turnover_of(some, drifted), "observation_timestamp", "left").join(unknown, "observation_timestamp", "left")
    rest = F.when(F.col("_cells") > F.coalesce("_unknown", F.lit(0)), F.lit(0.0))
    return _Held(cells, slots, drifted, turned.select("observation_timestamp", F.coalesce("turnover", rest).alias("turnover")))


def turnovers(weights: DataFrame, prices: DataFrame, price: str = "price", splits: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(observation_timestamp, turnover) of every rebalancing time; see `simulate` for `within`."""
    return _held(weights, prices, price, splits, within).turnover


def simulate(
    weights: DataFrame, prices: DataFrame, config: SimulationConfig | None = None, splits: DataFrame | None = None, *, check: bool = False, within: DataFrame | None = None
) -> DataFrame:
    """(observation_timestamp, gross_return, turnover, cost, net_return, equity).

    The last time has no row; a security without a next price drops out of the interval. A (time, security) that stands
    twice in weights or prices makes the plan fail; `check` rejects it at once, by two jobs. A weight of 0 earns 0, at
    whatever return. `within` are (time, security) rows, those of `weights` among them: what `weights` leave out of them
    has the weight 0, so that only held rows need to be listed. What is held is written to the shared folder once.
    """
    config = config or SimulationConfig()
    require(weights, {"observation_timestamp", "sec_id", "weight"}, "weights")
    require(prices, {"observation_timestamp", "sec_id", config.price_column}, "prices")
    if check:
        unique_keys(weights, "weights")
        unique_keys(prices, "prices")
    held = _held(weights, prices, config.price_column, splits, within)
    rows = held.slots.join(F.broadcast(_presence(held.cells, prices, config.price_column, held.slots)), "_word")
    twice = F.raise_error(F.lit("weights or prices hold a (time, security) twice")).cast("boolean")
    rows = rows.where(F.when(F.col("_twice"), twice).otherwise(F.getbit("_paired", F.col("_bit")) == 1))
    rows = rows.join(gross_returns(held.drifted), "observation_timestamp", "left").join(held.turnover, "observation_timestamp", "left")
    gross = F.coalesce("gross_return", F.when(F.getbit("_valued", F.col("_bit")) == 1, F.lit(0.0)))
    rows = rows.select("observation_timestamp", gross.alias("gross_return"), "turnover")
    rows = rows.withColumn("cost", F.col("turnover") * (config.transaction_cost_bps / 10_000))
    rows = rows.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return equity_curve(rows, config.initial_capital)
