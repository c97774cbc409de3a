"""Nine performance metrics of a simulation, in one aggregation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
NONE = 1e-12  # denominators below it count as zero


@dataclass(frozen=True)
class Metrics:
    cumulative_return: float | None = None
    cagr: float | None = None
    annualized_volatility: float | None = None
    sharpe_ratio: float | None = None
    max_drawdown: float | None = None
    calmar_ratio: float | None = None
    win_rate: float | None = None
    profit_factor: float | None = None
    mean_turnover: float | None = None

    def as_dict(self) -> dict[str, float | None]:
        return asdict(self)


NAMES = [f.name for f in fields(Metrics)]


def drawdown_series(simulation: DataFrame) -> DataFrame:
    """(observation_timestamp, equity, peak, drawdown); the peak starts at the first equity."""
    past = Window.orderBy("observation_timestamp").rowsBetween(Window.unboundedPreceding, 0)
    rows = simulation.select("observation_timestamp", "equity").withColumn("peak", F.max("equity").over(past))
    return rows.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1))


def metrics_frame(simulation: DataFrame, periods_per_year: int = TRADING_DAYS, initial_capital: float = 1.0) -> DataFrame:
    """One row of metrics; a metric is null where it is not defined or its series is not finite."""
    if periods_per_year < 1:
        raise ValueError("periods_per_year must be 1 or more")
    past = Window.orderBy("observation_timestamp").rowsBetween(Window.unboundedPreceding, 0)
    rows = simulation.withColumn("_peak", F.max("equity").over(past))
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    r, e = F.col("net_return"), F.col("equity")
    years = (F.unix_micros(F.max("observation_timestamp").cast("timestamp")) - F.unix_micros(F.min("observation_timestamp").cast("timestamp"))) / (365.25 * 86_400 * 1e6)
    a = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(bad(e)).alias("bad_e"), F.max(bad(r)).alias("bad_r"), F.max(bad(F.col("turnover"))).alias("bad_t"),
        F.max_by("equity", "observation_timestamp").alias("last"), years.alias("years"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.min(F.when(F.col("_peak") > 0, e / F.col("_peak") - 1)).alias("mdd"), F.min("_peak").alias("low_peak"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("wins"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gains"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("losses"), F.avg("turnover").alias("mean_t"),
    )
    ok_e, ok_r, ok_t = ((F.col("n") > 0) & ~F.col(c) for c in ("bad_e", "bad_r", "bad_t"))
    vol = F.when(ok_r & (F.col("n") >= 2), F.col("sd") * F.sqrt(F.lit(float(periods_per_year))))
    cagr = F.when(ok_e & (F.col("years") > 0) & (F.col("last") > 0), F.pow(F.col("last") / initial_capital, F.lit(1.0) / F.nullif("years", F.lit(0.0))) - 1)
    mdd = F.when(ok_e & (F.col("low_peak") > 0), F.col("mdd"))
    return a.select(
        F.when(ok_e, F.col("last") / initial_capital - 1).alias("cumulative_return"),
        cagr.alias("cagr"),
        vol.alias("annualized_volatility"),
        F.when(vol > NONE, F.col("mean") * periods_per_year / vol).alias("sharpe_ratio"),
        mdd.alias("max_drawdown"),
        F.when(F.abs(mdd) > NONE, cagr / F.abs(mdd)).alias("calmar_ratio"),
        F.when(ok_r, F.col("wins")).alias("win_rate"),
        F.when(ok_r & (F.col("losses") > NONE), F.col("gains") / F.col("losses")).alias("profit_factor"),
        F.when(ok_t, F.col("mean_t")).alias("mean_turnover"),
    )


def compute_metrics(simulation: DataFrame, periods_per_year: int = TRADING_DAYS, initial_capital: float = 1.0) -> Metrics:
    return Metrics(**metrics_frame(simulation, periods_per_year, initial_capital).first().asDict())


@dataclass(frozen=True)
class TearSheet:
    """Metrics of both arms and corrected less leaky, null where either is."""

    leaky: Metrics
    corrected: Metrics
    delta: Metrics

    def render(self) -> str:
        lines = [f"{'metric':<24}{'leaky':>14}{'corrected':>14}{'delta':>14}"]
        for n in NAMES:
            values = [getattr(m, n) for m in (self.leaky, self.corrected, self.delta)]
            lines.append(f"{n:<24}" + "".join(f"{'n/a' if v is None else format(v, '.4f'):>14}" for v in values))
        return "\n".join(lines)


def tear_sheet(leaky: DataFrame, corrected: DataFrame, periods_per_year: int = TRADING_DAYS, initial_capital: float = 1.0) -> TearSheet:
    a, b = (compute_metrics(s, periods_per_year, initial_capital) for s in (leaky, corrected))
    delta = {n: None if x is None or y is None else y - x for n, x, y in ((n, getattr(a, n), getattr(b, n)) for n in NAMES)}
    return TearSheet(a, b, Metrics(**delta))
