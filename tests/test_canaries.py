"""Each canary: the point-in-time result is the truth, and a careless pipeline differs."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tempora.functions.calendar import TradingCalendar
from tempora.operators import adjustment, asof, bitemporal, entity

D = datetime
FACT = "sec_id string, metric_value double, known_from timestamp_ntz, ingestion_seq long"


def observations(spark, *times, sec="A"):
    return spark.createDataFrame([(sec, t) for t in times], "sec_id string, observation_timestamp timestamp_ntz")


def series(df, column):
    return [r[column] for r in df.orderBy("observation_timestamp").collect()]


def test_01_restatement(spark):
    f = spark.createDataFrame([("A", 1.0, D(2023, 11, 1, 17, 30), 1), ("A", 0.7, D(2023, 11, 15, 17, 30), 2)], FACT)
    o = observations(spark, D(2023, 11, 2), D(2023, 11, 15, 17, 29), D(2023, 11, 15, 17, 30), D(2023, 12, 1))
    got = asof.asof_join(o, bitemporal.derive_known_to(f, "sec_id"))
    assert series(got, "metric_value") == [1.0, 1.0, 0.7, 0.7]
    latest = f.groupBy("sec_id").agg(F.max_by("metric_value", "known_from").alias("metric_value"))
    assert series(o.join(latest, "sec_id"), "metric_value") == [0.7] * 4


def test_02_retroactive_split(spark):
    prices = spark.createDataFrame([("A", date(2020, 8, 28), 400.0)], "sec_id string, trade_date date, close double")
    splits = spark.createDataFrame([("A", date(2020, 8, 31), 4.0, D(2020, 8, 31, 13))], "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    got = adjustment.caf_matrix(prices, splits, observations(spark, D(2020, 8, 28, 21, 30), D(2020, 9, 1, 21, 30)))
    assert series(got, "caf") == [1.0, 0.25] and series(got, "adj_close") == [400.0, 100.0]
    assert adjustment.caf_scalar(splits, "A", date(2020, 8, 28), D(2020, 9, 1)) == 0.25
    assert adjustment.caf_scalar(splits, "A", date(2020, 8, 28), D(2020, 8, 30)) == 1.0


def test_03_after_hours(spark):
    friday = D(2024, 3, 15, 21, 0)  # 17:00 in New York
    at = TradingCalendar().actionable(friday).replace(tzinfo=None)
    assert at == D(2024, 3, 18, 13, 30)
    f = spark.createDataFrame([("A", 2.5, at, 1)], FACT)
    o = observations(spark, D(2024, 3, 15, 22), D(2024, 3, 18, 13, 29), D(2024, 3, 18, 13, 30))
    assert series(asof.asof_join(o, f), "metric_value") == [None, None, 2.5]


def _map(spark):
    rows = [("S1", "LEH", D(1994, 1, 1), 1), ("S1", "LEHMQ", D(2008, 9, 17), 2), ("S2", "FB", D(2012, 5, 18), 1), ("S2", "META", D(2022, 6, 9), 2)]
    return bitemporal.derive_valid_to(spark.createDataFrame(rows, "sec_id string, ticker string, valid_from timestamp_ntz, ingestion_seq long"), "sec_id")


def test_04_delisting_and_06_rename(spark):
    m = _map(spark)
    assert [entity.resolve_ticker(m, "S1", t) for t in ("2008-09-16", "2008-09-17")] == ["LEH", "LEHMQ"]
    assert [entity.resolve_sec_id(m, " fb ", t) for t in ("2022-06-08", "2022-06-09")] == ["S2", None]
    assert [entity.resolve_ticker(m, "S2", t) for t in ("2013-01-01", "2022-06-08", "2022-06-09", "2024-01-01")] == ["FB", "FB", "META", "META"]
    asked = spark.createDataFrame([("META", D(2023, 1, 1)), ("META", D(2020, 1, 1))], "ticker string, as_of timestamp_ntz")
    got = {r.as_of.year: r.sec_id for r in entity.resolve_many(asked, m, "ticker", "sec_id").collect()}
    assert got == {2023: "S2", 2020: None}


def test_05_filing_lag(spark):
    f = spark.createDataFrame([("A", 2.10, D(2023, 2, 1), 1), ("A", 1.52, D(2023, 5, 3), 2)], FACT)
    o = observations(spark, D(2023, 3, 31), D(2023, 5, 2), D(2023, 5, 3), D(2023, 6, 1))
    assert series(asof.asof_join(o, f), "metric_value") == [2.10, 2.10, 1.52, 1.52]


def test_07_demo(spark):
    """The seeded comparison gives its published figures."""
    from tempora.plans.metrics import tear_sheet
    from tempora.plans.runner import demo

    arms = demo(spark, date(2020, 1, 1), date(2023, 12, 31))
    sheet = tear_sheet(arms.leaky.simulation, arms.corrected.simulation)
    assert round(sheet.leaky.cumulative_return, 4) == 0.4664 and round(sheet.corrected.cumulative_return, 4) == 0.3070
    assert round(sheet.leaky.sharpe_ratio, 3) == 0.558 and round(sheet.corrected.sharpe_ratio, 3) == 0.423
    assert round(sheet.corrected.max_drawdown, 4) == -0.2829 and round(sheet.corrected.mean_turnover, 3) == 0.270
    assert "sharpe_ratio" in sheet.render()
