import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.functions.calendar import TradingCalendar, early_closes, holidays
from tempora.functions.intervals import TransactionInterval, ValidInterval
from tempora.operators import adjustment, asof, bitemporal, entity, indicators
from tempora.plans import metrics, simulation, strategy
from tempora.plans.registry import CyclicDependencyError, DuplicateFeatureError, FeatureNotFoundError, FeatureRegistry

D = datetime


def test_time_and_bound_keys():
    assert asof.time_key(["a", "known_from"]) == "known_from"
    assert asof.time_key(["timestamp"]) == "timestamp"
    assert asof.bound_key(["known_to"]) == "known_to" and asof.bound_key(["x"]) is None
    for bad in (["known_from", "valid_from"], ["timestamp", "acceptance_time"], []):
        with pytest.raises(ValueError):
            asof.time_key(bad)
    with pytest.raises(ValueError):
        asof.bound_key(["known_to", "valid_to"])


def test_asof_ties_expiry_and_names(spark):
    f = spark.createDataFrame(
        [("A", 1.0, D(2024, 1, 1), D(2024, 1, 3), 1), ("A", 2.0, D(2024, 1, 1), D(2024, 1, 3), 2), ("B", None, D(2024, 1, 1), None, 1)],
        "sec_id string, v double, known_from timestamp_ntz, known_to timestamp_ntz, ingestion_seq long",
    )
    o = spark.createDataFrame([("A", D(2024, 1, 1), 9), ("A", D(2024, 1, 3), 8), ("B", D(2024, 1, 2), 7), ("C", D(2024, 1, 2), 6)], "sec_id string, observation_timestamp timestamp_ntz, v int")
    got = {r.v: r.v_feature for r in asof.asof_join(o, f).collect()}
    assert got == {9: 2.0, 8: None, 7: None, 6: None}
    kept = asof.asof_join(o, f, prefix="f_", keep_time=True)
    assert {"f_v", "f_known_from", "f_known_to"} <= set(kept.columns)


def test_asof_by_spans_is_the_same(spark, sf):
    from tempora import queries

    v, f = queries.views(spark, sf), queries.feature(spark, sf, "purchase")
    show = lambda df: sorted(map(repr, df.collect()))
    assert show(asof.asof_join(v, f)) == show(asof.asof_join(v, f, split_by="day"))


times = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), min_size=1, max_size=20)


@settings(max_examples=8, deadline=None)
@given(times)
def test_derived_intervals_tile(spark, rows):
    df = spark.createDataFrame([(k, D(2024, 1, 1) + timedelta(t), i) for i, (k, t) in enumerate(rows)], "k int, known_from timestamp_ntz, ingestion_seq long")
    got = {}
    for r in bitemporal.derive_known_to(df, "k").collect():
        got.setdefault(r.k, []).append((r.known_from, r.ingestion_seq, r.known_to))
    for facts in got.values():
        facts.sort()
        assert facts[-1][2] is None
        for a, b in zip(facts, facts[1:]):
            assert a[2] == b[0] >= a[0]
        for t in range(31):
            at = D(2024, 1, 1) + timedelta(t)
            live = [f for f in facts if f[0] <= at and (f[2] is None or at < f[2])]
            assert len(live) == (at >= facts[0][0])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 20), st.integers(1, 20), st.integers(0, 20), st.integers(1, 20))
def test_interval_models(a, n, b, m):
    d = lambda x: date(2024, 1, 1) + timedelta(x)
    x, y = ValidInterval(d(a), d(a + n)), ValidInterval(d(b), d(b + m))
    common = any(x.contains(d(i)) and y.contains(d(i)) for i in range(60))
    assert x.overlaps(y) == y.overlaps(x) == common
    with pytest.raises(ValueError):
        TransactionInterval(D(2024, 1, 2), D(2024, 1, 2))


def test_calendar():
    c = TradingCalendar()
    assert date(2024, 3, 29) in holidays(2024) and date(2021, 12, 24) in holidays(2021) and date(2022, 1, 1) not in holidays(2022)
    assert date(2023, 11, 24) in early_closes(2023) and date(2023, 7, 3) in early_closes(2023)
    assert not c.is_session(date(2012, 10, 29)) and c.next_session(date(2024, 3, 28)) == date(2024, 4, 1)
    assert c.previous_session(date(2024, 1, 2)) == date(2023, 12, 29)
    assert len(c.sessions(date(2023, 1, 1), date(2023, 12, 31))) == 250
    utc = lambda *a: c.actionable(D(*a)).replace(tzinfo=None)
    assert utc(2024, 3, 18, 12, 0) == D(2024, 3, 18, 13, 30) and utc(2024, 3, 18, 15, 0) == D(2024, 3, 18, 15, 0)
    assert utc(2024, 3, 18, 20, 0) == D(2024, 3, 19, 13, 30) and utc(2024, 3, 16, 15, 0) == D(2024, 3, 18, 13, 30)
    assert c.actionable(D(2023, 11, 24, 17), True).replace(tzinfo=None) == D(2023, 11, 24, 18, 15)
    assert c.actionable(D(2024, 3, 16, 17), True).replace(tzinfo=None) == D(2024, 3, 15, 20, 15)


def _bars(spark, closes, sec="A"):
    days = [date(2020, 1, 1) + timedelta(i) for i in range(len(closes))]
    rows = [(sec, d, c, D(d.year, d.month, d.day, 21)) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, "sec_id string, trade_date date, close double, known_from timestamp_ntz")


def test_indicators_against_loops(spark, monkeypatch):
    closes = [100 + 10 * math.sin(i / 3) + i / 5 for i in range(130)]
    splits = spark.createDataFrame(
        [("A", date(2020, 3, 1), 2.0, D(2020, 3, 1, 12)), ("A", date(2020, 3, 1), 2.0, D(2020, 3, 9, 12)), ("A", date(2020, 4, 1), 4.0, D(2020, 4, 1, 12))],
        "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz",
    )
    monkeypatch.setattr(indicators, "EMA_BLOCK", 64)
    # A block of 64 rows forgets what lies more than one block back; compare loosely there.
    rows = indicators.pit_indicators(_bars(spark, closes), splits).orderBy("trade_date").collect()
    assert [r.known_splits for r in rows] == [0] * 60 + [1] * 31 + [2] * 39
    for i, r in enumerate(rows):
        days = [date(2020, 1, 1) + timedelta(k) for k in range(i + 1)]
        known = [(date(2020, 3, 1), 2.0), (date(2020, 4, 1), 4.0)][: r.known_splits]
        adj = [c / math.prod(q for ex, q in known if d < ex) for c, d in zip(closes, days)]
        if i < 20:
            assert r.momentum_20d is None and r.volatility_20d is None
        else:
            logs = [math.log(b / a) for a, b in zip(adj, adj[1:])][-20:]
            assert r.momentum_20d == pytest.approx(adj[-1] / adj[-21] - 1)
            assert r.volatility_20d == pytest.approx(statistics.stdev(logs) * math.sqrt(252))
        if i < 49:
            assert r.sma_50d is None and r.ema_50d is None
        else:
            ema = adj[0]
            for x in adj[1:]:
                ema = 2 / 51 * x + 49 / 51 * ema
            assert r.sma_50d == pytest.approx(statistics.fmean(adj[-50:]))
            assert r.ema_50d == pytest.approx(ema, rel=2e-2 if i >= 128 else 1e-9)


def test_undo_adjustment(spark):
    splits = spark.createDataFrame([("A", date(2020, 1, 3), 4.0, D(2020, 1, 3))], "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    got = adjustment.undo_adjustment(_bars(spark, [1.0, 1.0, 1.0]), splits).orderBy("trade_date").collect()
    assert [r.close for r in got] == [4.0, 4.0, 1.0]
    with pytest.raises(ValueError):
        adjustment.caf_matrix(_bars(spark, [1.0]).drop("close"), splits, _bars(spark, [1.0]))


def test_anti_join_is_null_safe(spark):
    schema = "k int, v string, ingestion_seq long"
    new = spark.createDataFrame([(1, None, 5), (2, "b", 5)], schema)
    stored = spark.createDataFrame([(1, None, 1), (3, "c", 1)], schema)
    assert [r.k for r in bitemporal.without_persisted(new, stored).collect()] == [2]
    merged = bitemporal.merged_union(new, stored.drop("v"))
    assert merged.count() == 4 and merged.where("v is null").count() == 3


def test_strategy_simulation_metrics(spark):
    t = [D(2024, 1, d, 21, 30) for d in (1, 2, 3)]
    rows = [(x, s, m, v, 1.0, p) for x, prices in zip(t, ((10.0, 20.0), (11.0, 19.0), (5.5, 19.0))) for s, m, v, p in (("A", 0.2, 0.1, prices[0]), ("B", 0.1, 0.3, prices[1]))]
    f = spark.createDataFrame(rows, "observation_timestamp timestamp_ntz, sec_id string, momentum_20d double, volatility_20d double, sma_50d double, adj_close double")
    w = strategy.target_weights(f)
    assert {(r.observation_timestamp, r.sec_id): round(r.weight, 6) for r in w.collect()} == {(x, s): q for x in t for s, q in (("A", 0.75), ("B", 0.25))}
    assert strategy.target_weights(f, strategy.StrategyConfig(top_n=1)).where("weight > 0").count() == 3
    splits = spark.createDataFrame([("A", date(2024, 1, 3), 2.0, D(2024, 1, 3, 9))] * 2, "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    sim = simulation.simulate(w, f.withColumnRenamed("adj_close", "price"), splits=splits, check=True).orderBy("observation_timestamp").collect()
    assert len(sim) == 2 and sim[0].turnover == pytest.approx(1.0)
    assert sim[0].gross_return == pytest.approx(0.75 * 0.1 - 0.25 * 0.05) and sim[1].gross_return == pytest.approx(0.0)
    assert sim[0].equity == pytest.approx(1 + sim[0].net_return)
    m = metrics.compute_metrics(spark.createDataFrame(sim))
    assert m.win_rate == 0.5 and m.cumulative_return == pytest.approx(sim[1].equity - 1) and m.annualized_volatility is not None
    empty = metrics.compute_metrics(spark.createDataFrame(sim).limit(0))
    assert set(empty.as_dict().values()) == {None}
    with pytest.raises(ValueError):
        simulation.simulate(w.union(w), f.withColumnRenamed("adj_close", "price"), check=True)
    with pytest.raises(ValueError):
        strategy.StrategyConfig(top_n=0)


def test_weekly_carry_forward(spark):
    days = [D(2024, 1, 1) + timedelta(7 * i, hours=21) for i in range(3)]
    rows = [(d, "A", 0.1, 0.1, 1.0, p) for d, p in zip(days, (2.0, 0.5, 2.0))]
    f = spark.createDataFrame(rows, "observation_timestamp timestamp_ntz, sec_id string, momentum_20d double, volatility_20d double, sma_50d double, adj_close double")
    for carry, want in ((True, [1.0, 1.0, 1.0]), (False, [1.0, 0.0, 1.0])):
        c = strategy.StrategyConfig(rebalance_frequency="weekly", carry_forward=carry)
        assert [r.weight for r in strategy.target_weights(f, c).orderBy("observation_timestamp").collect()] == want


def test_registry():
    r = FeatureRegistry()
    r.register(lambda ctx: None, name="c", dependencies=["b", "a"])

    @r.register(name="b", dependencies=["a"])
    def b(ctx):
        return None

    @r.register
    def a(ctx):
        return None

    assert [f.name for f in r.execution_order(["c"])] == ["a", "b", "c"] and len(set(r.hashes().values())) == 3
    with pytest.raises(DuplicateFeatureError):
        r.register(a)
    with pytest.raises(FeatureNotFoundError):
        r.get("x")
    r.register(a, dependencies=["c"], overwrite=True)
    with pytest.raises(CyclicDependencyError):
        r.execution_order(["c"])


def test_tickers():
    assert entity.normalise_tickers([" aapl", "MSFT "]) == ["AAPL", "MSFT"]
    for bad in ([""], ["A", "a"]):
        with pytest.raises(ValueError):
            entity.normalise_tickers(bad)


def test_asof_with_nulls_and_many_views(spark):
    schema = "sec_id string, v double, known_from timestamp_ntz, trade_date date"
    f = spark.createDataFrame([("A", 1.0, D(2024, 1, 1), date(2024, 1, 1)), ("A", 2.0, None, None), (None, 3.0, D(2024, 1, 1), None)], schema)
    o = spark.createDataFrame([("A", D(2024, 1, 2)), ("A", None), (None, D(2024, 1, 2)), ("A", D(2023, 1, 1))], "sec_id string, observation_timestamp timestamp_ntz")
    for split_by in (None, "month"):
        got = asof.asof_join(o, f, split_by=split_by)
        assert got.columns == ["sec_id", "observation_timestamp", "v"]
        assert {(r.sec_id, r.observation_timestamp): r.v for r in got.collect()} == {("A", D(2024, 1, 2)): 1.0, ("A", None): None, (None, D(2024, 1, 2)): None, ("A", D(2023, 1, 1)): None}
    assert asof.asof_join(o, f, prefix="px").columns[-1] == "px_v"
    g = spark.createDataFrame([("A", 7.0, D(2024, 1, 1), D(2024, 1, 2))], "sec_id string, v double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    many = asof.asof_join_many(o, [f, g])
    one_by_one = asof.asof_join(asof.asof_join(o, f), g)
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert many.columns == one_by_one.columns == ["sec_id", "observation_timestamp", "v", "v_feature"]
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one_by_one.collect()))


def test_features_reject_nulls_and_read_a_catalog(spark, tmp_path):
    from tempora.plans.features import features_as_of
    from tempora.sources.catalog import Catalog
    from tempora.sources.storage import append_table

    bars = _bars(spark, [100.0 + i for i in range(60)])
    o = spark.createDataFrame([("A", D(2020, 2, 25, 22)), ("B", D(2020, 2, 25, 22))], "sec_id string, observation_timestamp timestamp_ntz")
    from pyspark.sql import functions as F

    stored = bars.select("sec_id", "trade_date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"), "known_from", F.lit(1).cast("long").alias("ingestion_seq"))
    append_table(stored, str(tmp_path), "market_ohlcv", 1)
    c = Catalog(spark, str(tmp_path))
    given, read = features_as_of(o, prices=bars), features_as_of(o, catalog=c)
    assert sorted(map(repr, given.collect())) == sorted(map(repr, read.collect())) and given.where("sec_id = 'A'").first().adj_close == 155.0
    assert c.query_arrow("SELECT count(*) AS n FROM fact_market_ohlcv_raw").column("n").to_pylist() == [60]
    c.register_arrow("tempora_arrow", c.query_arrow("SELECT sec_id, close FROM fact_market_ohlcv_raw"))
    assert c.query("SELECT max(close) AS m FROM tempora_arrow").first().m == 159.0
    for bad in [(None, D(2020, 2, 25))], [("A", None)]:
        with pytest.raises(Exception, match="have a null"):
            features_as_of(spark.createDataFrame(bad, "sec_id string, observation_timestamp timestamp_ntz"), prices=bars).collect()
    c.close()


def test_rows_that_stand_twice_make_a_simulation_fail(spark):
    t = [D(2024, 1, d, 21, 30) for d in (1, 2, 3)]
    w = spark.createDataFrame([(x, "A", 1.0) for x in t], "observation_timestamp timestamp_ntz, sec_id string, weight double")
    p = spark.createDataFrame([(x, "A", 10.0 + i) for i, x in enumerate(t)], "observation_timestamp timestamp_ntz, sec_id string, price double")
    assert simulation.simulate(w, p).count() == 2
    for a, b in ((w.union(w), p), (w, p.union(p))):
        with pytest.raises(Exception, match="twice"):
            simulation.simulate(a, b).collect()
    twice = _bars(spark, [1.0, 2.0]).drop("known_from")
    with pytest.raises(Exception, match="two bars"):
        adjustment.latest_bars(twice.union(twice)).collect()


def test_prices_between_rebalancing_times_are_passed_over(spark):
    t = [D(2024, 1, d) for d in (1, 2, 3, 4)]
    w = spark.createDataFrame([(x, "A", 1.0) for x in (t[0], t[2], t[3])], "observation_timestamp timestamp_ntz, sec_id string, weight double")
    p = spark.createDataFrame([(x, "A", v) for x, v in zip(t, (10.0, 99.0, 20.0, 10.0))] + [(t[0], "B", 5.0), (t[3], "B", 6.0)], "observation_timestamp timestamp_ntz, sec_id string, price double")
    got = {(r.sec_id, r.observation_timestamp): r.asset_return for r in simulation.period_returns(p, simulation.next_times(w)).collect()}
    assert got == {("A", t[0]): 1.0, ("A", t[2]): -0.5}


def test_definitions_are_callable_and_hashed():
    r = FeatureRegistry()
    d = r.register(name="x", compute_fn=lambda ctx: ctx, tags=["t"])
    assert d(5) == 5 and r.get("x") is d and d.compute_hash().startswith("sha256:") and len(d.compute_hash()) == 71


def test_quarter_ends_and_business_days(spark):
    from pyspark.sql import functions as F

    from tempora.functions import temporal
    from tempora.plans import synthetic

    days = [date(2023, 11, 20) + timedelta(i) for i in range(400)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for r in df.select("d", temporal.quarter_end(F.col("d")).alias("q"), temporal.previous_quarter_end(F.col("d")).alias("p")).collect():
        assert r.p == synthetic.quarter_end_before(r.d) and [r.q] == synthetic.quarter_ends(r.p + timedelta(1), r.q) and r.p < r.d <= r.q
    span = spark.createDataFrame([(days[0], days[-1])], "a date, b date")
    assert [r.day for r in temporal.business_days(span, "a", "b").orderBy("day").collect()] == synthetic.weekdays(days[0], days[-1])


def test_indicators_of_splits_known_early_and_late(spark):
    closes = [100 + 10 * math.sin(i / 3) + i / 5 for i in range(130)]
    events = [(date(2020, 3, 1), 2.0, D(2020, 3, 6, 12)), (date(2020, 4, 1), 4.0, D(2020, 2, 20, 12)), (date(2020, 4, 20), 0.5, D(2020, 6, 1))]
    splits = spark.createDataFrame([("A", *e) for e in events], "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    bars = _bars(spark, closes).union(_bars(spark, closes, "B"))
    rows = indicators.pit_indicators(bars, splits).orderBy("sec_id", "trade_date").collect()
    assert len(rows) == 260 and all(r.known_splits == 0 and r.adj_close == pytest.approx(c) for r, c in zip(rows[130:], closes))
    pit = {(r.sec_id, r.trade_date): r.adj_close for r in adjustment.adj_close_pit(bars, splits).collect()}
    for i, r in enumerate(rows[:130]):
        days = [date(2020, 1, 1) + timedelta(k) for k in range(i + 1)]
        known = [e for e in events if e[2] <= r.known_from]
        adj = [c / math.prod(q for ex, q, _ in known if d < ex) for c, d in zip(closes, days)]
        assert r.known_splits == len(known) and r.adj_close == pytest.approx(adj[-1]) == pytest.approx(pit["A", r.trade_date])
        if i >= 20:
            logs = [math.log(b / a) for a, b in zip(adj, adj[1:])][-20:]
            assert r.log_return == pytest.approx(logs[-1]) and r.momentum_20d == pytest.approx(adj[-1] / adj[-21] - 1)
            assert r.volatility_20d == pytest.approx(statistics.stdev(logs) * math.sqrt(252))
        if i >= 49:
            ema = adj[0]
            for x in adj[1:]:
                ema = 2 / 51 * x + 49 / 51 * ema
            assert r.sma_50d == pytest.approx(statistics.fmean(adj[-50:])) and r.ema_50d == pytest.approx(ema)


def test_zoned_times_become_utc(spark):
    from pyspark.sql import functions as F

    from tempora.functions.temporal import to_utc

    df = spark.range(1).select(F.timestamp_seconds(F.lit(1_600_000_000)).alias("t"), F.lit(date(2020, 9, 13)).alias("d"), F.lit("2020-09-13 12:26:40").alias("s"), F.lit(1).alias("n"))
    for c, want in (("t", D(2020, 9, 13, 12, 26, 40)), ("d", D(2020, 9, 13)), ("s", D(2020, 9, 13, 12, 26, 40))):
        assert to_utc(df, c).first()[c] == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert to_utc(df, "t").select(F.col("t").cast("string")).first()[0] == "2020-09-13 12:26:40"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError):
        to_utc(df, "n")


def test_metrics_without_a_value(spark):
    schema = "observation_timestamp timestamp_ntz, net_return double, equity double, turnover double"
    of = lambda *rows: metrics.compute_metrics(spark.createDataFrame([(D(2024, 1, 1) + timedelta(i), *r) for i, r in enumerate(rows)], schema))
    one = of((0.1, 1.1, 0.5))
    assert one.annualized_volatility is None and one.sharpe_ratio is None and one.cagr is None and one.cumulative_return == pytest.approx(0.1) and one.win_rate == 1.0
    flat = of((0.0, 1.0, 0.0), (0.0, 1.0, 0.0))
    assert flat.sharpe_ratio is None and flat.profit_factor is None and flat.calmar_ratio is None and flat.max_drawdown == 0.0
    odd = of((0.1, 1.1, 0.5), (float("inf"), float("inf"), 0.5), (0.1, 1.0, 0.5))
    assert odd.cumulative_return is None and odd.annualized_volatility is None and odd.win_rate is None and odd.mean_turnover == 0.5


def test_simulation_of_what_is_held_equals_that_of_all_rows(spark):
    """Against the plain joins over all rows: gaps, missing and zero prices, times without holdings, more times than bits."""
    rng = random.Random(5)
    times = [D(2024, 1, 1) + timedelta(days=i) for i in range(150)]
    w, p = [], []
    for t in times:
        held = rng.sample("ABCDEFGH", 2) if rng.random() < 0.6 else []
        w += [(t, s, 0.5 if s in held else 0.0) for s in "ABCDEFGH" if rng.random() < 0.9 or t in (times[3], times[-1])]
        p += [(t, s, rng.choice([0.0, None, 5.0, 6.0, 7.0, 8.0])) for s in "ABCDEFGH" if rng.random() < 0.5 and t != times[70]]
    w = spark.createDataFrame(w, "observation_timestamp timestamp_ntz, sec_id string, weight double")
    p = spark.createDataFrame(p, "observation_timestamp timestamp_ntz, sec_id string, price double")
    splits = spark.createDataFrame([(s, (times[0] + timedelta(days=40)).date(), 2.0, times[0]) for s in "ABCD"], "sec_id string, ex_date date, split_ratio double, known_from timestamp_ntz")
    drifted = simulation.drifted_weights(w, simulation.period_returns(p, simulation.next_times(w), "price", splits))
    turned = simulation.turnover_of(w, drifted)
    plain = {r.observation_timestamp: (r.gross_return, r.turnover) for r in simulation.gross_returns(drifted).join(turned, "observation_timestamp", "left").collect()}
    same = lambda a, b: a.keys() == b.keys() and all(a[t] == pytest.approx(b[t]) for t in a)
    listed = w.where("weight > 0")
    for sim in (simulation.simulate(w, p, splits=splits), simulation.simulate(listed, p, splits=splits, within=w)):
        assert same({r.observation_timestamp: (r.gross_return, r.turnover) for r in sim.collect()}, plain)
    assert same(dict(simulation.turnovers(listed, p, splits=splits, within=w).collect()), dict(turned.collect()))
    for a, b in ((w.union(w.where("weight = 0").limit(1)), p), (w, p.union(p.where("sec_id = 'H'").limit(1)))):
        with pytest.raises(Exception, match="twice"):
            simulation.simulate(listed, b, within=a).collect()


def test_simulation_deals_out_held_rows_only(spark, sf):
    """All features are read, but none of their rows enters a shuffle."""
    from tempora import queries

    seen = []
    whole = simulation.turnover_of

    def turnover_of(weights, drifted):
        seen.append((weights.count(), drifted.count()))
        return whole(weights, drifted)

    simulation.turnover_of = turnover_of
    try:
        n = queries.QUERIES["turnover"](spark, sf).count()
    finally:
        simulation.turnover_of = whole
    assert seen and max(seen[0]) <= 20 * n  # ten are held at a time, and ten were the time before
