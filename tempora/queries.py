"""Queries over the driver's tables, each with its SQL for DuckDB.

The tables are not market data, so fixed projections stand for it: suppliers are securities, shipments make daily bars
and some of them splits, orders are versioned facts, events are facts and observations.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import date, datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import intervals
from tempora.functions.calendar import calendar_days, trading_sessions, with_actionable
from tempora.functions.temporal import at_time
from tempora.operators import adjustment, asof, bitemporal, entity, indicators
from tempora.plans import features as feature_plans
from tempora.plans import metrics, runner, simulation, strategy
from tempora.session import shared_dir, stored
from tempora.sources.catalog import Catalog
from tempora.sources.storage import IngestionLog, append_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, dates: str = "") -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows. `dates` are shown as text on both sides."""
    sql = re.sub(r"round\((.*?), (\d)\) AS", lambda m: f"round({m[1]} + {nudge(int(m[2]))}, {m[2]}) AS", sql)
    if dates:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates.split())}) FROM ({sql})"

    def add(fn: Query) -> Query:
        @wraps(fn)
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({d: F.col(d).cast("string") for d in dates.split()}) if dates else df

        QUERIES[fn.__name__] = shown
        ORACLES[fn.__name__] = sql
        return fn

    return add


def nudge(digits: int) -> str:
    """Added before rounding, so that a short decimal that ends in 5 is no tie, which engines settle differently."""
    return f"1.37e-{digits + 3}"


# ---- projections ----------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sec_id"), day.alias("trade_date")).agg(
        F.min(unit).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"), F.max("l_orderkey").alias("ingestion_seq"),
    )
    return rows.withColumn("known_from", at_time(F.col("trade_date"), 21))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").where("l_linenumber = 7 AND l_quantity >= 49 AND l_discount >= 0.09")
    ratio = (1 + F.col("l_linenumber") % 3 + F.col("l_orderkey") % 3).cast("double")
    day = F.to_date("l_shipdate")
    return rows.select(F.col("l_suppkey").cast("string").alias("sec_id"), day.alias("ex_date"), ratio.alias("split_ratio"), at_time(day, 20).alias("known_from")).distinct()


def facts(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("sec_id"), F.col("o_orderpriority").alias("metric_name"), F.col("o_totalprice").alias("metric_value"), F.col("o_orderdate").alias("known_from"), F.col("o_orderkey").alias("ingestion_seq"))


def events(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    e = read(spark, sf, "events")
    return e.where(F.col("event_type") == kind) if kind else e


def tickers(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").cast("string").alias("sec_id"), F.col("event_type").alias("ticker"), F.col("ts").alias("valid_from"), F.col("event_id").alias("ingestion_seq"))


def observed_at(spark: SparkSession, sf: str) -> DataFrame:
    """Two observations of every security."""
    times = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in ("1998-06-17 21:30:00", "2001-12-31 21:30:00")]))
    return bars(spark, sf).select("sec_id").distinct().withColumn("observation_timestamp", times)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return runner.observation_grid(bars(spark, sf))


BARS = """bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS sec_id, CAST(l_shipdate AS DATE) AS trade_date, min(l_extendedprice / l_quantity) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume,
    max(l_orderkey) AS ingestion_seq, CAST(l_shipdate AS DATE) + INTERVAL 21 HOUR AS known_from FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""
SPLITS = """splits AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS sec_id, CAST(l_shipdate AS DATE) AS ex_date, CAST(1 + l_linenumber % 3 + l_orderkey % 3 AS DOUBLE) AS split_ratio,
    CAST(l_shipdate AS DATE) + INTERVAL 20 HOUR AS known_from FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 49 AND l_discount >= 0.09)"""
FACTS = "facts AS (SELECT CAST(o_custkey AS VARCHAR) AS sec_id, o_orderpriority AS metric_name, o_totalprice AS metric_value, o_orderdate AS known_from, o_orderkey AS ingestion_seq FROM orders)"
TICKERS = "tickers AS (SELECT CAST(user_id AS VARCHAR) AS sec_id, event_type AS ticker, ts AS valid_from, event_id AS ingestion_seq FROM events)"
MAP = f"{TICKERS}, map AS (SELECT *, lead(valid_from) OVER (PARTITION BY sec_id ORDER BY valid_from, ingestion_seq) AS valid_to FROM tickers)"
GRID = "grid AS (SELECT sec_id, d + INTERVAL 21 HOUR + INTERVAL 30 MINUTE AS observation_timestamp FROM (SELECT DISTINCT sec_id FROM bars), (SELECT DISTINCT trade_date AS d FROM bars))"
SEEN = "seen AS (SELECT sec_id, observation_timestamp FROM (SELECT DISTINCT sec_id FROM bars), (VALUES (TIMESTAMP '1998-06-17 21:30:00'), (TIMESTAMP '2001-12-31 21:30:00')) t(observation_timestamp))"
KNOWN = "known AS (SELECT *, lead(known_from) OVER (PARTITION BY sec_id, metric_name ORDER BY known_from, ingestion_seq) AS known_to FROM facts)"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c) + F.lit(float(nudge(digits))), digits))
    return df


# ---- scans ----------------------------------------------------------------------------------------------------------

OHLCV = "sec_id, trade_date, open, high, low, close, volume, known_from, ingestion_seq"


def store(spark: SparkSession) -> str:
    """A new folder for stored tables."""
    return f"{shared_dir(spark)}/tempora-store-{uuid.uuid4().hex}"


def catalog_of(rows: DataFrame, table: str) -> Catalog:
    """A catalog over a store that holds `rows` as one of its tables."""
    base = store(rows.sparkSession)
    append_table(rows, base, table)
    return Catalog(rows.sparkSession, base)


@query(f"WITH {BARS} SELECT {OHLCV} FROM bars", dates="trade_date")
def scan_market_bars(spark, sf):
    return catalog_of(bars(spark, sf), "market_ohlcv").query(f"SELECT {OHLCV} FROM fact_market_ohlcv_raw")


@query(f"WITH {SPLITS} SELECT sec_id, 'SPLIT' AS action_type, ex_date, split_ratio, CAST(NULL AS DOUBLE) AS cash_amount, ex_date AS announcement_date, known_from FROM splits", dates="ex_date announcement_date")
def scan_corporate_actions(spark, sf):
    rows = splits(spark, sf).select("sec_id", F.lit("SPLIT").alias("action_type"), "ex_date", "split_ratio", F.lit(None).cast("double").alias("cash_amount"), F.col("ex_date").alias("announcement_date"), "known_from", F.lit(1).cast("long").alias("ingestion_seq"))
    return catalog_of(rows, "corporate_actions").query("SELECT * EXCEPT (ingestion_seq) FROM fact_corporate_actions")


@query(f"WITH {TICKERS} SELECT * FROM tickers")
def scan_entity_map(spark, sf):
    return catalog_of(tickers(spark, sf), "entity_map").query("SELECT * FROM dim_security_ticker_raw")


@query(f"WITH {SPLITS} SELECT * FROM splits WHERE ex_date <= DATE '1999-12-31'", dates="ex_date")
def splits_only(spark, sf):
    from tempora.sources.storage import splits_only as only

    return only(splits(spark, sf).withColumn("action_type", F.lit("split")), end=date(1999, 12, 31))


@query(f"WITH {BARS} SELECT sec_id, count(*) AS n_bars, max(close) AS max_close FROM bars WHERE trade_date >= DATE '1998-01-01' GROUP BY sec_id")
def catalog_sql(spark, sf):
    c = catalog_of(bars(spark, sf), "market_ohlcv")
    return c.query("SELECT sec_id, count(*) AS n_bars, max(close) AS max_close FROM fact_market_ohlcv_raw WHERE trade_date >= ? GROUP BY sec_id", [date(1998, 1, 1)])


@query("SELECT o_orderpriority AS table_name, count(*) AS row_count, max(o_orderkey) AS latest_seq, max(o_orderkey) + 1 AS next_seq FROM orders GROUP BY o_orderpriority")
def ingestion_log(spark, sf):
    """Every order priority is logged as a table, its orders as a batch."""
    log = IngestionLog(spark, store(spark))
    o = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("seq"))
    for r in o.collect():  # five priorities
        log.record(r.o_orderpriority, "orders", r.n, seq=r.seq)
    kept = log.history().groupBy("table_name").agg(F.sum("row_count").alias("row_count"), F.max("ingestion_seq").alias("latest_seq"))
    return kept.withColumn("next_seq", F.col("latest_seq") + 1)
# ---- predicates -----------------------------------------------------------------------------------------------------


@query(f"WITH {FACTS}, {KNOWN} SELECT * FROM known WHERE known_from <= TIMESTAMP '1998-06-01' AND (known_to IS NULL OR TIMESTAMP '1998-06-01' < known_to)")
def pit_filter(spark, sf):
    return bitemporal.point_in_time(bitemporal.derive_known_to(facts(spark, sf), ["sec_id", "metric_name"]), "1998-06-01")


@query(f"WITH {MAP} SELECT sec_id, ticker, valid_from FROM map WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")
def valid_contains(spark, sf):
    m = bitemporal.derive_valid_to(tickers(spark, sf), "sec_id")
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return m.where(intervals.contains(F.col("valid_from"), F.col("valid_to"), at)).select("sec_id", "ticker", "valid_from")


@query(f"WITH {MAP} SELECT sec_id, ticker, valid_from FROM map WHERE valid_from < TIMESTAMP '2024-01-16' AND (valid_to IS NULL OR TIMESTAMP '2024-01-14' < valid_to)")
def interval_overlap(spark, sf):
    m = bitemporal.derive_valid_to(tickers(spark, sf), "sec_id")
    a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-14", "2024-01-16"))
    return m.where(intervals.overlaps(F.col("valid_from"), F.col("valid_to"), a, b)).select("sec_id", "ticker", "valid_from")


@query("SELECT CAST(user_id AS VARCHAR) AS sec_id, ts AS observation_timestamp, event_type FROM events")
def observation_matrix(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("sec_id"), F.col("ts").alias("observation_timestamp"), "event_type")
    return asof.observation_matrix(e)


@query(f"WITH {BARS} SELECT sec_id, trade_date, close FROM bars WHERE sec_id IN ('1', '3', '5', '8') AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", dates="trade_date")
def universe_date_filter(spark, sf):
    return runner.universe_between(bars(spark, sf), ["1", "3", "5", "8"], date(1996, 1, 1), date(1999, 12, 31)).select("sec_id", "trade_date", "close")


@query(f"WITH {BARS} SELECT DISTINCT 'SEC_' || sec_id || '_001' AS sec_id FROM bars WHERE sec_id IN ('2', '4', '7')")
def static_universe(spark, sf):
    rows = bars(spark, sf).select(entity.sec_id_of(F.col("sec_id")).alias("sec_id")).distinct()
    return rows.where(F.col("sec_id").isin(runner.universe_ids(["2", "SEC_4_001", " 7 "])))


@query(f"WITH {BARS}, {GRID} SELECT * FROM grid")
def observation_grid(spark, sf):
    return grid(spark, sf)


@query("SELECT event_id, date_trunc('day', ts) AS known_from FROM events")
def leaky_daystart(spark, sf):
    return runner.leaky_view(events(spark, sf).select("event_id", F.col("ts").alias("known_from")))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS known_from FROM orders")
def leaky_fundamentals(spark, sf):
    from tempora.plans.synthetic import leaky_fundamentals as leak

    o = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("fiscal_period_end"), (F.col("o_orderstatus") == "F").alias("is_restatement"), F.lit(None).cast("timestamp_ntz").alias("known_to"))
    return leak(o).select("o_orderkey", "known_from")


@query(f"WITH {FACTS} SELECT sec_id, metric_name, metric_value, known_from, ingestion_seq FROM facts QUALIFY row_number() OVER (PARTITION BY sec_id, metric_name ORDER BY known_from DESC, ingestion_seq DESC) = 1")
def dedup_latest_bar(spark, sf):
    return bitemporal.latest_per_key(facts(spark, sf), ["sec_id", "metric_name"])


@query(f"WITH {SPLITS} SELECT sec_id, ex_date, split_ratio, min(known_from) AS known_from FROM splits GROUP BY ALL", dates="ex_date")
def dedup_split_events(spark, sf):
    s = splits(spark, sf)
    again = s.withColumn("known_from", (F.col("known_from") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
    return adjustment.split_events(s.unionByName(again))


# ---- as-of joins ----------------------------------------------------------------------------------------------------

VIEWS = "views AS (SELECT CAST(user_id AS VARCHAR) AS sec_id, ts AS observation_timestamp, event_id FROM events WHERE event_type = 'view')"


def _latest(kind: str) -> str:
    return f"(SELECT CAST(user_id AS VARCHAR) AS sec_id, ts, value FROM events WHERE event_type = '{kind}' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)"


def views(spark, sf):
    return events(spark, sf, "view").select(F.col("user_id").cast("string").alias("sec_id"), F.col("ts").alias("observation_timestamp"), "event_id")


def feature(spark, sf, kind: str) -> DataFrame:
    return events(spark, sf, kind).select(F.col("user_id").cast("string").alias("sec_id"), F.col("ts").alias("known_from"), F.col("event_id").alias("ingestion_seq"), F.col("value").alias(kind))


@query(f"WITH {VIEWS} SELECT v.sec_id, v.observation_timestamp, v.event_id, p.value AS purchase FROM views v ASOF LEFT JOIN {_latest('purchase')} p ON v.sec_id = p.sec_id AND v.observation_timestamp >= p.ts")
def asof_join(spark, sf):
    return asof.asof_join(views(spark, sf), feature(spark, sf, "purchase"))


@query(
    f"""WITH {FACTS}, {KNOWN}, o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sec_id, o_orderdate + INTERVAL 45 DAY AS observation_timestamp FROM orders),
    r AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY sec_id, known_from ORDER BY ingestion_seq DESC) = 1)
    SELECT o.sec_id, o.observation_timestamp, CASE WHEN known_to IS NULL OR o.observation_timestamp < known_to THEN metric_value END AS metric_value,
        CASE WHEN known_to IS NULL OR o.observation_timestamp < known_to THEN metric_name END AS metric_name
    FROM o ASOF LEFT JOIN r ON o.sec_id = r.sec_id AND o.observation_timestamp >= r.known_from"""
)
def asof_join_bounded(spark, sf):
    f = facts(spark, sf)
    o = f.select("sec_id", (F.col("known_from") + F.expr("INTERVAL 45 DAYS")).cast("timestamp_ntz").alias("observation_timestamp")).distinct()
    return asof.asof_join(o, bitemporal.derive_known_to(f, ["sec_id", "metric_name"]))


@query(
    f"""WITH {VIEWS} SELECT v.sec_id, v.observation_timestamp, v.event_id, p.value AS purchase, c.value AS click FROM views v
    ASOF LEFT JOIN {_latest('purchase')} p ON v.sec_id = p.sec_id AND v.observation_timestamp >= p.ts
    ASOF LEFT JOIN {_latest('click')} c ON v.sec_id = c.sec_id AND v.observation_timestamp >= c.ts"""
)
def asof_multi_view(spark, sf):
    return asof.asof_join_many(views(spark, sf), [feature(spark, sf, "purchase"), feature(spark, sf, "click")])


def _some(column: str, kept: str) -> str:
    return f"CASE WHEN {kept} THEN {column} END"


def _with_nulls(view_key: str, view_time: str, fact_key: str, fact_time: str) -> str:
    """The as-of join in SQL over keys and times of which some are null; of facts at one time the last event counts."""
    return f"""WITH v AS (SELECT {view_key} AS sec_id, {view_time} AS observation_timestamp, event_id FROM events WHERE event_type = 'view'),
        p AS (SELECT {fact_key} AS sec_id, {fact_time} AS known_from, value, event_id FROM events WHERE event_type = 'purchase'),
        q AS (SELECT * FROM p WHERE known_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sec_id, known_from ORDER BY event_id DESC) = 1)
        SELECT v.sec_id, v.observation_timestamp, v.event_id, q.value AS purchase FROM v ASOF LEFT JOIN q ON v.sec_id = q.sec_id AND v.observation_timestamp >= q.known_from"""


USER, NOT_THIRD = "CAST(user_id AS VARCHAR)", "event_id % 3 <> 0"


@query(_with_nulls(_some(USER, "user_id % 5 <> 0"), "ts", _some(USER, "user_id % 5 <> 0"), "ts"))
def asof_null_keys(spark, sf):
    nulls = lambda df: df.withColumn("sec_id", F.when(F.col("sec_id").cast("long") % 5 != 0, F.col("sec_id")))
    return asof.asof_join(nulls(views(spark, sf)), nulls(feature(spark, sf, "purchase")))


@query(_with_nulls(USER, "ts", USER, _some("ts", NOT_THIRD)))
def asof_null_fact_times(spark, sf):
    f = feature(spark, sf, "purchase")
    return asof.asof_join(views(spark, sf), f.withColumn("known_from", F.when(F.col("ingestion_seq") % 3 != 0, F.col("known_from"))))


@query(_with_nulls(USER, _some("ts", NOT_THIRD), USER, "ts"))
def asof_null_observation_times(spark, sf):
    v = views(spark, sf)
    return asof.asof_join(v.withColumn("observation_timestamp", F.when(F.col("event_id") % 3 != 0, F.col("observation_timestamp"))), feature(spark, sf, "purchase"))


@query(f"WITH {BARS}, {SPLITS} SELECT sec_id, trade_date, (SELECT count(*) FROM splits s WHERE s.sec_id = b.sec_id AND s.known_from <= b.known_from) AS known_splits FROM bars b", dates="trade_date")
def known_split_count(spark, sf):
    return indicators.known_split_count(bars(spark, sf), splits(spark, sf)).select("sec_id", "trade_date", F.col("known_splits").cast("long").alias("known_splits"))


# ---- adjustment -----------------------------------------------------------------------------------------------------

CAF = f"""{BARS}, {SPLITS}, {SEEN}, caf AS (SELECT o.sec_id, o.observation_timestamp, b.trade_date, b.close,
    coalesce((SELECT product(1 / split_ratio) FROM splits s WHERE s.sec_id = b.sec_id AND s.ex_date > b.trade_date AND s.ex_date <= CAST(o.observation_timestamp AS DATE) AND s.known_from <= o.observation_timestamp), 1) AS caf
    FROM seen o JOIN bars b USING (sec_id))"""


@query(f"WITH {CAF} SELECT sec_id, observation_timestamp, trade_date, close, round(caf, 8) AS caf, round(close * caf, 4) AS adj_close FROM caf", dates="trade_date")
def caf_matrix(spark, sf):
    return rounded(rounded(adjustment.caf_matrix(bars(spark, sf), splits(spark, sf), observed_at(spark, sf)), 8, "caf"), 4, "adj_close")


@query(
    f"""WITH {SPLITS}, asked AS (SELECT sec_id, min(ex_date) - INTERVAL 1 DAY AS trade_date FROM splits GROUP BY sec_id ORDER BY sec_id LIMIT 4)
    SELECT sec_id, CAST(trade_date AS DATE) AS trade_date, round((SELECT product(1 / split_ratio) FROM splits s WHERE s.sec_id = a.sec_id AND s.ex_date > a.trade_date AND s.ex_date <= DATE '2001-12-31'
        AND s.known_from <= TIMESTAMP '2001-12-31 21:30:00'), 8) AS caf FROM asked a""",
    dates="trade_date",
)
def caf_scalar(spark, sf):
    """The factor of four prices, each of the day before its security's first split."""
    s = splits(spark, sf)
    asked = s.groupBy("sec_id").agg(F.date_sub(F.min("ex_date"), 1).alias("d")).orderBy("sec_id").limit(4).collect()
    rows = [(r.sec_id, r.d, adjustment.caf_scalar(s, r.sec_id, r.d, datetime(2001, 12, 31, 21, 30))) for r in asked]
    return rounded(spark.createDataFrame(rows, "sec_id string, trade_date date, caf double"), 8, "caf")


@query(f"WITH {CAF} SELECT sec_id, trade_date, close, round(caf, 8) AS caf, round(close * caf, 4) AS adj_close FROM caf WHERE sec_id = '3' AND observation_timestamp = TIMESTAMP '2001-12-31 21:30:00'", dates="trade_date")
def adjusted_close_as_of(spark, sf):
    rows = adjustment.adjusted_close_as_of(bars(spark, sf), splits(spark, sf), datetime(2001, 12, 31, 21, 30), "3")
    return rounded(rounded(rows, 8, "caf"), 4, "adj_close").drop("observation_timestamp")


ADJ = "adj AS (SELECT sec_id, trade_date, known_from, close * coalesce((SELECT product(1 / split_ratio) FROM splits s WHERE s.sec_id = b.sec_id AND b.trade_date < s.ex_date AND s.known_from <= b.known_from), 1) AS adj_close FROM bars b)"


@query(f"WITH {BARS}, {SPLITS}, {ADJ} SELECT sec_id, trade_date, known_from, round(adj_close, 4) AS adj_close FROM adj", dates="trade_date")
def adj_close_pit(spark, sf):
    return rounded(adjustment.adj_close_pit(bars(spark, sf), splits(spark, sf)), 4, "adj_close")


@query(f"WITH {BARS}, {SPLITS} SELECT sec_id, trade_date, round(close * coalesce((SELECT product(split_ratio) FROM splits s WHERE s.sec_id = b.sec_id AND s.ex_date > b.trade_date), 1), 4) AS close FROM bars b", dates="trade_date")
def undo_split_adjustment(spark, sf):
    return rounded(adjustment.undo_adjustment(bars(spark, sf).select("sec_id", "trade_date", "close"), splits(spark, sf)).select("sec_id", "trade_date", "close"), 4, "close")


@query(f"WITH {SPLITS} SELECT sec_id, round(product(1 / split_ratio), 8) AS static_caf FROM splits GROUP BY sec_id")
def leaky_static_caf(spark, sf):
    s = splits(spark, sf)
    return rounded(s.groupBy("sec_id").agg(adjustment.factor(F.col("split_ratio"), F.lit(True)).alias("static_caf")), 8, "static_caf")


@query(f"WITH {SPLITS} SELECT DISTINCT sec_id, ex_date, split_ratio FROM splits ORDER BY ALL", dates="ex_date")
def split_listing(spark, sf):
    return splits(spark, sf).select("sec_id", "ex_date", "split_ratio").distinct().orderBy("sec_id", "ex_date", "split_ratio")


# ---- bitemporal -----------------------------------------------------------------------------------------------------


@query(f"WITH {FACTS}, {KNOWN} SELECT * FROM known")
def derive_known_to(spark, sf):
    return bitemporal.derive_known_to(facts(spark, sf), ["sec_id", "metric_name"])


@query(f"WITH {MAP} SELECT * FROM map")
def derive_valid_to(spark, sf):
    return bitemporal.derive_valid_to(tickers(spark, sf), "sec_id")


@query(f"WITH {FACTS} {bitemporal.view_sql('facts', ['sec_id', 'metric_name'], columns=['sec_id', 'metric_name', 'known_from'])}")
def bitemporal_view_sql(spark, sf):
    facts(spark, sf).createOrReplaceTempView("tempora_facts")
    return spark.sql(bitemporal.view_sql("tempora_facts", ["sec_id", "metric_name"], columns=["sec_id", "metric_name", "known_from"]))


@query(f"WITH {TICKERS} {entity.ticker_map_sql('tickers')}")
def ticker_map_view(spark, sf):
    tickers(spark, sf).createOrReplaceTempView("tempora_tickers")
    return bitemporal.register_view(spark, "tempora_ticker_map", entity.ticker_map_sql("tempora_tickers"))


def _resolve_sql(given: str, wanted: str) -> str:
    return f"""WITH {MAP}, asked AS (SELECT DISTINCT {given}, TIMESTAMP '2024-01-15 12:00:00' AS as_of FROM tickers)
    SELECT a.{given}, a.as_of, m.{wanted} FROM asked a LEFT JOIN map m ON m.{given} = a.{given} AND m.valid_from <= a.as_of AND (m.valid_to IS NULL OR a.as_of < m.valid_to)
    QUALIFY row_number() OVER (PARTITION BY a.{given}, a.as_of ORDER BY m.valid_from DESC NULLS LAST, m.ingestion_seq DESC) = 1"""


def _resolve(spark, sf, given: str, wanted: str) -> DataFrame:
    t = tickers(spark, sf)
    asked = t.select(given).distinct().withColumn("as_of", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return entity.resolve_many(asked, bitemporal.derive_valid_to(t, "sec_id"), given, wanted)


@query(_resolve_sql("ticker", "sec_id"))
def resolve_sec_id(spark, sf):
    return _resolve(spark, sf, "ticker", "sec_id")


@query(_resolve_sql("sec_id", "ticker"))
def resolve_ticker(spark, sf):
    return _resolve(spark, sf, "sec_id", "ticker")


@query(f"WITH {FACTS} SELECT sec_id, metric_name, arg_max(metric_value, (known_from, ingestion_seq)) AS metric_value FROM facts GROUP BY ALL")
def leaky_latest_version(spark, sf):
    return facts(spark, sf).groupBy("sec_id", "metric_name").agg(F.max_by("metric_value", F.struct("known_from", "ingestion_seq")).alias("metric_value"))


@query(f"WITH {BARS}, {SPLITS} SELECT b.sec_id, b.trade_date, b.close, s.split_ratio FROM bars b JOIN splits s ON b.sec_id = s.sec_id AND b.trade_date = s.ex_date", dates="trade_date")
def leaky_trade_date_join(spark, sf):
    s = splits(spark, sf).select("sec_id", F.col("ex_date").alias("trade_date"), "split_ratio")
    return bars(spark, sf).join(s, ["sec_id", "trade_date"]).select("sec_id", "trade_date", "close", "split_ratio")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def idempotent_anti_join(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("_n"), "n_name", "n_regionkey")
    stored = n.where("n_regionkey = 2").select("n_nationkey", "_n", "n_name", "n_regionkey")
    return bitemporal.without_persisted(n, stored).drop("_n")


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def schema_merge_union(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return bitemporal.merged_union(a, read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region")))


# ---- indicators -----------------------------------------------------------------------------------------------------

IND = f"""{BARS}, {SPLITS}, sp AS (SELECT *, row_number() OVER (PARTITION BY sec_id ORDER BY known_from, ex_date, split_ratio) AS k FROM splits),
    kb AS (SELECT b.*, (SELECT count(*) FROM sp s WHERE s.sec_id = b.sec_id AND s.known_from <= b.known_from) AS known_splits FROM bars b),
    st AS (SELECT DISTINCT sec_id, known_splits AS state FROM kb),
    ad AS (SELECT b.sec_id, b.trade_date, b.known_from, b.known_splits, st.state,
        b.close / coalesce((SELECT product(split_ratio) FROM sp s WHERE s.sec_id = b.sec_id AND s.k <= st.state AND s.ex_date > b.trade_date), 1) AS adj FROM kb b JOIN st USING (sec_id)),
    l1 AS (SELECT *, ln(adj) AS x, row_number() OVER (PARTITION BY sec_id, state ORDER BY trade_date) - 1 AS n FROM ad),
    l2 AS (SELECT *, x - lag(x) OVER (PARTITION BY sec_id, state ORDER BY trade_date) AS log_return FROM l1),
    l3 AS (SELECT *, exp(x - lag(x, 20) OVER w) - 1 AS momentum_20d,
        CASE WHEN count(log_return) OVER w20 = 20 THEN stddev_samp(log_return) OVER w20 * sqrt(252) END AS volatility_20d,
        CASE WHEN count(adj) OVER w50 = 50 THEN avg(adj) OVER w50 END AS sma_50d,
        CASE WHEN n >= 49 THEN pow(49.0 / 51, n) * sum(CASE WHEN n = 0 THEN adj ELSE 2.0 / 51 * adj * pow(49.0 / 51, -n) END) OVER (w ROWS UNBOUNDED PRECEDING) END AS ema_50d
        FROM l2 WINDOW w AS (PARTITION BY sec_id, state ORDER BY trade_date), w20 AS (PARTITION BY sec_id, state ORDER BY trade_date ROWS 19 PRECEDING), w50 AS (PARTITION BY sec_id, state ORDER BY trade_date ROWS 49 PRECEDING)),
    ind AS (SELECT * FROM l3 WHERE known_splits = state)"""


def ind(spark, sf) -> DataFrame:
    return indicators.pit_indicators(bars(spark, sf), splits(spark, sf))


DIGITS = {"log_return": 8, "momentum_20d": 8, "volatility_20d": 8, "sma_50d": 3, "ema_50d": 3}


def _shown(columns: list[str]) -> str:
    return ", ".join(f"round({c}, {DIGITS[c]}) AS {c}" for c in columns)


@query(f"WITH {IND} SELECT sec_id, trade_date, known_splits, {_shown(list(DIGITS))} FROM ind", dates="trade_date")
def pit_indicators(spark, sf):
    rows = ind(spark, sf).withColumn("known_splits", F.col("known_splits").cast("long")).drop("known_from", "adj_close")
    for c, d in DIGITS.items():
        rows = rounded(rows, d, c)
    return rows


def _single(column: str) -> None:
    @query(f"WITH {IND} SELECT sec_id, trade_date, {_shown([column])} FROM ind", dates="trade_date")
    def one(spark, sf):
        return rounded(ind(spark, sf).select("sec_id", "trade_date", column), DIGITS[column], column)

    QUERIES[column], ORACLES[column] = QUERIES.pop("one"), ORACLES.pop("one")


for _c in DIGITS:
    _single(_c)

# ---- features, weights, simulation ----------------------------------------------------------------------------------

FEATURES = f"""{IND}, {ADJ}, {GRID}, wide AS (SELECT a.*, i.momentum_20d, i.volatility_20d, i.sma_50d, i.ema_50d FROM adj a JOIN ind i USING (sec_id, trade_date)),
    feats AS (SELECT g.sec_id, g.observation_timestamp, w.adj_close, w.momentum_20d, w.volatility_20d, w.sma_50d, w.ema_50d
        FROM grid g ASOF LEFT JOIN wide w ON g.sec_id = w.sec_id AND g.observation_timestamp >= w.known_from)"""


def feats(spark, sf, names=feature_plans.DEFAULT_FEATURES) -> DataFrame:
    return feature_plans.features_as_of(grid(spark, sf), names, prices=bars(spark, sf), splits=splits(spark, sf))


@query(f"WITH {FEATURES} SELECT sec_id, observation_timestamp, round(adj_close, 4) AS adj_close, {_shown(['momentum_20d', 'volatility_20d', 'sma_50d', 'ema_50d'])} FROM feats")
def features_as_of(spark, sf):
    rows = rounded(feats(spark, sf), 4, "adj_close")
    for c in ("momentum_20d", "volatility_20d", "sma_50d", "ema_50d"):
        rows = rounded(rows, DIGITS[c], c)
    return rows


OK = "momentum_20d IS NOT NULL AND coalesce(volatility_20d > 1e-12, false) AND coalesce(adj_close > sma_50d, false)"
WEIGHTS = f"""{FEATURES}, ok AS (SELECT *, {OK} AS good FROM feats),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY observation_timestamp, good ORDER BY momentum_20d DESC NULLS LAST, sec_id) AS r FROM ok),
    held AS (SELECT *, CASE WHEN good AND r <= 10 THEN 1 / volatility_20d END AS inv FROM ranked),
    weights AS (SELECT observation_timestamp, sec_id, coalesce(inv / sum(inv) OVER (PARTITION BY observation_timestamp), 0) AS weight FROM held)"""


@query(f"WITH {FEATURES} SELECT sec_id, observation_timestamp FROM feats WHERE {OK}")
def eligibility_screen(spark, sf):
    return feats(spark, sf).where(strategy.eligible(strategy.StrategyConfig(), "adj_close")).select("sec_id", "observation_timestamp")


@query(f"WITH {WEIGHTS} SELECT observation_timestamp, sec_id, r AS momentum_rank FROM ranked WHERE good AND r <= 10")
def momentum_topn(spark, sf):
    rows = strategy.top_momentum(feats(spark, sf))
    return rows.select("observation_timestamp", "sec_id", F.col("momentum_rank").cast("long").alias("momentum_rank"))


def weights(spark, sf) -> DataFrame:
    return strategy.target_weights(feats(spark, sf))


@query(f"WITH {WEIGHTS} SELECT observation_timestamp, sec_id, round(weight, 8) AS weight FROM weights WHERE weight > 0")
def inverse_vol_weights(spark, sf):
    return rounded(weights(spark, sf).where("weight > 0"), 8, "weight")


@query(f"WITH {WEIGHTS} SELECT observation_timestamp, sec_id, round(weight, 8) AS weight FROM weights")
def target_weights(spark, sf):
    return rounded(weights(spark, sf), 8, "weight")


@query(
    f"""WITH {FEATURES}, ok AS (SELECT *, {OK} AND isodow(observation_timestamp) = 1 AS good FROM feats),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY observation_timestamp, good ORDER BY momentum_20d DESC NULLS LAST, sec_id) AS r FROM ok),
    held AS (SELECT *, CASE WHEN good AND r <= 10 THEN 1 / volatility_20d END AS inv FROM ranked),
    w AS (SELECT observation_timestamp, sec_id, nullif(coalesce(inv / sum(inv) OVER (PARTITION BY observation_timestamp), 0), 0) AS weight FROM held),
    c AS (SELECT observation_timestamp, sec_id, coalesce(last_value(weight IGNORE NULLS) OVER (PARTITION BY sec_id ORDER BY observation_timestamp ROWS UNBOUNDED PRECEDING), 0) AS weight FROM w)
    SELECT observation_timestamp, sec_id, round(weight, 8) AS weight FROM c WHERE isodow(observation_timestamp) = 1"""
)
def weekly_weights(spark, sf):
    return rounded(strategy.target_weights(feats(spark, sf), strategy.StrategyConfig(rebalance_frequency="weekly")), 8, "weight")


SIM = f"""{WEIGHTS}, times AS (SELECT observation_timestamp, lead(observation_timestamp) OVER (ORDER BY observation_timestamp) AS next_timestamp FROM (SELECT DISTINCT observation_timestamp FROM weights)),
    prices AS (SELECT observation_timestamp, sec_id, adj_close AS price FROM feats WHERE adj_close IS NOT NULL),
    rets AS (SELECT p.observation_timestamp, t.next_timestamp, p.sec_id, q.price / p.price * coalesce((SELECT product(split_ratio) FROM splits s
        WHERE s.sec_id = p.sec_id AND s.ex_date = CAST(t.next_timestamp AS DATE) AND s.known_from <= t.next_timestamp), 1) - 1 AS asset_return
        FROM prices p JOIN times t USING (observation_timestamp) JOIN prices q ON q.sec_id = p.sec_id AND q.observation_timestamp = t.next_timestamp),
    pw AS (SELECT w.observation_timestamp, r.next_timestamp, sec_id, weight, asset_return, weight * (1 + asset_return) / (1 + sum(weight * asset_return) OVER (PARTITION BY w.observation_timestamp)) AS drifted_weight
        FROM weights w JOIN rets r USING (observation_timestamp, sec_id)),
    gross AS (SELECT observation_timestamp, sum(weight * asset_return) AS gross_return FROM pw GROUP BY observation_timestamp),
    turn AS (SELECT w.observation_timestamp, sum(abs(w.weight - coalesce(d.drifted_weight, 0))) AS turnover FROM weights w LEFT JOIN pw d ON d.next_timestamp = w.observation_timestamp AND d.sec_id = w.sec_id GROUP BY w.observation_timestamp),
    net AS (SELECT observation_timestamp, gross_return, turnover, turnover * 0.0005 AS cost, gross_return - turnover * 0.0005 AS net_return FROM gross LEFT JOIN turn USING (observation_timestamp)),
    sim AS (SELECT *, product(1 + net_return) OVER (ORDER BY observation_timestamp ROWS UNBOUNDED PRECEDING) AS equity FROM net),
    dd AS (SELECT *, max(equity) OVER (ORDER BY observation_timestamp ROWS UNBOUNDED PRECEDING) AS peak FROM sim)"""


def parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, returns, drifted). Features are written once: what follows reads them several times."""
    f = stored(feats(spark, sf))
    w = strategy.target_weights(f)
    r = simulation.period_returns(runner.simulation_prices(f), simulation.next_times(w), "price", splits(spark, sf))
    return w, r, simulation.drifted_weights(w, r)


#: What the strategy and the simulation read.
TRADED = ("adj_close", "momentum_20d", "volatility_20d", "sma_50d")


def sim(spark, sf, config: simulation.SimulationConfig | None = None, features: DataFrame | None = None) -> DataFrame:
    f = features or stored(feats(spark, sf, TRADED))
    return simulation.simulate(strategy.held_weights(f), runner.simulation_prices(f), config, splits(spark, sf), within=f)


@query(f"WITH {SIM} SELECT observation_timestamp, next_timestamp, sec_id, round(asset_return, 8) AS asset_return FROM rets")
def split_neutral_return(spark, sf):
    return rounded(parts(spark, sf)[1], 8, "asset_return")


@query(f"WITH {SIM} SELECT observation_timestamp, next_timestamp, sec_id, round(drifted_weight, 8) AS drifted_weight FROM pw WHERE weight > 0")
def drifted_weights(spark, sf):
    return rounded(parts(spark, sf)[2].where("weight > 0").select("observation_timestamp", "next_timestamp", "sec_id", "drifted_weight"), 8, "drifted_weight")


@query(f"WITH {SIM} SELECT observation_timestamp, round(gross_return, 8) AS gross_return FROM gross")
def gross_return(spark, sf):
    return rounded(simulation.gross_returns(parts(spark, sf)[2]), 8, "gross_return")


@query(f"WITH {SIM} SELECT observation_timestamp, round(turnover, 8) AS turnover FROM turn")
def turnover(spark, sf):
    f = stored(feats(spark, sf, TRADED))
    return rounded(simulation.turnovers(strategy.held_weights(f), runner.simulation_prices(f), "price", splits(spark, sf), within=f), 8, "turnover")


SHOWN = "observation_timestamp, round(gross_return, 8) AS gross_return, round(turnover, 8) AS turnover, round(cost, 8) AS cost, round(net_return, 8) AS net_return"


@query(f"WITH {SIM} SELECT {SHOWN}, CAST(printf('%.6e', equity) AS DOUBLE) AS equity FROM sim")
def simulate_portfolio(spark, sf):
    return rounded(sim(spark, sf), 8, "gross_return", "turnover", "cost", "net_return").withColumn("equity", _digits(F.col("equity")))


def _digits(c: Column) -> Column:
    """Seven significant digits: the curve runs over many magnitudes."""
    return F.format_string("%.6e", c).cast("double")


@query(f"WITH {SIM} SELECT observation_timestamp, CAST(printf('%.6e', equity) AS DOUBLE) AS equity FROM sim")
def equity_curve(spark, sf):
    return sim(spark, sf).select("observation_timestamp", _digits(F.col("equity")).alias("equity"))


@query(f"WITH {SIM} SELECT observation_timestamp, round(equity / peak - 1, 8) AS drawdown FROM dd")
def drawdown_series(spark, sf):
    return rounded(metrics.drawdown_series(sim(spark, sf)).select("observation_timestamp", "drawdown"), 8, "drawdown")


METRICS = """SELECT last / 1.0 - 1 AS cumulative_return, pow(last, 1 / years) - 1 AS cagr, sd * sqrt(252) AS annualized_volatility, mean * 252 / (sd * sqrt(252)) AS sharpe_ratio, mdd AS max_drawdown,
    (pow(last, 1 / years) - 1) / abs(mdd) AS calmar_ratio, wins AS win_rate, gains / losses AS profit_factor, mt AS mean_turnover FROM (
    SELECT arg_max(equity, observation_timestamp) AS last, (epoch_us(max(observation_timestamp)) - epoch_us(min(observation_timestamp))) / (365.25 * 86400 * 1e6) AS years, avg(net_return) AS mean,
        stddev_samp(net_return) AS sd, min(equity / peak - 1) AS mdd, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS wins, sum(CASE WHEN net_return > 0 THEN net_return ELSE 0 END) AS gains,
        sum(CASE WHEN net_return < 0 THEN -net_return ELSE 0 END) AS losses, avg(turnover) AS mt FROM dd)"""
SEVEN = ", ".join(f"CAST(printf('%.6e', {n}) AS DOUBLE) AS {n}" for n in metrics.NAMES)


@query(f"WITH {SIM}, m AS ({METRICS}) SELECT {SEVEN} FROM m")
def performance_metrics(spark, sf):
    return metrics.metrics_frame(sim(spark, sf)).select(*[_digits(F.col(n)).alias(n) for n in metrics.NAMES])


FREE = """net0 AS (SELECT observation_timestamp, turnover, gross_return AS net_return FROM net), sim0 AS (SELECT *, product(1 + net_return) OVER (ORDER BY observation_timestamp ROWS UNBOUNDED PRECEDING) AS equity FROM net0),
    dd0 AS (SELECT *, max(equity) OVER (ORDER BY observation_timestamp ROWS UNBOUNDED PRECEDING) AS peak FROM sim0)"""
DELTAS = ", ".join(f"CASE WHEN abs(m.{n} - m0.{n}) < 1e-12 THEN 0.0 ELSE CAST(printf('%.5e', m.{n} - m0.{n}) AS DOUBLE) END AS {n}" for n in metrics.NAMES)


@query(f"WITH {SIM}, {FREE}, m AS ({METRICS}), m0 AS ({METRICS.replace('FROM dd)', 'FROM dd0)')}) SELECT {DELTAS} FROM m, m0")
def tear_sheet_delta(spark, sf):
    """The metrics with costs less those of an arm that trades for nothing."""
    f = stored(feats(spark, sf, TRADED))
    sheet = metrics.tear_sheet(sim(spark, sf, simulation.SimulationConfig(0.0), f), sim(spark, sf, None, f))
    row = tuple(v if v is None else 0.0 if abs(v) < 1e-12 else float(f"{v:.5e}") for v in sheet.delta.as_dict().values())
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in metrics.NAMES))


#: The leaky arm's bars are adjusted for all splits and known from the morning; its splits are in its prices already.
LEAKY_BARS = """bars AS (SELECT b.sec_id, b.trade_date, b.close * coalesce((SELECT product(1 / split_ratio) FROM real_splits s WHERE s.sec_id = b.sec_id AND s.ex_date > b.trade_date
        AND s.ex_date <= (SELECT max(trade_date) FROM real_bars) AND s.known_from <= (SELECT max(trade_date) FROM real_bars) + INTERVAL 23 HOUR), 1) AS close,
    CAST(b.trade_date AS TIMESTAMP) AS known_from FROM real_bars b)"""
UNIVERSE = [str(k) for k in range(1, 41)]
LEAKY = (
    SIM.replace(GRID, GRID.replace("FROM bars)", "FROM real_bars)").replace("(SELECT DISTINCT sec_id FROM real_bars)", f"(SELECT DISTINCT sec_id FROM real_bars WHERE sec_id IN ({', '.join(f'{chr(39)}{u}{chr(39)}' for u in UNIVERSE)}))"))
    .replace(BARS, f"{BARS.replace('bars AS', 'real_bars AS', 1)}, {SPLITS.replace('splits AS', 'real_splits AS', 1)}, {LEAKY_BARS}")
    .replace(f"{LEAKY_BARS}, {SPLITS}", f"{LEAKY_BARS}, splits AS (SELECT * FROM real_splits WHERE false)")
)


@query(f"SELECT 'leaky' AS arm, * FROM (WITH {LEAKY}, m AS ({METRICS}) SELECT {SEVEN} FROM m) UNION ALL SELECT 'corrected' AS arm, * FROM (WITH {SIM}, m AS ({METRICS}) SELECT {SEVEN} FROM m)")
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both arms on the bars: the leaky one knows all splits from the start, each close from the morning, and trades only
    forty securities that are known to have lasted."""
    named = lambda df: df.withColumn("sec_id", entity.sec_id_of(F.col("sec_id")))
    b, s = stored(named(bars(spark, sf))), stored(named(splits(spark, sf)))
    last = b.agg(F.max("trade_date").alias("t")).select(at_time(F.col("t"), 23).alias("observation_timestamp"))
    whole = adjustment.caf_matrix(b, s, b.select("sec_id").distinct().crossJoin(F.broadcast(last)))  # one time
    adjusted = whole.select("sec_id", "trade_date", F.col("adj_close").alias("close"))
    arms = runner.run_comparison(runner.observation_grid(b), b, adjusted, s, leaky_universe=UNIVERSE)
    out = None
    for name, arm in (("leaky", arms.leaky), ("corrected", arms.corrected)):
        m = metrics.metrics_frame(arm.simulation).withColumn("arm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("arm", *[_digits(F.col(n)).alias(n) for n in metrics.NAMES])


# ---- calendar -------------------------------------------------------------------------------------------------------

#: The rules of the exchange's calendar are not SQL; the oracle states the days of one month.
_JANUARY = [d for d in range(2, 31) if date(2024, 1, d).weekday() < 5 and d != 15]


SESSIONS = f"s AS (SELECT d AS session_date, CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE AS open_utc, CAST(d AS TIMESTAMP) + INTERVAL 1260 MINUTE AS close_utc FROM (VALUES {', '.join(f'(DATE {chr(39)}2024-01-{d:02d}{chr(39)})' for d in [*_JANUARY, 31])}) t(d))"


@query(f"WITH {SESSIONS} SELECT * FROM s", dates="session_date")
def trading_sessions_(spark, sf):
    return trading_sessions(spark, date(2024, 1, 1), date(2024, 1, 31))


QUERIES["trading_sessions"], ORACLES["trading_sessions"] = QUERIES.pop("trading_sessions_"), ORACLES.pop("trading_sessions_")


@query(
    f"""WITH {SESSIONS}, e AS (SELECT event_id, ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS d FROM events)
    SELECT event_id, ts, CASE WHEN s.session_date IS NOT NULL AND ts < s.open_utc THEN s.open_utc WHEN s.session_date IS NOT NULL AND ts < s.close_utc THEN ts
        ELSE (SELECT min(n.open_utc) FROM s n WHERE n.session_date > e.d) END AS actionable
    FROM e LEFT JOIN s ON s.session_date = e.d"""
)
def actionable_timestamp(spark, sf):
    e = events(spark, sf).select("event_id", "ts")
    return with_actionable(e, "ts", calendar_days(spark, date(2023, 12, 25), date(2024, 2, 5)))

