"""Views over the stored tables, queried in SQL."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tempora.operators.bitemporal import view_sql
from tempora.operators.entity import ticker_map_sql
from tempora.sources.storage import read_table

VIEWS = {"fact_market_ohlcv_raw": "market_ohlcv", "fact_corporate_actions": "corporate_actions", "dim_security_ticker_raw": "entity_map", "fact_fundamentals_raw": "fundamentals"}


class Catalog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.refresh()

    def refresh(self) -> None:
        """Register all views anew; a table without files is an empty view of its schema."""
        for view, table in VIEWS.items():
            read_table(self.spark, self.base, table).createOrReplaceTempView(view)
        self.spark.sql(ticker_map_sql()).createOrReplaceTempView("v_bitemporal_ticker_map")
        self.spark.sql(view_sql("fact_fundamentals_raw", ["sec_id", "metric_name", "fiscal_period_end"])).createOrReplaceTempView("v_bitemporal_fundamentals")

    def query(self, sql: str, params: Sequence | None = None) -> DataFrame:
        """A lazy frame: its plan joins that of whatever uses it, so columns and conditions reach the scan."""
        return self.spark.sql(sql, args=list(params)) if params else self.spark.sql(sql)

    def query_arrow(self, sql: str, params: Sequence | None = None) -> pa.Table:
        """The result as an Arrow table, on the driver."""
        return self.query(sql, params).toArrow()

    def register_arrow(self, name: str, data: pa.Table) -> DataFrame:
        """A view over an Arrow table."""
        frame = self.spark.createDataFrame(data)
        frame.createOrReplaceTempView(name)
        return frame

    def close(self) -> None:
        for view in [*VIEWS, "v_bitemporal_ticker_map", "v_bitemporal_fundamentals"]:
            self.spark.catalog.dropTempView(view)
