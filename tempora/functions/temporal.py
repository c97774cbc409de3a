"""Times: everything is UTC without a zone inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_utc(df: DataFrame, column: str) -> DataFrame:
    """Cast a date or timestamp column to timestamp_ntz in UTC: zoned values are converted, others only relabelled."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.TimestampType):
        zone = F.current_timezone()
        return df.withColumn(column, F.convert_timezone(zone, F.lit("UTC"), F.col(column).cast("timestamp_ntz")))
    if isinstance(kind, (T.DateType, T.StringType)):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    raise ValueError(f"{column} is {kind.simpleString()}, not a time")


def iso_weekday(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def at_time(day: Column, hours: int, minutes: int = 0) -> Column:
    """A date at a time of day, as a timestamp."""
    return (day.cast("timestamp_ntz") + F.expr(f"INTERVAL '{hours}:{minutes:02d}' HOUR TO MINUTE")).cast("timestamp_ntz")


def quarter_end(day: Column) -> Column:
    """Last day of the quarter."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def previous_quarter_end(day: Column) -> Column:
    """Last quarter end strictly before the day's quarter."""
    return F.date_sub(F.trunc(day, "quarter"), 1)


def business_days(df: DataFrame, start: str, end: str, name: str = "day") -> DataFrame:
    """One row for each Monday to Friday between two date columns, both included."""
    days = F.explode(F.sequence(F.col(start), F.col(end)))
    return df.withColumn(name, days).where(F.weekday(name) < 5)
