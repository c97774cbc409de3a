"""The New York trading calendar, by rule, and the time at which an event becomes actionable."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK = ZoneInfo("America/New_York")
OPEN, CLOSE, EARLY = time(9, 30), time(16, 0), time(13, 0)
BUFFER_MINUTES = 15

# Days without trading that no holiday rule gives.
CLOSURES = {
    date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11), date(2007, 1, 2),
    date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9), date(1994, 4, 27), date(1985, 9, 27),
}


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; from its end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def _observed(day: date) -> date:
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    out = {_nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:  # a Saturday's New Year is not moved into the old year
        out.add(_observed(date(year, 1, 1)))
    if year >= 1998:
        out.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return out | {d for d in CLOSURES if d.year == year}


def early_closes(year: int) -> set[date]:
    """Days that close at 13:00: after Thanksgiving, before Christmas and before Independence Day, if they trade."""
    days = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 12, 24)}
    if date(year, 7, 4).weekday() in (1, 2, 3, 4):
        days.add(date(year, 7, 3))
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


class TradingCalendar:
    """Sessions of the exchange; naive times are read as UTC."""

    def is_session(self, day: date | datetime) -> bool:
        day = self._day(day)
        return day.weekday() < 5 and day not in holidays(day.year)

    def next_session(self, day: date | datetime) -> date:
        day = self._day(day) + timedelta(1)
        while not self.is_session(day):
            day += timedelta(1)
        return day

    def previous_session(self, day: date | datetime) -> date:
        day = self._day(day) - timedelta(1)
        while not self.is_session(day):
            day -= timedelta(1)
        return day

    def session_open(self, day: date) -> datetime:
        return datetime.combine(day, OPEN, NEW_YORK)

    def session_close(self, day: date) -> datetime:
        return datetime.combine(day, EARLY if day in early_closes(day.year) else CLOSE, NEW_YORK)

    def sessions(self, start: date, end: date) -> list[date]:
        return [d for i in range((end - start).days + 1) if self.is_session(d := start + timedelta(i))]

    def actionable(self, event: datetime, is_market_data: bool = False, buffer_minutes: int = BUFFER_MINUTES) -> datetime:
        """When the event can be acted on, in UTC."""
        at = (event if event.tzinfo else event.replace(tzinfo=UTC)).astimezone(NEW_YORK)
        day = at.date()
        if is_market_data:
            session = day if self.is_session(day) else self.previous_session(day)
            return (self.session_close(session) + timedelta(minutes=buffer_minutes)).astimezone(UTC)
        if self.is_session(day):
            if at < self.session_open(day):
                return self.session_open(day).astimezone(UTC)
            if at < self.session_close(day):
                return at.astimezone(UTC)
        return self.session_open(self.next_session(day)).astimezone(UTC)

    @staticmethod
    def _day(day: date | datetime) -> date:
        if isinstance(day, datetime):
            return (day if day.tzinfo else day.replace(tzinfo=UTC)).astimezone(NEW_YORK).date()
        return day


def _utc(t: datetime) -> datetime:
    return t.astimezone(UTC).replace(tzinfo=None)


def calendar_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row for each day: (day, is_session, open_utc, close_utc, previous_close_utc, next_open_utc). Small by nature."""
    c, rows = TradingCalendar(), []
    for i in range((end - start).days + 1):
        d = start + timedelta(i)
        trades = c.is_session(d)
        rows.append((d, trades, _utc(c.session_open(d)) if trades else None, _utc(c.session_close(d)) if trades else None, _utc(c.session_close(c.previous_session(d))), _utc(c.session_open(c.next_session(d)))))
    return spark.createDataFrame(rows, "day date, is_session boolean, open_utc timestamp_ntz, close_utc timestamp_ntz, previous_close_utc timestamp_ntz, next_open_utc timestamp_ntz")


def trading_sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(session_date, open_utc, close_utc) of all sessions between two days."""
    return calendar_days(spark, start, end).where("is_session").select(F.col("day").alias("session_date"), "open_utc", "close_utc")


def with_actionable(df: DataFrame, ts: str, days: DataFrame, *, market_data: bool = False, buffer_minutes: int = BUFFER_MINUTES, name: str = "actionable") -> DataFrame:
    """Add the actionable time of a UTC timestamp column; `days` is calendar_days() over its range."""
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col(ts)))
    rows = df.withColumn("_day", local).join(F.broadcast(days.withColumnRenamed("day", "_day")), "_day", "left")
    if market_data:
        close = F.when(F.col("is_session"), F.col("close_utc")).otherwise(F.col("previous_close_utc"))
        value = close + F.make_dt_interval(mins=F.lit(buffer_minutes))
    else:
        inside = F.when(F.col(ts) < F.col("open_utc"), F.col("open_utc")).when(F.col(ts) < F.col("close_utc"), F.col(ts)).otherwise(F.col("next_open_utc"))
        value = F.when(F.col("is_session"), inside).otherwise(F.col("next_open_utc"))
    return rows.withColumn(name, value).drop("_day", "is_session", "open_utc", "close_utc", "previous_close_utc", "next_open_utc")
