"""Half-open intervals: as models for single values, as Column predicates for tables. An open end is null."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = datetime | date


def _check(start: Point, end: Point | None, what: str) -> None:
    if end is not None and not start < end:
        raise ValueError(f"{what}_from must lie before {what}_to")


@dataclass(frozen=True)
class ValidInterval:
    """When a fact was true: [valid_from, valid_to)."""

    valid_from: Point
    valid_to: Point | None = None

    def __post_init__(self) -> None:
        _check(self.valid_from, self.valid_to, "valid")

    def contains(self, point: Point) -> bool:
        return self.valid_from <= point and (self.valid_to is None or point < self.valid_to)

    def overlaps(self, other: ValidInterval) -> bool:
        return (other.valid_to is None or self.valid_from < other.valid_to) and (self.valid_to is None or other.valid_from < self.valid_to)


@dataclass(frozen=True)
class TransactionInterval:
    """When a fact was known: [known_from, known_to)."""

    known_from: datetime
    known_to: datetime | None = None

    def __post_init__(self) -> None:
        _check(self.known_from, self.known_to, "known")

    def is_known_at(self, observation_timestamp: datetime) -> bool:
        return self.known_from <= observation_timestamp and (self.known_to is None or observation_timestamp < self.known_to)


def contains(start: Column, end: Column, point: Column) -> Column:
    """start <= point < end; a null end is open."""
    return (start <= point) & (end.isNull() | (point < end))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open intervals share a point; touching ones do not."""
    return (other_end.isNull() | (start < other_end)) & (end.isNull() | (other_start < end))


def two_axis(valid_from: Column, valid_to: Column, known_from: Column, known_to: Column, valid_at: Column, known_at: Column) -> Column:
    """True at `valid_at`, as known at `known_at`."""
    return contains(valid_from, valid_to, valid_at) & contains(known_from, known_to, known_at)
