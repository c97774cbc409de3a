"""Backward as-of joins.

Facts of all views that share a key and observations are united, and one window carries the last fact of each view
forward: one shuffle by key, a sort, a scan, however many views there are. A fact at the very time of an observation
counts; of facts at one time the latest ingested wins. A fact that has expired by the time of the observation gives
nulls, and the observation stays. A fact without a key or a time is never found, and an observation without one finds
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.temporal import to_utc

TIME_KEYS = ("acceptance_time", "observation_timestamp", "timestamp")
BOUND_KEYS = ("derived_known_to", "known_to", "derived_valid_to", "valid_to")


def time_key(columns: Sequence[str], preferred: str | None = None) -> str:
    """The column that says since when a fact holds."""
    if preferred:
        if preferred not in columns:
            raise ValueError(f"there is no column {preferred}")
        return preferred
    if "known_from" in columns and "valid_from" in columns:
        raise ValueError("both known_from and valid_from are present: name the one to join on")
    for name in ("known_from", "valid_from"):
        if name in columns:
            return name
    found = [c for c in TIME_KEYS if c in columns]
    if len(found) != 1:
        raise ValueError(f"expected one time column, found {found or 'none'}")
    return found[0]


def bound_key(columns: Sequence[str], preferred: str | None = None) -> str | None:
    """The column that says until when a fact holds, if there is one."""
    if preferred:
        if preferred not in columns:
            raise ValueError(f"there is no column {preferred}")
        return preferred
    found = [c for c in BOUND_KEYS if c in columns]
    if len(found) > 1:
        raise ValueError(f"several upper bounds: {found}; name one")
    return found[0] if found else None


def observation_matrix(df: DataFrame, key: str = "sec_id", at: str = "observation_timestamp", *, check_nulls: bool = False, reject_nulls: bool = False) -> DataFrame:
    """Observations with a string key and a UTC time.

    `check_nulls` runs a job that rejects null keys and times at once; `reject_nulls` makes the plan itself fail on the
    first of them, which costs no further pass over the observations.
    """
    missing = [c for c in (key, at) if c not in df.columns]
    if missing:
        raise ValueError(f"observations lack {missing}")
    out = to_utc(df.withColumn(key, F.col(key).cast("string")), at)
    if check_nulls and not out.where(F.col(key).isNull() | F.col(at).isNull()).isEmpty():
        raise ValueError("observations have null keys or times")
    if reject_nulls:
        for c in (key, at):
            out = out.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"observations have a null {c}")).cast(out.schema[c].dataType)))
    return out


@dataclass(frozen=True)
class _View:
    """Facts as they enter the union, and the names that their payload gets."""

    facts: DataFrame
    named: dict[str, str]


def _view(right: DataFrame, taken: Sequence[str], by: Sequence[str], *, right_on: str | None, right_by: Sequence[str] | None, bound: str | None, seq: str, payload: Sequence[str] | None, prefix: str, keep_time: bool) -> _View:
    start, end = time_key(right.columns, right_on), bound_key(right.columns, bound)
    right_by = list(right_by or by)
    reserved = {start, end, seq, *right_by} | ({"trade_date"} - set(taken))
    wanted = list(payload) if payload is not None else [c for c in right.columns if c not in reserved]
    if keep_time:
        wanted += [c for c in (start, end) if c and c not in wanted]
    full = {c: (prefix if prefix.endswith("_") else f"{prefix}_") + c if prefix else c for c in wanted}
    named = {c: n + ("_feature" if n in taken else "") for c, n in full.items()}
    facts = to_utc(right, start)
    if end:
        facts = to_utc(facts, end)
    order_of = F.col(seq).cast("long") if seq in right.columns else F.lit(0).cast("long")
    keys = [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(right_by)]
    until = (F.col(end) if end else F.lit(None).cast("timestamp_ntz")).alias("until")
    facts = facts.select(*keys, F.col(start).alias("_at"), order_of.alias("_seq"), F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(wanted)], until).alias("_fact"))
    return _View(facts.dropna(subset=[*[f"_k{i}" for i in range(len(right_by))], "_at"]), named)


def _carried(left: DataFrame, views: Sequence[_View], at: str, by: Sequence[str], split_by: str | None) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(by))]
    rows = to_utc(left, at)
    both = rows.select(*[F.col(c).cast("string").alias(k) for c, k in zip(by, keys, strict=True)], F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    for v, view in enumerate(views):
        both = both.unionByName(view.facts.withColumn("_side", F.lit(0)).withColumnRenamed("_fact", f"_fact{v}"), allowMissingColumns=True)
    spans = []
    if split_by:
        both, spans = both.withColumn("_span", F.date_trunc(split_by, "_at").cast("timestamp_ntz")), ["_span"]
    order = Window.partitionBy(*keys, *spans).orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("*", *[F.last(f"_fact{v}", ignorenulls=True).over(order).alias(f"_last{v}") for v in range(len(views))]).where("_side = 1")
    if split_by:
        last = [F.max_by(f"_fact{v}", F.when(F.col(f"_fact{v}").isNotNull(), F.struct("_at", "_seq"))).alias(f"_end{v}") for v in range(len(views))]
        earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        before = [F.last(f"_end{v}", ignorenulls=True).over(earlier).alias(f"_before{v}") for v in range(len(views))]
        ends = both.groupBy(*keys, "_span").agg(*last).select(*[F.col(k).alias(f"_e{k}") for k in keys], F.col("_span").alias("_espan"), *before)
        same = F.col("_span") == F.col("_espan")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_e{k}"))
        found = found.join(ends, same, "left")
        for v in range(len(views)):
            found = found.withColumn(f"_last{v}", F.coalesce(f"_last{v}", f"_before{v}"))
    out = [F.col("_row.*")]
    for v, view in enumerate(views):
        live = F.col(f"_last{v}.until").isNull() | (F.col("_at") < F.col(f"_last{v}.until"))
        out += [F.when(live, F.col(f"_last{v}.p{i}")).alias(n) for i, n in enumerate(view.named.values())]
    return found.select(*out)


def asof_join(
    left: DataFrame, right: DataFrame, *, at: str = "observation_timestamp", by: Sequence[str] = ("sec_id",), right_on: str | None = None, right_by: Sequence[str] | None = None,
    bound: str | None = None, seq: str = "ingestion_seq", payload: Sequence[str] | None = None, prefix: str = "", keep_time: bool = False,
    split_by: str | None = None,
) -> DataFrame:
    """Each row of `left` with the last row of `right` at or before it.

    `payload` names the columns to bring over; by default all but keys, times, the sequence and a `trade_date` that the
    left side lacks. They are named with `prefix` and one "_" before, and with "_feature" after where the left side has the
    name already. `keep_time` brings the fact's times too.

    `split_by` ("month", "day", ...) cuts the time line of each key into such spans, for keys that hold a large share of
    all rows: a task then scans a span, and the last fact before it is carried in from the spans' own last facts.
    """
    view = _view(right, left.columns, by, right_on=right_on, right_by=right_by, bound=bound, seq=seq, payload=payload, prefix=prefix, keep_time=keep_time)
    return _carried(left, [view], at, by, split_by)


def asof_join_many(
    left: DataFrame, views: Sequence[DataFrame | str], *, at: str = "observation_timestamp", by: Sequence[str] = ("sec_id",), right_on: str | None = None, right_by: Sequence[str] | None = None,
    bound: str | None = None, seq: str = "ingestion_seq", payload: Sequence[str] | None = None, prefix: str = "", keep_time: bool = False, split_by: str | None = None,
) -> DataFrame:
    """What asof_join gives over views one after another, in one shuffle; views are frames or names of registered ones."""
    taken, made = list(left.columns), []
    for v in views:
        right = left.sparkSession.table(v) if isinstance(v, str) else v
        made.append(_view(right, taken, by, right_on=right_on, right_by=right_by, bound=bound, seq=seq, payload=payload, prefix=prefix, keep_time=keep_time))
        taken += made[-1].named.values()
    return _carried(left, made, at, by, split_by) if made else left
