"""Which days an incremental run works on, and what it refuses."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)


class Refused(ValueError):
    """A range that must not be run."""


class Failed(RuntimeError):
    """What was written isn't what it should be."""


def bounds(df: DataFrame, column: str = "dt") -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a table; of a Parquet table with that column little more than statistics are read."""
    return tuple(df.agg(F.min(column), F.max(column)).first())


def resolve_range(watermark: dt.date | None, source_min: dt.date | None, source_max: dt.date | None, lookback: int = 0) -> tuple[dt.date, dt.date] | None:
    """The closed range to build: all of the source for an empty target, else the days after its watermark, begun `lookback` days earlier but not before the source.

    None: nothing to do, because the source is empty or has no later day.
    """
    if lookback < 0:
        raise Refused("lookback is negative")
    if source_min is None or source_max is None:
        return None
    first = source_min if watermark is None else max(source_min, watermark + DAY - lookback * DAY)
    return (first, source_max) if first <= source_max else None


def mart_range(target: tuple[dt.date | None, dt.date | None], source: tuple[dt.date | None, dt.date | None], lookback: int = 3) -> tuple[dt.date, dt.date] | None:
    """The range of an automatic mart run: from the target's last day less lookback - 1 to the source's last day. Refuses a start before the target's first day, which would leave a gap unexplained."""
    if source[1] is None:
        return None
    if target[1] is None:
        return source[0], source[1]
    first = max(target[1] - (lookback - 1) * DAY, source[0])
    if target[0] is not None and first < target[0]:
        raise Refused(f"start {first} lies before the first day {target[0]} of the target")
    return (first, source[1]) if first <= source[1] else None


def explicit_range(first: dt.date, last: dt.date) -> tuple[dt.date, dt.date]:
    if first > last:
        raise Refused(f"{first} is after {last}")
    return first, last


@dataclass(frozen=True)
class DryRun:
    """What a run would do."""

    first: dt.date
    last: dt.date
    rows: int
    days: int
    missing: tuple[dt.date, ...]


def day_rows(source: DataFrame, first: dt.date | None, last: dt.date | None, column: str = "dt") -> DataFrame:
    """(column, rows) for every day of a closed range, days that the source lacks with 0. Rows are counted before they meet the days. No range: no rows."""
    held = source.groupBy(column).agg(F.count("*").alias("rows"))
    if first is None or last is None:
        return held.limit(0)
    spine = source.sparkSession.range((last - first).days + 1).select(F.date_add(F.lit(str(first)).cast("date"), F.col("id").cast("int")).alias(column))
    return spine.join(held, column, "left").select(column, F.coalesce("rows", F.lit(0)).alias("rows"))


def dry_run(source: DataFrame, first: dt.date, last: dt.date, column: str = "dt") -> DryRun:
    """Rows and days of the source in the range, and the days of the range that it lacks."""
    per = {r[0]: r[1] for r in source.filter(F.col(column).between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).groupBy(column).count().collect()}
    spine = [first + i * DAY for i in range((last - first).days + 1)]
    return DryRun(first, last, sum(per.values()), len(per), tuple(d for d in spine if d not in per))


def coverage_gate(target: tuple[dt.date | None, dt.date | None], first: dt.date, last: dt.date) -> None:
    """After a run the target must reach from the range's first to its last day, at least."""
    if target[1] is None or target[1] < last or target[0] is None or target[0] > first:
        raise Failed(f"the target covers {target[0]} to {target[1]}, not {first} to {last}")


def drift_outside(target: DataFrame, recomputed: DataFrame, first: dt.date, column: str = "dt") -> DataFrame:
    """Whole rows before the range that a fresh computation would change: late data that no lookback caught."""
    from ledgerloom.operators.recon import symmetric_difference

    early = F.col(column) < F.lit(str(first)).cast("date")
    return symmetric_difference(target.filter(early), recomputed.filter(early), ("stored", "recomputed"))


def verify_written(written: DataFrame, expected: DataFrame, key: str, amount: str) -> None:
    """Count, sum and distinct keys of what was written against what was computed; both in one pass each."""
    stats = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(amount), F.lit(0)), F.count_distinct(key)).first()
    a, b = stats(written), stats(expected)
    if tuple(a) != tuple(b):
        raise Failed(f"written {tuple(a)}, computed {tuple(b)}")
