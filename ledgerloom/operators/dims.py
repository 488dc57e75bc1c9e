"""Type-1 and type-2 dimensions from full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import OPEN_END, differs

#: The attributes that the two variants of the history track.
TRACKED_3 = ("category", "price", "status")
TRACKED_5 = ("product_name", "category", "brand", "price", "status")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest in `order`, nulls last, then in all other columns. Rows are reduced before they move, whatever a key repeats."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    top = F.max(F.struct(*order, *rest)).alias("top")
    return df.groupBy(*keys).agg(top).select(*[F.col(c) if c in keys else F.col(f"top.`{c}`").alias(c) for c in df.columns])


def scd1_latest(snapshots: DataFrame, key: str = "product_id", order: Sequence[str] = ("snapshot_date", "update_time")) -> DataFrame:
    """The latest known row of every key; rows without a key are left out."""
    return latest_per(snapshots.filter(F.col(key).isNotNull()), [key], order)


def _changed(tracked: Sequence[str], w: Window) -> Column:
    first = F.row_number().over(w) == 1
    other = [differs(F.lag(c).over(w), F.col(c)) for c in tracked]
    out = first
    for c in other:
        out = out | c
    return out


def scd2_full(snapshots: DataFrame, key: str, order: str, tracked: Sequence[str], version: str = "update_time") -> DataFrame:
    """The whole history by windows: a version starts where a tracked attribute differs (null-safe) from the key's snapshot before, and ends the day before the next; the last is open.

    Of several rows of a key in a snapshot the latest `version` counts. Columns: key, valid_from, valid_to, is_current, all other columns.
    """
    rows = latest_per(snapshots.filter(F.col(key).isNotNull() & F.col(order).isNotNull()), [key, order], [version])
    w = Window.partitionBy(key).orderBy(order)
    starts = rows.withColumn("__new", _changed(tracked, w)).filter("__new").drop("__new")
    return _with_ends(starts.withColumnRenamed(order, "valid_from"), key)


def _with_ends(starts: DataFrame, key: str) -> DataFrame:
    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    rest = [c for c in starts.columns if c not in (key, "valid_from")]
    return starts.withColumn("__next", following).select(
        key, "valid_from", F.coalesce(F.date_sub("__next", 1), F.lit(OPEN_END).cast("date")).alias("valid_to"), F.col("__next").isNull().cast("int").alias("is_current"), *rest
    )


def scd2_incremental(history: DataFrame, snapshots: DataFrame, key: str, order: str, tracked: Sequence[str], version: str = "update_time") -> DataFrame:
    """The history with later snapshots applied; equal to a full rebuild over all of them.

    Only keys with new snapshots are worked on: their open version stands as the row before the first new snapshot, so that one is compared with it, later
    ones with the snapshot before. Open versions that a change follows are closed the day before it. Snapshots up to the
    history's latest start of the same key are ignored, so applying the same ones again changes nothing.
    """
    cols = [key, "valid_from", *[c for c in history.columns if c not in (key, "valid_from", "valid_to", "is_current")]]
    new = latest_per(snapshots.filter(F.col(key).isNotNull() & F.col(order).isNotNull()), [key, order], [version]).withColumnRenamed(order, "valid_from").select(cols)
    touched = new.select(key).distinct()
    old_touched = history.join(touched, key, "left_semi")
    current = old_touched.filter("is_current = 1").select(cols)
    latest = old_touched.groupBy(key).agg(F.max("valid_from").alias("__since"))
    fresh = new.join(latest, key, "left").filter("__since IS NULL OR valid_from > __since").drop("__since")
    w = Window.partitionBy(key).orderBy("valid_from")
    starts = current.unionByName(fresh).withColumn("__new", _changed(tracked, w)).filter("__new").drop("__new")
    closed = old_touched.filter("is_current <> 1 OR is_current IS NULL")
    kept = history.join(touched, key, "left_anti")
    return kept.unionByName(closed).unionByName(_with_ends(starts, key).select(history.columns))


def current_from_scd2(history: DataFrame, key: str = "product_id") -> DataFrame:
    """The last version of every key, without its validity."""
    return latest_per(history, [key], ["valid_from"]).drop("valid_from", "valid_to", "is_current")
