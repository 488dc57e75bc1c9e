"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import differs, fresh, hash_pair
from ledgerloom.plans.joins import small


def latest_hashes(rows: DataFrame, key: str, snapshot: str, version: str, tracked: Sequence[str], *more: F.Column) -> DataFrame:
    """(s, k, top): per snapshot and key the row with the latest `version`, as struct (u, h1, h2); of rows alike in it, the one with the larger hash.

    A null version comes before all others. Rows are reduced before they move, so a key repeated any number of times is one row per map task.
    """
    h1, h2 = hash_pair([F.col(f"`{c}`") for c in tracked])
    picked = rows.select(F.col(f"`{snapshot}`").alias("s"), F.col(f"`{key}`").alias("k"), F.struct(F.col(f"`{version}`").alias("u"), h1.alias("h1"), h2.alias("h2")).alias("top"), *more)
    return picked.groupBy("s", "k", *[F.col(c) for c in picked.columns[3:]]).agg(F.max("top").alias("top"))


def snapshot_changes(rows: DataFrame, key: str, snapshot: str, version: str, tracked: Sequence[str]) -> DataFrame:
    """(key, snapshot, change): keys added, removed and changed from each delivered snapshot to the next.

    Delivered snapshots are the distinct non-null values of `snapshot` in the whole table; each gets an index. A window per key over the
    index compares each row with the one before: other hashes of the tracked attributes at the next index are a change; an index gap is a
    removal after its first end and an addition at its second. The first snapshot has no cases. Of several rows of a key in a snapshot
    the one with the latest `version` counts. Rows without a snapshot belong to none and are left out; a null key is a key.
    `version` isn't compared. A window holds one row per snapshot of a key at most, whatever was repeated.
    """
    delivered = rows.filter(F.col(f"`{snapshot}`").isNotNull())
    order = Window.orderBy("s")  # over distinct snapshots only
    days = delivered.select(F.col(f"`{snapshot}`").alias("s")).distinct().select("s", F.row_number().over(order).alias("i"), F.lead("s").over(order).alias("next_s"))
    placed = latest_hashes(delivered, key, snapshot, version, tracked).join(small(days), "s")
    w = Window.partitionBy("k").orderBy("i")
    seen = placed.select(
        "k", "s", "i", "next_s", F.lag("i").over(w).alias("before"), F.lead("i").over(w).alias("after"),
        (differs(F.lag("top.h1").over(w), F.col("top.h1")) | differs(F.lag("top.h2").over(w), F.col("top.h2"))).alias("other"),
    )
    i, before, after = F.col("i"), F.col("before"), F.col("after")

    def case(when: F.Column, s: str, change: str) -> F.Column:
        return F.when(when, F.struct(F.col(s).alias("s"), F.lit(change).alias("change")))

    cases = F.array(
        case((i > 1) & (before.isNull() | (i - before > 1)), "s", "added"),
        case(F.col("next_s").isNotNull() & (after.isNull() | (after - i > 1)), "next_s", "removed"),
        case((i - before == 1) & F.col("other"), "s", "changed"),
    )
    flat = seen.select(F.col("k").alias(key), F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("c"))
    return flat.select(F.col(f"`{key}`"), F.col("c.s").alias(snapshot), F.col("c.change").alias(fresh([key, snapshot], "change_type")))
