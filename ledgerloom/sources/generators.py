"""Deterministic inputs of any size, from ranges and hashes: the same arguments give the same rows on any cluster.

All rates, lags and ranges are parameters; their defaults are arbitrary and mean nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of an order's life after it was placed, in the order in which a message may follow another.
STEPS = ("pay", "ship", "finish", "cancel")


def _share(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_000)) / 1_000_000


def _calendar(spark: SparkSession, start: dt.date, days: int) -> DataFrame:
    return spark.range(days).select(F.date_add(F.lit(str(start)).cast("date"), F.col("id").cast("int")).alias("dt"))


def _pick(share: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """The name into whose part of [0, 1) the share falls."""
    total, at, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights:
        at += w / total
        out = F.when(share < at, name) if out is None else out.when(share < at, name)
    return out.otherwise(weights[-1][0])


def orders(spark: SparkSession, start: dt.date, days: int, per_day: int, users: int = 200, products: int = 50, seed: int = 1, no_user: float = 0.04, negative: float = 0.02, statuses: Sequence[tuple[str, float]] = (("paid", 8), ("refund", 1), ("cancel", 1)), amounts: tuple[float, float] = (5, 400)) -> DataFrame:
    """Orders with dt, ids yyyymmdd * 100000 + n; shares of them without user and with a negative amount."""
    if per_day > 100_000:
        raise ValueError("at most 100000 orders a day have an id")
    each = _calendar(spark, start, days).select("dt", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("n"))
    each = each.select("dt", (F.date_format("dt", "yyyyMMdd").cast("bigint") * 100_000 + F.col("n")).alias("order_id"))
    sign = F.when(_share(seed + 4, "order_id") < negative, -1).otherwise(1)
    amount = sign * (F.lit(amounts[0]) + _share(seed + 2, "order_id") * (amounts[1] - amounts[0]))
    second = F.floor(_share(seed + 5, "order_id") * 86_400).cast("int")
    return each.select(
        "order_id", F.when(_share(seed, "order_id") >= no_user, F.floor(_share(seed + 1, "order_id") * users) + 1).alias("user_id"), (F.floor(_share(seed + 6, "order_id") * products) + 1).alias("product_id"),
        amount.cast("decimal(10,2)").alias("amount"), (F.col("dt").cast("timestamp_ntz") + F.make_dt_interval(secs=second)).alias("order_time"), _pick(_share(seed + 3, "order_id"), statuses).alias("status"), "dt",
    )


@dataclass(frozen=True)
class Life:
    """A kind of life that `weight` parts of all orders have: hours from the order to each step; a step that isn't named never comes."""

    weight: float
    hours: dict[str, float] = field(default_factory=dict)


#: Arbitrary defaults.
LIVES = (Life(5, {"pay": 1, "ship": 30, "finish": 100}), Life(2, {"pay": 10, "ship": 70}), Life(2, {"pay": 5, "cancel": 20}), Life(1))


def _due(order_id: Column, lives: Sequence[Life], seed: int) -> Column:
    """Array of (event_type, seconds after the order) for each step that the order's life has."""
    kinds = [(str(i), life.weight) for i, life in enumerate(lives)]
    kind = _pick(_share(seed + 11, order_id), kinds).cast("int")
    by_kind = F.array(*[F.array(*[F.struct(F.lit(s).alias("event_type"), F.lit(int(life.hours[s] * 3600) if s in life.hours else None).cast("int").alias("s")) for s in STEPS]) for life in lives])
    return F.filter(F.element_at(by_kind, kind + 1), lambda x: x.s.isNotNull())


def order_events(orders_: DataFrame, copies: float = 0.02, shifted: float = 0.03, seed: int = 1, lives: Sequence[Life] = LIVES) -> DataFrame:
    """All messages of each order's life, with a share delivered twice, and a share whose event_time really lies three days early."""
    start = F.array(F.struct(F.lit("order").alias("event_type"), F.lit(0).alias("s")))
    each = orders_.select("order_id", "user_id", "product_id", "amount", "order_time", F.explode(F.concat(start, _due(F.col("order_id"), lives, seed))).alias("e"))
    early = F.when(_share(seed + 7, "order_id", "e.event_type") < shifted, -3 * 86_400).otherwise(0)
    timed = each.select("order_id", "user_id", "product_id", "amount", "order_time", "e.event_type", (F.col("order_time") + F.make_dt_interval(secs=F.col("e.s") + early)).alias("event_time"))
    return dirty(timed, copies=copies, seed=seed).withColumn("dt", F.to_date("event_time"))


def order_state(events: DataFrame) -> DataFrame:
    """(order_id, user_id, product_id, amount, order_time, and a time for each step): where every order stands after the events given; the earliest order time, the latest of each step."""
    steps = [F.max(F.when(F.col("event_type") == s, F.col("event_time"))).alias(f"{s}_time") for s in STEPS]
    known = events.filter("order_id IS NOT NULL")
    return known.groupBy("order_id").agg(*[F.max(c).alias(c) for c in ("user_id", "product_id", "amount")], F.min("order_time").alias("order_time"), *steps)


def next_events(events: DataFrame, day: dt.date, seed: int = 1, lives: Sequence[Life] = LIVES) -> DataFrame:
    """The messages of one more day for orders that exist: each step of an order's life that falls on the day, wasn't told yet and isn't after a cancellation or an end already told."""
    today = F.lit(str(day)).cast("date")
    due = order_state(events).withColumn("e", F.explode(_due(F.col("order_id"), lives, seed)))
    at = F.col("order_time") + F.make_dt_interval(secs=F.col("e.s"))
    told = F.coalesce(*[F.when(F.col("e.event_type") == s, F.col(f"{s}_time").isNotNull()) for s in STEPS])
    ended = F.coalesce("cancel_time", "finish_time").isNotNull()
    return due.filter((F.to_date(at) == today) & ~told & ~ended).select("order_id", "user_id", "product_id", "amount", "order_time", "e.event_type", at.alias("event_time"), today.alias("dt"))


def dirty(events: DataFrame, copies: float = 0, no_user: float = 0, negative: float = 0, huge: float = 0, late_days: int = 0, late: float = 0, swapped: float = 0, regressed: float = 0, seed: int = 1) -> DataFrame:
    """The messages with shares of them spoiled, each kind independent of the others: delivered twice, without user, with a negative or a far too large amount, with an event_time `late_days`
    early, with the times of a day turned round (an order of events that can't be), and followed by a message of the order's first step once more."""
    hit = lambda n, share: _share(seed + 20 + n, "order_id", "event_type") < share
    amount = F.when(hit(2, huge), F.lit(9_999_999).cast("decimal(10,2)")).when(hit(1, negative), -F.abs("amount")).otherwise(F.col("amount")).cast("decimal(10,2)")
    moved = F.when(hit(3, late), F.col("event_time") - F.make_dt_interval(days=F.lit(late_days))).when(hit(4, swapped), F.col("event_time") - F.make_dt_interval(hours=F.lit(12))).otherwise(F.col("event_time"))
    out = events.withColumns({"user_id": F.when(~hit(0, no_user), F.col("user_id")), "amount": amount, "event_time": moved})
    again = F.concat(F.array(F.col("event_type")), F.when(hit(5, copies), F.array(F.col("event_type"))).otherwise(F.array().cast("array<string>")), F.when(hit(6, regressed), F.array(F.lit("order"))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("event_type", F.explode(again))


def in_order(events: DataFrame) -> DataFrame:
    """The messages as they are sent: by time, then order, then step; a total order of the columns, so that a replay sends the same."""
    step = F.array_position(F.array(F.lit("order"), *map(F.lit, STEPS)), F.col("event_type"))
    return events.orderBy("event_time", "order_id", step, "user_id", "product_id", "amount")


def products(spark: SparkSession, start: dt.date, days: int, count: int = 50, seed: int = 1, moved: float = 0.1, repriced: float = 0.1, off: float = 0.1, categories: int = 6, brands: int = 4) -> DataFrame:
    """Full snapshots: each day a share of the products has moved to another category, has another price, or is off sale."""
    each = _calendar(spark, start, days).select(F.col("dt").alias("snapshot_date"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))).alias("product_id"))
    pid, when = F.col("product_id"), F.col("snapshot_date").cast("string")
    turn = lambda n, share: F.when(_share(seed + n, pid, when) < share, when).otherwise("")
    category = F.floor(_share(seed + 30, pid, turn(31, moved)) * categories)
    return each.select(
        "product_id", F.concat(F.lit("product "), "product_id").alias("product_name"), F.concat(F.lit("category "), category.cast("string")).alias("category"), F.concat(F.lit("brand "), F.floor(_share(seed + 32, pid) * brands).cast("string")).alias("brand"),
        (1 + 99 * _share(seed + 33, pid, turn(34, repriced))).cast("decimal(10,2)").alias("price"), F.when(_share(seed + 35, pid, when) < off, "off_shelf").otherwise("on_sale").alias("status"), F.col("snapshot_date").cast("timestamp_ntz").alias("update_time"), "snapshot_date",
    )
