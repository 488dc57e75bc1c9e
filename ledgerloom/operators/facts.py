"""Order facts and the marts above them. All are functions from frames to frames; day ranges are closed and prune partitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.asof import attributes_at
from ledgerloom.operators.dims import latest_per

EVENTS = ("order", "pay", "ship", "finish", "cancel")
Day = dt.date | str | None


def between_days(df: DataFrame, first: Day, last: Day, column: str = "dt") -> DataFrame:
    """Rows with first <= column <= last; None leaves that end open."""
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(str(first)).cast("date"))
    if last is not None:
        df = df.filter(F.col(column) <= F.lit(str(last)).cast("date"))
    return df


def order_detail(orders: DataFrame, first: Day = None, last: Day = None) -> DataFrame:
    """Cleaned orders: with a user, amount without sign, one row per (dt, order_id): the largest amount, of equal ones the largest in the other columns."""
    rows = between_days(orders, first, last).filter("user_id IS NOT NULL").withColumn("amount", F.abs("amount"))
    return latest_per(rows.select("order_id", "dt", "user_id", "product_id", "amount", "order_time", "status"), ["dt", "order_id"], ["amount", "order_time", "status", "user_id", "product_id"])


def first_events(events: DataFrame) -> DataFrame:
    """One row per (dt, order_id, event_type): the earliest event_time, then order_time, nulls last, then the smallest in the other columns."""
    keys = ["dt", "order_id", "event_type"]
    order = ["event_time", "order_time", "user_id", "product_id", "amount"]
    least = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in order])).alias("top")
    return events.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"top.{c}.v").alias(c) for c in events.columns])


def version_at(facts: DataFrame, history: DataFrame, key: str = "product_id", day: str = "dt", how: str = "left") -> DataFrame:
    """Facts with the attributes and validity of the version valid on `day`; how: left keeps facts without one, inner doesn't. By attributes_at, so no fact meets all versions of its key."""
    names = {"valid_from": "valid_from", "valid_to": "valid_to", "category": "category", "brand": "brand", "price": "sku_price"}
    v = history.select(key, *[F.col(c).alias(f"__v_{n}") for c, n in names.items()])
    joined = attributes_at(facts, v, key, day, [f"__v_{n}" for n in names.values()], "__v_valid_from", "__v_valid_to")
    found = joined if how == "left" else joined.filter("asof_found")
    return found.drop("asof_found").withColumnsRenamed({f"__v_{n}": n for n in names.values()})


def orphans(facts: DataFrame, history: DataFrame, key: str = "product_id", day: str = "dt") -> DataFrame:
    """Facts without a valid version."""
    v = history.select(key, F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    return attributes_at(facts, v, key, day, [], "__from", "__to").filter("NOT asof_found").drop("asof_found")


def scope_orders(events: DataFrame, first: Day, last: Day) -> DataFrame:
    """Orders with an event in the range."""
    return between_days(events, first, last).select("order_id").filter("order_id IS NOT NULL").distinct()


def lifecycle(events: DataFrame, scope: DataFrame | None = None, update_time: dt.datetime | None = None) -> DataFrame:
    """One row per order: milestones, stage and lags from all its events, however many copies of them there are. With a scope only its orders, but over their whole past.

    A milestone is the latest event_time of its type, null if there is none. The stage is the milestone that happened last, of equal times the one nearest to the end (cancel, finish,
    ship, pay, order); an order without any time is in stage order, with last_event_time 1970-01-01. pay_lag_hours are whole hours from order to pay, toward zero; ship_lag_days and
    finish_lag_days are dates from order to ship and to finish. Null where a milestone is missing. Event types count in any case and with blanks around them. Rows without order_id are left out.
    `update_time` is given, so that the same events give the same rows; null if it isn't.
    """
    if scope is not None:
        events = events.join(scope, "order_id", "left_semi")
    kind = F.lower(F.trim("event_type"))
    moments = [F.max(F.when(kind == e, F.col("event_time"))).alias(e) for e in EVENTS]
    base = events.filter("order_id IS NOT NULL").groupBy("order_id").agg(*[F.max(c).alias(c) for c in ("user_id", "product_id", "amount")], *moments)
    last = F.coalesce(F.greatest(*EVENTS), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    stage = F.coalesce(*[F.when(F.col(e) == last, F.lit(e)) for e in reversed(EVENTS)], F.lit("order"))
    days = lambda e: F.datediff(F.col(e), F.col("order")).cast("bigint").alias(f"{e}_lag_days")
    return base.select(
        "order_id", "user_id", "product_id", "amount", *[F.col(e).alias(f"{e}_time") for e in EVENTS], stage.alias("current_stage"),
        F.expr("timestampdiff(HOUR, `order`, pay)").cast("bigint").alias("pay_lag_hours"), days("ship"), days("finish"), last.alias("last_event_time"), F.lit(update_time).cast("timestamp_ntz").alias("update_time"),
    )


def expected_lifecycle(events: DataFrame) -> DataFrame:
    """What lifecycle() must hold, derived another way, to check a stored table against: events are pivoted in long form, the last event is picked as a whole. Without update_time."""
    seen = events.filter("order_id IS NOT NULL").withColumn("kind", F.lower(F.trim("event_type")))
    last = F.max_by("kind", F.struct("event_time", F.array_position(F.array(*map(F.lit, EVENTS)), F.col("kind"))))
    timed = seen.filter(F.col("kind").isin(*EVENTS) & F.col("event_time").isNotNull())
    ends = timed.groupBy("order_id").agg(last.alias("stage"), F.max("event_time").alias("last"))
    wide = timed.groupBy("order_id").pivot("kind", list(EVENTS)).agg(F.max("event_time"))
    who = seen.groupBy("order_id").agg(F.max("user_id").alias("user_id"), F.max("product_id").alias("product_id"), F.max("amount").alias("amount"))
    gap = "(unix_seconds(CAST(pay AS timestamp)) - unix_seconds(CAST(`order` AS timestamp)))"
    return who.join(ends, "order_id", "left").join(wide, "order_id", "left").selectExpr(
        "order_id", "user_id", "product_id", "amount", *[f"`{e}` AS {e}_time" for e in EVENTS], "coalesce(stage, 'order') AS current_stage",
        f"CAST(sign({gap}) * floor(abs({gap}) / 3600) AS bigint) AS pay_lag_hours", "CAST(unix_date(CAST(ship AS date)) - unix_date(CAST(`order` AS date)) AS bigint) AS ship_lag_days",
        "CAST(unix_date(CAST(finish AS date)) - unix_date(CAST(`order` AS date)) AS bigint) AS finish_lag_days", "coalesce(last, CAST('1970-01-01' AS timestamp_ntz)) AS last_event_time",
    )


def _amount(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("amount")).otherwise(F.lit(0).cast("decimal(10,2)"))).cast("decimal(18,2)")


def user_order_day(detail: DataFrame, first: Day = None, last: Day = None) -> DataFrame:
    """Orders, paid orders and amounts per user and day."""
    paid, refund = F.col("status") == "paid", F.col("status") == "refund"
    return between_days(detail, first, last).groupBy("user_id", "dt").agg(F.count("*").alias("order_cnt"), F.count_if(paid).alias("paid_cnt"), F.coalesce(_amount(paid), F.lit(0)).cast("decimal(18,2)").alias("paid_amount"), F.coalesce(_amount(refund), F.lit(0)).cast("decimal(18,2)").alias("refund_amount"))


def daily_sales(user_day: DataFrame) -> DataFrame:
    """Sums per day of user_order_day, and ratios of the sums; a ratio over 0 is null."""
    s = lambda c, kind: F.sum(c).cast(kind).alias(c)
    sums = user_day.groupBy("dt").agg(s("order_cnt", "bigint"), s("paid_cnt", "bigint"), s("paid_amount", "decimal(18,2)"), s("refund_amount", "decimal(18,2)"))
    ratio = lambda a, b, digits: F.round(F.col(a).cast("decimal(20,2)") / F.nullif(F.col(b).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")), digits)
    return sums.withColumns({"net_amount": (F.col("paid_amount") - F.col("refund_amount")).cast("decimal(18,2)"), "avg_order_amount": ratio("paid_amount", "paid_cnt", 2).cast("decimal(18,2)"), "pay_rate": ratio("paid_cnt", "order_cnt", 4).cast("decimal(10,4)")})


def category_day(sku_detail: DataFrame) -> DataFrame:
    """Orders and amount per day and category."""
    return sku_detail.groupBy("dt", "category").agg(F.count("*").alias("orders"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
