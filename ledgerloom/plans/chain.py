"""Queries over the order chain: the reference's operators on the tables of a data directory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import day
from ledgerloom.operators import checks, dims, facts, recon
from ledgerloom.plans.scratch import new_path
from ledgerloom.plans.warehouse import LifecycleTable
from ledgerloom.sources.tables import table
from ledgerloom.sources.versioned import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Constants of the queries below and of their SQL.
CUT, LIFE_CUT = "2024-03-01", "2024-03-05"
AS_OF = dt.datetime(2024, 3, 5, 6, 7, 8)
SCOPE = ("2024-03-03", "2024-03-04")


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _days(df: DataFrame) -> DataFrame:
    """Dates as strings, so that results compare across engines."""
    return df.withColumns({c: day(F.col(c)) for c, t in df.dtypes if t == "date"})


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ods_order")


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ods_order_event")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ods_product")


def _detail(s: SparkSession, d: str) -> DataFrame:
    return facts.order_detail(_orders(s, d))


def _history(s: SparkSession, d: str, tracked: tuple[str, ...] = dims.TRACKED_5) -> DataFrame:
    return dims.scd2_full(_snapshots(s, d), "product_id", "snapshot_date", tracked)


@query
def order_detail(s: SparkSession, d: str) -> DataFrame:
    return _days(_detail(s, d))


@query
def ods_replay_counters(s: SparkSession, d: str) -> DataFrame:
    """Per load: rows, rows without user, negative amounts, distinct orders."""
    o = _orders(s, d)
    return _days(o.groupBy("dt").agg(F.count("*").alias("raw"), F.count_if(F.col("user_id").isNull()).alias("null_user"), F.count_if(F.col("amount") < 0).alias("negative"), F.count_distinct("order_id").alias("orders")))


@query
def ods_event_dedup(s: SparkSession, d: str) -> DataFrame:
    return _days(facts.first_events(_events(s, d)))


@query
def event_dup_ratio(s: SparkSession, d: str) -> DataFrame:
    """Rows per distinct (order, event type), per batch."""
    e = _events(s, d).filter("order_id IS NOT NULL AND event_type IS NOT NULL")
    per = e.groupBy("dt").agg(F.count("*").alias("n"), F.count_distinct("order_id", "event_type").alias("k"))
    return _days(per.select("dt", F.round(F.col("n") / F.col("k"), 6).alias("ratio")))


@query
def product_scd1_latest(s: SparkSession, d: str) -> DataFrame:
    return _days(dims.scd1_latest(_snapshots(s, d)).drop("update_time"))


def _history_out(h: DataFrame) -> DataFrame:
    return _days(h.select("product_id", "valid_from", "valid_to", F.col("is_current").cast("bigint").alias("is_current"), "product_name", "category", "brand", "price", "status"))


@query
def product_scd2_full3(s: SparkSession, d: str) -> DataFrame:
    return _history_out(_history(s, d, dims.TRACKED_3))


@query
def product_scd2_full5(s: SparkSession, d: str) -> DataFrame:
    return _history_out(_history(s, d))


@query
def product_scd2_incremental(s: SparkSession, d: str) -> DataFrame:
    """History up to a day, then all later snapshots applied at once."""
    snapshots = _snapshots(s, d)
    first = dims.scd2_full(snapshots.filter(F.col("snapshot_date") < F.lit(CUT).cast("date")), "product_id", "snapshot_date", dims.TRACKED_5)
    later = snapshots.filter(F.col("snapshot_date") >= F.lit(CUT).cast("date"))
    return _history_out(dims.scd2_incremental(first, later, "product_id", "snapshot_date", dims.TRACKED_5))


@query
def product_current_from_scd2(s: SparkSession, d: str) -> DataFrame:
    return _days(dims.current_from_scd2(_history(s, d)).drop("update_time"))


@query
def version_counts(s: SparkSession, d: str) -> DataFrame:
    """Products with more than one version."""
    return _history(s, d).groupBy("product_id").agg(F.count("*").alias("versions")).filter("versions > 1")


@query
def snapshot_change_count(s: SparkSession, d: str) -> DataFrame:
    """Products in both of two consecutive snapshots whose price differs, per snapshot: a window instead of a self join."""
    rows = dims.latest_per(_snapshots(s, d).filter("product_id IS NOT NULL"), ["product_id", "snapshot_date"], ["update_time"])
    days = rows.select("snapshot_date").distinct().withColumn("before", F.lag("snapshot_date").over(Window.orderBy("snapshot_date")))
    w = Window.partitionBy("product_id").orderBy("snapshot_date")
    seen = rows.select("snapshot_date", "price", F.lag("snapshot_date").over(w).alias("last"), F.lag("price").over(w).alias("old")).join(days, "snapshot_date")
    return _days(seen.filter(F.col("last") == F.col("before")).groupBy("snapshot_date").agg(F.count_if(~F.col("price").eqNullSafe(F.col("old"))).alias("changed")))


def _sku(s: SparkSession, d: str, how: str) -> DataFrame:
    return facts.version_at(_detail(s, d), _history(s, d), how=how)


@query
def order_sku_asof_left(s: SparkSession, d: str) -> DataFrame:
    return _days(_sku(s, d, "left"))


@query
def order_sku_asof_inner(s: SparkSession, d: str) -> DataFrame:
    return _days(_sku(s, d, "inner"))


@query
def order_sku_orphans(s: SparkSession, d: str) -> DataFrame:
    return _days(facts.orphans(_detail(s, d), _history(s, d)))


@query
def order_sku_unmatched(s: SparkSession, d: str) -> DataFrame:
    """Unmatched rows of the left join, per day."""
    return _days(_sku(s, d, "left").filter("valid_from IS NULL").groupBy("dt").agg(F.count("*").alias("unmatched")))


@query
def order_lifecycle(s: SparkSession, d: str) -> DataFrame:
    return facts.lifecycle(_events(s, d), update_time=AS_OF)


@query
def order_lifecycle_incremental(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    return facts.lifecycle(e, facts.scope_orders(e, *SCOPE), AS_OF)


@query
def order_lifecycle_expected(s: SparkSession, d: str) -> DataFrame:
    return facts.expected_lifecycle(_events(s, d))


@query
def lifecycle_stage_distribution(s: SparkSession, d: str) -> DataFrame:
    return facts.lifecycle(_events(s, d)).groupBy("current_stage").agg(F.count("*").alias("orders"))


@query
def lifecycle_lags(s: SparkSession, d: str) -> DataFrame:
    """Lags per stage: how many are known, least and most."""
    l = facts.lifecycle(_events(s, d))  # noqa: E741
    aggs = [f(c).alias(f"{n}_{c}") for c in ("pay_lag_hours", "ship_lag_days", "finish_lag_days") for n, f in (("n", F.count), ("min", F.min), ("max", F.max))]
    return l.groupBy("current_stage").agg(*aggs)


@query
def dws_user_order_day(s: SparkSession, d: str) -> DataFrame:
    return _days(facts.user_order_day(_detail(s, d)))


@query
def ads_daily_sales(s: SparkSession, d: str) -> DataFrame:
    return _days(facts.daily_sales(facts.user_order_day(_detail(s, d))))


@query
def category_day_sales(s: SparkSession, d: str) -> DataFrame:
    return _days(facts.category_day(_sku(s, d, "left")))


@query
def top_category_days(s: SparkSession, d: str) -> DataFrame:
    """The twenty largest of category_day_sales."""
    return _days(facts.category_day(_sku(s, d, "left")).orderBy(F.desc("amount"), "dt", F.asc_nulls_last("category")).limit(20))


@query
def daily_threshold_70pct(s: SparkSession, d: str) -> DataFrame:
    """Per load, 0.7 times the mean rows of the seven days that end with it, cut to an integer."""
    per = _orders(s, d).groupBy("dt").agg(F.count("*").alias("n"))
    epoch = F.unix_date("dt")
    w = Window.orderBy(epoch).rangeBetween(-6, 0)  # over loads, not rows
    mean7 = F.floor((F.sum("n").over(w) * 7) / (F.count("*").over(w) * 10))
    return _days(per.select("dt", "n", mean7.cast("bigint").alias("least")))


@query
def ods_gate(s: SparkSession, d: str) -> DataFrame:
    """The six checks on the last load."""
    o = _orders(s, d)
    return checks.ods_gate(o, _events(s, d), o.agg(F.max("dt")).first()[0])


@query
def dim_checks(s: SparkSession, d: str) -> DataFrame:
    return checks.dim_checks(table(s, d, "dim_product_scd2"), _detail(s, d), table(s, d, "dwd_order_sku_detail"))


@query
def order_checks(s: SparkSession, d: str) -> DataFrame:
    return checks.order_checks(_orders(s, d), _detail(s, d), table(s, d, "dws_user_order_day"), table(s, d, "ads_daily_sales"))


def _held_lifecycle(s: SparkSession, d: str, go_on: bool) -> DataFrame:
    """A stored lifecycle: made of the batches before LIFE_CUT, and brought up to date by upserts of the orders that later batches touch, or not."""
    e = _events(s, d)
    held = LifecycleTable(s, new_path(s, "lifecycle"))
    held.rebuild(e.filter(F.col("dt") < F.lit(LIFE_CUT).cast("date")))
    if go_on:
        held.advance(e, LIFE_CUT, None)
    return held.read()


@query
def lifecycle_checks(s: SparkSession, d: str) -> DataFrame:
    """The lifecycle as it was stored step by step against its derivation from all events."""
    e = _events(s, d)
    return checks.lifecycle_checks(_held_lifecycle(s, d, True), facts.expected_lifecycle(e), e)


@query
def lifecycle_checks_behind(s: SparkSession, d: str) -> DataFrame:
    """The same for a stored lifecycle that wasn't brought up to date: what must come out does."""
    return checks.lifecycle_checks(_held_lifecycle(s, d, False), facts.expected_lifecycle(_events(s, d)))


@query
def recon_watermarks(s: SparkSession, d: str) -> DataFrame:
    days = {n: "dt" for n in ("ods_order", "ods_order_event", "dwd_order_sku_detail", "dws_user_order_day", "ads_daily_sales")}
    return recon.watermarks({n: (table(s, d, n), c) for n, c in days.items()} | {"ods_product": (_snapshots(s, d), "snapshot_date")})


def _raw_with_user(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).filter("user_id IS NOT NULL")


@query
def recon_closure_detail(s: SparkSession, d: str) -> DataFrame:
    """Days on which the detail, stored before LIFE_CUT, holds another number of rows than raw orders with a user came: repeated ones and days that weren't built come out."""
    held = VersionedTable(s, new_path(s, "detail"), "dt")
    held.append(_detail(s, d).filter(F.col("dt") < F.lit(LIFE_CUT).cast("date")))
    return _days(recon.closure(_raw_with_user(s, d), held.read()))


@query
def recon_closure_sku(s: SparkSession, d: str) -> DataFrame:
    """The same for the wide table as it is held."""
    return _days(recon.closure(_raw_with_user(s, d), table(s, d, "dwd_order_sku_detail")))


@query
def recon_closure_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """Per event day, distinct orders with an event against those of them that a lifecycle stored before LIFE_CUT holds."""
    e = _events(s, d).filter("order_id IS NOT NULL").select("dt", "order_id").distinct()
    return _days(recon.closure(e, e.join(_held_lifecycle(s, d, False).select("order_id"), "order_id", "left_semi")))


@query
def recon_bad_days_of_closure(s: SparkSession, d: str) -> DataFrame:
    """The ten first days on which raw orders and wide table don't close."""
    return _days(recon.closure(_raw_with_user(s, d), table(s, d, "dwd_order_sku_detail")).orderBy("dt").limit(10))


@query
def recon_symdiff_dws(s: SparkSession, d: str) -> DataFrame:
    ours = facts.user_order_day(_detail(s, d))
    return _days(recon.symmetric_difference(table(s, d, "dws_user_order_day").select(ours.columns), ours, ("stored", "recomputed")))


@query
def recon_symdiff_ads(s: SparkSession, d: str) -> DataFrame:
    ours = facts.daily_sales(table(s, d, "dws_user_order_day"))
    return _days(recon.symmetric_difference(table(s, d, "ads_daily_sales").select(ours.columns), ours, ("stored", "recomputed")))


@query
def recon_bad_days_topn(s: SparkSession, d: str) -> DataFrame:
    ours = facts.user_order_day(_detail(s, d))
    return _days(recon.worst_days(recon.symmetric_difference(table(s, d, "dws_user_order_day").select(ours.columns), ours)))


@query
def recon_date_holes(s: SparkSession, d: str) -> DataFrame:
    return recon.date_holes(table(s, d, "ads_daily_sales")).unionByName(recon.date_holes(_snapshots(s, d), "snapshot_date"))


@query
def rt_vs_batch_diff(s: SparkSession, d: str) -> DataFrame:
    """Net amounts of lake and warehouse on every day that either has."""
    wh = table(s, d, "ads_daily_sales_wh").groupBy("dt").agg(F.max(F.col("net_amount").cast("decimal(18,2)")).alias("net_amount"))
    return _days(recon.side_by_side(table(s, d, "ads_daily_sales").select("dt", "net_amount"), wh, "dt", "net_amount"))


@query
def table_stats(s: SparkSession, d: str) -> DataFrame:
    """Rows, amount and distinct orders of the cleaned orders."""
    return _detail(s, d).agg(F.count("*").alias("rows"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(18,2)").alias("amount"), F.count_distinct("order_id").alias("orders"))


@query
def fingerprint_product_chain(s: SparkSession, d: str) -> DataFrame:
    return checks.fingerprint({n: table(s, d, n) for n in ("ods_product", "dim_product_scd2", "dwd_order_sku_detail")} | {"dim_product": dims.current_from_scd2(table(s, d, "dim_product_scd2"))})


@query
def fingerprint_marts(s: SparkSession, d: str) -> DataFrame:
    """By a digest that other engines have too."""
    return checks.fingerprint({n: table(s, d, n) for n in ("ods_order", "ods_product", "dwd_order_sku_detail", "dws_user_order_day", "ads_daily_sales")}, digest="md5")


@query
def lineitem_dedup(s: SparkSession, d: str) -> DataFrame:
    """One row per order line: the latest shipment, of equal ones the largest in the other columns."""
    return dims.latest_per(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
