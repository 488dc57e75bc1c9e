"""Queries over what is written and read back: versioned tables after each kind of change, sources, ranges of incremental runs, live tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import day
from ledgerloom.operators import checks, facts, incremental
from ledgerloom.operators.prefix import range_sorted, running_sums
from ledgerloom.plans.chain import LIFE_CUT as CUT
from ledgerloom.plans.scratch import new_path
from ledgerloom.sources import csv_snapshot, generators, json_topic, sinks
from ledgerloom.sources.tables import table
from ledgerloom.sources.versioned import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Constants of the queries below and of their SQL.
DAY, FROM, TO = "2024-03-04", "2024-03-03", "2024-03-06"
USER_DAY = ("user_id", "dt", "order_cnt", "paid_cnt", "paid_amount", "refund_amount")


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _days(df: DataFrame) -> DataFrame:
    return df.withColumns({c: day(F.col(c)) for c, t in df.dtypes if t == "date"})


def _date(text: str) -> F.Column:
    return F.lit(text).cast("date")


def _held(s: SparkSession, df: DataFrame, partition: str | None = "dt") -> VersionedTable:
    t = VersionedTable(s, new_path(s, "table"), partition)
    t.append(df)
    return t


def _lake(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dws_user_order_day").select(*USER_DAY)


def _wh(s: SparkSession, d: str) -> DataFrame:
    """The warehouse's copy, one row per key: the largest of each column."""
    money = lambda c: F.max(F.col(c).cast("decimal(18,2)")).alias(c)
    return table(s, d, "dws_user_order_day_wh").groupBy("user_id", "dt").agg(F.max("order_cnt").alias("order_cnt"), F.max("paid_cnt").alias("paid_cnt"), money("paid_amount"), money("refund_amount"))


@query
def table_upsert(s: SparkSession, d: str) -> DataFrame:
    """Rows of the warehouse put over those of the lake by key."""
    t = _held(s, _lake(s, d))
    t.upsert(_wh(s, d), ["user_id", "dt"])
    return _days(t.read())


@query
def table_delete_keys(s: SparkSession, d: str) -> DataFrame:
    """The lake's rows without users that have more than ten orders on some day."""
    t = _held(s, _lake(s, d))
    t.delete_keys(_lake(s, d).filter("order_cnt > 10").select("user_id"), ["user_id"])
    return _days(t.read())


@query
def table_delete_where(s: SparkSession, d: str) -> DataFrame:
    t = _held(s, _lake(s, d))
    t.delete_where((F.col("paid_cnt") == 0) & (F.col("dt") >= _date(FROM)))
    return _days(t.read())


@query
def table_range_overwrite(s: SparkSession, d: str) -> DataFrame:
    """A range of days taken from the warehouse: a day that it lacks is empty afterwards."""
    t = _held(s, _lake(s, d))
    days = [str(dt.date.fromisoformat(FROM) + i * incremental.DAY) for i in range((dt.date.fromisoformat(TO) - dt.date.fromisoformat(FROM)).days + 1)]
    t.overwrite_partitions(_wh(s, d).filter(F.col("dt").between(_date(FROM), _date(TO))).filter(F.col("dt") != _date(DAY)).select(*USER_DAY), days)
    return _days(t.read())


@query
def table_truncate_reload(s: SparkSession, d: str) -> DataFrame:
    t = _held(s, _lake(s, d))
    t.truncate()
    t.append(_wh(s, d).select(*USER_DAY))
    return _days(t.read())


@query
def table_replace_all(s: SparkSession, d: str) -> DataFrame:
    t = _held(s, _lake(s, d))
    t.replace_all(_wh(s, d).select(*USER_DAY))
    return _days(t.read())


@query
def table_update(s: SparkSession, d: str) -> DataFrame:
    """Open versions that began before CUT closed with the day before it."""
    cols = ("product_id", "valid_from", "valid_to", "is_current", "category", "price")
    t = _held(s, table(s, d, "dim_product_scd2").select(*cols), None)
    t.update_where((F.col("is_current") == 1) & (F.col("valid_from") < _date(CUT)), {"valid_to": F.date_sub(_date(CUT), 1), "is_current": F.lit(0)})
    return _days(t.read().withColumn("is_current", F.col("is_current").cast("bigint")))


@query
def table_drop_partitions(s: SparkSession, d: str) -> DataFrame:
    """Retention: days before FROM go without a file being read."""
    t = _held(s, _lake(s, d))
    t.drop_partitions(lambda v: v >= FROM)
    return _days(t.read())


@query
def table_time_travel(s: SparkSession, d: str) -> DataFrame:
    """The first version, read after three changes and a compaction."""
    t = _held(s, _lake(s, d))
    t.delete_where(F.col("order_cnt") > 1)
    t.upsert(_wh(s, d), ["user_id", "dt"])
    t.compact(min_files=1)
    return _days(t.read(1))


@query
def table_append_once(s: SparkSession, d: str) -> DataFrame:
    """A writer's batch appended twice under one number: it is there once."""
    t = _held(s, _lake(s, d).filter(F.col("dt") < _date(FROM)))
    for _ in range(2):
        t.append(_lake(s, d).filter(F.col("dt") >= _date(FROM)), ("writer", 7))
    return _days(t.read())


@query
def table_inventory(s: SparkSession, d: str) -> DataFrame:
    """Versions with operation, partitions and rows after an append, a deletion and a truncation."""
    t = _held(s, _lake(s, d))
    t.delete_where(F.col("dt") < _date(FROM))
    t.truncate()
    rows = [(v["version"], v["operation"], v["partitions"], v["rows"]) for v in t.snapshots()]
    return s.createDataFrame(rows, "version bigint, operation string, partitions bigint, rows bigint")


@query
def table_after_expiry(s: SparkSession, d: str) -> DataFrame:
    """Rows and amount of a table whose old versions and small files are gone."""
    t = _held(s, _lake(s, d).filter(F.col("dt") < _date(FROM)))
    t.append(_lake(s, d).filter(F.col("dt") >= _date(FROM)))
    t.delete_where(F.col("order_cnt") > 5)
    t.compact(min_files=1)
    t.expire(1, grace=dt.timedelta(0))
    return t.read().agg(F.count("*").alias("rows"), F.sum("paid_amount").cast("decimal(18,2)").alias("amount")).withColumn("versions", F.lit(len(t.versions())).cast("bigint"))


@query
def incremental_ranges(s: SparkSession, d: str) -> DataFrame:
    """(run, first, last): the days that incremental runs would build, from what source and target hold."""
    source, target = (incremental.bounds(table(s, d, n)) for n in ("ods_order", "dws_user_order_day"))
    cut = dt.date.fromisoformat(CUT)
    runs = {"empty target": incremental.resolve_range(None, *source), "behind": incremental.resolve_range(cut, *source), "behind, lookback 3": incremental.resolve_range(cut, *source, 3), "marts, lookback 3": incremental.mart_range((target[0], cut), source, 3)}
    return s.createDataFrame([(n, str(r[0]), str(r[1])) for n, r in runs.items() if r], "run string, first string, last string")


@query
def dry_run_days(s: SparkSession, d: str) -> DataFrame:
    """Rows of the snapshots on every day of their range, days that weren't delivered with 0."""
    return _days(incremental.day_rows(table(s, d, "ods_product"), *incremental.bounds(table(s, d, "ods_product"), "snapshot_date"), "snapshot_date"))


@query
def drift_before_range(s: SparkSession, d: str) -> DataFrame:
    """Rows of the stored user mart before a range that a fresh computation would change."""
    fresh = facts.user_order_day(facts.order_detail(table(s, d, "ods_order")))
    return _days(incremental.drift_outside(_lake(s, d), fresh.select(*USER_DAY), dt.date.fromisoformat(CUT)))


def _topic(s: SparkSession, df: DataFrame) -> str:
    """The rows as JSON messages, times as text, in a folder."""
    path = new_path(s, "topic")
    df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "timestamp_ntz"}).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


@query
def topic_orders_of_day(s: SparkSession, d: str) -> DataFrame:
    """All orders through messages and back; of these a day."""
    path = _topic(s, table(s, d, "ods_order").drop("dt"))
    return _days(json_topic.replay_orders(json_topic.read_topic(s, path, json_topic.ORDER), dt.date.fromisoformat(DAY)))


@query
def topic_events_replayed(s: SparkSession, d: str) -> DataFrame:
    """All events through messages and back, each once a day."""
    path = _topic(s, table(s, d, "ods_order_event").drop("dt"))
    return _days(json_topic.replay_events(json_topic.read_topic(s, path, json_topic.EVENT)))


@query
def topic_ingested_once(s: SparkSession, d: str) -> DataFrame:
    """Rows per day of a table that a stream filled from messages, started twice."""
    path, cp = _topic(s, table(s, d, "ods_order").drop("dt")), new_path(s, "ingest")
    t = VersionedTable(s, new_path(s, "table"), "dt")
    for _ in range(2):
        json_topic.ingest_stream(s, path, json_topic.ORDER, "order_time", t, cp, "ingest")
    return _days(t.read().groupBy("dt").agg(F.count("*").alias("rows"), F.sum("amount").cast("decimal(18,2)").alias("amount")))


@query
def csv_snapshots_loaded(s: SparkSession, d: str) -> DataFrame:
    """Every snapshot through a CSV file of its day and back, days from the files' names."""
    rows, path = table(s, d, "ods_product"), new_path(s, "csv")
    named = rows.filter("snapshot_date IS NOT NULL").withColumn("f", F.concat(F.lit("product_snapshot_"), F.date_format("snapshot_date", "yyyyMMdd"), F.lit(".csv"))).drop("snapshot_date")
    named.repartition("f").write.partitionBy("f").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    days = [r[0] for r in rows.select("snapshot_date").filter("snapshot_date IS NOT NULL").distinct().collect()]
    return _days(csv_snapshot.load_snapshots(s, [f"{path}/f=product_snapshot_{x:%Y%m%d}.csv" for x in sorted(days)]))


@query
def text_lines(s: SparkSession, d: str) -> DataFrame:
    """The day mart as lines of text."""
    return sinks.as_text(table(s, d, "ads_daily_sales"))


@query
def realtime_checks(s: SparkSession, d: str) -> DataFrame:
    """The wide table as a live table against the raw orders, on the last day of orders."""
    orders = table(s, d, "ods_order")
    return checks.realtime_checks(table(s, d, "dwd_order_sku_detail"), orders, incremental.bounds(orders)[1])


@query
def order_state(s: SparkSession, d: str) -> DataFrame:
    return generators.order_state(table(s, d, "ods_order_event"))


@query
def event_sequence(s: SparkSession, d: str) -> DataFrame:
    """Every message with its place in the order of event time, order and the other columns; places are counted over range partitions, not in one task."""
    cols = ["event_time", "order_id", "event_type", "user_id", "product_id", "amount", "order_time"]
    rows = table(s, d, "ods_order_event").select(*cols, F.lit(0).alias("all"), F.lit(1).cast("bigint").alias("one"))
    return running_sums(range_sorted(rows, ["all", *cols], rows=rows.count()), ["all"], ["one"]).select(*cols, F.col("one_run").alias("position"))
