"""Queries p1 to p6 over the tables of a data directory, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import day
from ledgerloom.operators.asof import attributes_at
from ledgerloom.operators.copydiff import diff_copies
from ledgerloom.operators.history import HeldHistory, bits_for, history_from_snapshots
from ledgerloom.operators.profile import profile_loads
from ledgerloom.operators.snapdiff import snapshot_changes
from ledgerloom.plans.scratch import new_path
from ledgerloom.sources.tables import table
from ledgerloom.streaming.redelivery import NO_TIME, Deliveries, deliveries, one_copy, repeated

#: Attributes of a product whose change makes a new version.
TRACKED = ("product_name", "category", "brand", "price", "status")
USER_DAY = {"order_cnt": 0, "paid_cnt": 0, "paid_amount": 2, "refund_amount": 2}
SALES_DAY = {"order_cnt": 0, "paid_cnt": 0, "paid_amount": 2, "refund_amount": 2, "net_amount": 2, "avg_order_amount": 2, "pay_rate": 4}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the warehouse's copies of the two marts differ from the lake's."""
    parts = []
    for name, keys, fields in (("dws_user_order_day", ["user_id", "dt"], USER_DAY), ("ads_daily_sales", ["dt"], SALES_DAY)):
        diff = diff_copies(table(spark, sf_dir, name), table(spark, sf_dir, f"{name}_wh"), keys, fields, "only_in_lake", "only_in_wh")
        user = F.col("user_id") if "user_id" in keys else F.lit(0).cast("bigint")
        parts.append(diff.select(F.lit(name).alias("table_name"), user.alias("user_id"), day(F.col("dt")).alias("dt"), "diff"))
    return parts[0].unionByName(parts[1])


def order_patterns() -> dict[str, dict[str, Column]]:
    num, txt = F.col("num"), F.col("txt")
    return {
        "user_id": {"invalid_rate": ~num.between(1, 99_999_999)},
        "amount": {"negative_rate": num < 0, "over_rate": F.abs(num) >= 100_000, "share_200_up": F.abs(num) >= 200},
        "status": {"invalid_rate": ~txt.isin("paid", "refund", "cancel"), "refund_share": txt == "refund", "cancel_share": txt == "cancel"},
    }


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of every load of ods_order."""
    profile = profile_loads(table(spark, sf_dir, "ods_order"), "dt", ["user_id", "amount", "status"], order_patterns())
    return profile.select(day(F.col("dt")).alias("dt"), "column_name", "metric", F.round("value", 9).alias("value"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads and metrics of ods_order outside the baseline."""
    profile = profile_loads(table(spark, sf_dir, "ods_order"), "dt", ["user_id", "amount", "status"], order_patterns(), quantiles=())
    bounds = table(spark, sf_dir, "ods_order_baseline")
    outside = profile.join(bounds, ["column_name", "metric"]).filter((F.col("value") < F.col("low_bound")) | (F.col("value") > F.col("high_bound")))
    return outside.select(day(F.col("dt")).alias("dt"), "column_name", "metric").distinct()


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's history as the snapshots tell it."""
    history = history_from_snapshots(table(spark, sf_dir, "ods_product"), "product_id", "snapshot_date", "update_time", TRACKED)
    return history.select("product_id", day(F.col("valid_from")).alias("valid_from"), day(F.col("valid_to")).alias("valid_to"), F.col("is_current").cast("bigint").alias("is_current"), *TRACKED)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that only the snapshots' history or only dim_product_scd2 has."""
    dates = [F.coalesce(day(F.col(c)), F.lit("")).alias(c) for c in ("valid_from", "valid_to")]
    version = ["product_id", *dates, F.coalesce(F.col("is_current"), F.lit(-1)).cast("bigint").alias("is_current")]
    right = history_from_snapshots(table(spark, sf_dir, "ods_product"), "product_id", "snapshot_date", "update_time", TRACKED).select(*version, F.lit(1).alias("side"))
    held = table(spark, sf_dir, "dim_product_scd2").select(*version, F.lit(2).alias("side"))
    keys = ["product_id", "valid_from", "valid_to", "is_current"]
    sides = right.unionByName(held).groupBy(*keys).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi")
    return sides.select(*keys, F.when(F.col("lo") == 1, "snapshots").otherwise("dim").alias("side"))


def p3_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history, held and grown: from the snapshots of the first half of the days, then from all others at once, then with one day of the first half delivered again."""
    rows = table(spark, sf_dir, "ods_product").select("product_id", "snapshot_date", "update_time", *TRACKED)
    days = [r[0] for r in rows.select("snapshot_date").filter("snapshot_date IS NOT NULL").distinct().orderBy("snapshot_date").collect()]
    held = HeldHistory(spark, new_path(spark, "history"), "product_id", "snapshot_date", "update_time", TRACKED, leaf_bits=bits_for(rows.agg(F.approx_count_distinct("product_id")).first()[0]))
    half = len(days) // 2
    # The day that comes again later is told at first without its prices.
    spoiled = rows.withColumn("price", F.when(F.col("snapshot_date") != F.lit(str(days[half // 2])).cast("date"), F.col("price"))) if days else rows
    held.add(spoiled, days[:half])
    held.add(spoiled, days[half:])
    held.add(rows, days[half // 2 : half // 2 + 1])
    return held.read().select("product_id", day(F.col("valid_from")).alias("valid_from"), day(F.col("valid_to")).alias("valid_to"), F.col("is_current").cast("bigint").alias("is_current"), *TRACKED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products added, removed and changed from each delivered snapshot to the next."""
    changes = snapshot_changes(table(spark, sf_dir, "ods_product"), "product_id", "snapshot_date", "update_time", TRACKED)
    return changes.select("product_id", day(F.col("snapshot_date")).alias("snapshot_date"), "change_type")


def _sku_with_history(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    detail = table(spark, sf_dir, "dwd_order_sku_detail").select("order_id", "dt", "product_id", *columns)
    versions = table(spark, sf_dir, "dim_product_scd2").withColumnsRenamed({"category": "right_category", "price": "right_price"})
    return attributes_at(detail, versions, "product_id", "dt", ["right_category", "right_price"], precedence=["update_time"])


def p5_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the category and price its product had on the order's day."""
    return _sku_with_history(spark, sf_dir, []).select("order_id", day(F.col("dt")).alias("dt"), "product_id", "right_category", "right_price")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that carry another category or price than their product had on the order's day."""
    rows = _sku_with_history(spark, sf_dir, ["category", "sku_price"])
    return rows.filter(~(F.col("category").eqNullSafe(F.col("right_category")) & F.col("sku_price").eqNullSafe(F.col("right_price")))).select("order_id")


#: Input of one micro-batch of the event stream, if the table has more than one file; a file isn't split.
BATCH_BYTES = 64 << 20
MESSAGE = ("order_id", "event_type")


def _with_identifier(events: DataFrame) -> DataFrame:
    """Messages with an identifier, event types in one spelling."""
    return events.withColumn("event_type", F.lower(F.trim("event_type"))).filter("order_id IS NOT NULL AND event_type IS NOT NULL")


def event_deliveries(spark: SparkSession, sf_dir: str, payload: Column | None = None, batch_bytes: int = BATCH_BYTES) -> Deliveries:
    """ods_order_event as a stream of files in the order in which they were written."""
    batch = table(spark, sf_dir, "ods_order_event")
    path = f"{sf_dir}/ods_order_event[.]parquet"  # a pattern, so that it may be a single file
    stream = spark.readStream.schema(batch.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
    return deliveries(_with_identifier(stream), _with_identifier(batch), MESSAGE, "event_time", payload)


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each order and event type: the earliest, of equally early ones the one with the smallest other values, nulls first."""
    kinds = {"user_id": "bigint", "product_id": "bigint", "amount": "decimal(10,2)", "order_time": "timestamp_ntz", "dt": "date"}
    # As text that sorts as the values do: numbers padded, a mark before what isn't null.
    padded = {"bigint": lambda c: F.lpad(c.cast("string"), 20, "0"), "decimal(10,2)": lambda c: F.lpad((c * 100 + 10**11).cast("decimal(14,0)").cast("string"), 20, "0")}
    each = [F.coalesce(F.concat(F.lit("1"), padded.get(k, lambda c: c.cast("string"))(F.col(c))), F.lit("0")) for c, k in kinds.items()]
    values = F.to_json(F.struct(*kinds))
    kept = one_copy(event_deliveries(spark, sf_dir, F.concat_ws("\t", *each, values)))
    parsed = F.from_json(F.element_at(F.split("p", "\t"), -1), ", ".join(f"{c} {k}" for c, k in kinds.items()))
    time = F.when(F.col("t") > NO_TIME, F.timestamp_micros("t").cast("timestamp_ntz"))
    return kept.select(*MESSAGE, time.alias("event_time"), parsed.alias("m"), "copies").select(*MESSAGE, "event_time", "m.*", "copies")


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies of each message came."""
    return one_copy(event_deliveries(spark, sf_dir)).select(*MESSAGE, "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that were delivered on more than one row."""
    return repeated(event_deliveries(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_profile, p3_found, p3_history, p3_appended, p4_found, p5_found, p5_attributes, p6_found, p6_copies, p6_messages)}
