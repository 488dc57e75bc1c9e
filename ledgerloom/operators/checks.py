"""Data quality gates. Each returns rows (check_name, violations) or one row per check; a clean table has 0 violations everywhere."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import OPEN_END, differs
from ledgerloom.operators.copydiff import diff_copies
from ledgerloom.operators.facts import EVENTS, daily_sales, orphans, user_order_day, version_at


def _named(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def united(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ods_gate(orders: DataFrame, events: DataFrame, day: dt.date, floor: float = 0.7, most_copies: float = 1.10) -> DataFrame:
    """(check_id, check_name, ok, value): six checks on the raw tables for a day and the seven days that end with it.

    c1 both tables have rows that day; c2 its orders are at least `floor` of the mean of the seven days; c3 order_id is unique that day (value: surplus rows);
    c4 event types outside the enumeration, null included; c5 rows per distinct message, 99 without rows; c6 distinct days of the seven.
    """
    since = F.lit(str(day - dt.timedelta(days=6))).cast("date")
    today = F.lit(str(day)).cast("date")
    week = orders.filter(F.col("dt").between(since, today))
    per_day = week.groupBy("dt").agg(F.count("*").alias("n"), F.count_distinct("order_id").alias("ids"), F.count("order_id").alias("known"))
    o = per_day.agg(F.coalesce(F.sum(F.when(F.col("dt") == today, F.col("n"))), F.lit(0)).alias("n"), F.avg("n").alias("mean"), F.coalesce(F.sum(F.when(F.col("dt") == today, F.col("known") - F.col("ids"))), F.lit(0)).alias("surplus"), F.count("*").alias("days"))
    kind = F.col("event_type")
    e = events.filter(F.col("dt") == today).agg(F.count("*").alias("events"), F.count_if(~F.coalesce(kind.isin(*EVENTS), F.lit(False))).alias("bad"), F.count_distinct(F.struct(F.coalesce("order_id", F.lit(-1)), F.coalesce(kind, F.lit("")))).alias("messages"))
    both = o.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one")  # one row each
    ratio = F.when(F.col("messages") > 0, F.col("events") / F.col("messages")).otherwise(99.0)
    share = F.coalesce(F.col("n") / F.nullif("mean", F.lit(0.0)), F.lit(0.0))
    rows = [
        ("c1", "day has rows", (F.col("n") > 0) & (F.col("events") > 0), F.least("n", "events")), ("c2", "volume", share >= floor, share), ("c3", "order_id unique", F.col("surplus") == 0, F.col("surplus")),
        ("c4", "event types", F.col("bad") == 0, F.col("bad")), ("c5", "copies", ratio <= most_copies, ratio), ("c6", "seven days", F.col("days") == 7, F.col("days")),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(n).alias("check_name"), ok.alias("ok"), F.round(v.cast("double"), 6).alias("value")) for i, n, ok, v in rows])
    return both.select(F.inline(each))


def history_checks(history: DataFrame) -> DataFrame:
    """(check_name, violations) of a type-2 dimension by itself: products without exactly one current version; gaps, overlaps and versions after an open end; current flags that don't agree with the open end."""
    open_end = F.lit(OPEN_END).cast("date")
    per = history.groupBy("product_id").agg(F.sum("is_current").alias("current"))
    following = F.lead("valid_from").over(Window.partitionBy("product_id").orderBy("valid_from"))
    gaps = history.select("valid_to", following.alias("following")).filter(F.col("following").isNotNull() & ((F.col("valid_to") == open_end) | (F.date_add("valid_to", 1) != F.col("following"))))
    flags = history.filter(differs(F.col("is_current") == 1, F.col("valid_to") == open_end))
    return united([_named(per, "one current version", F.count_if(differs(F.col("current"), F.lit(1)))), _named(gaps, "continuous versions", F.count("*")), _named(flags, "current means open", F.count("*"))])


def dim_checks(history: DataFrame, detail: DataFrame, sku: DataFrame) -> DataFrame:
    """(check_name, violations) of a type-2 dimension (history_checks) and the wide table made from it: row counts and amounts of detail and wide table; attributes other than those valid, or attached where none is valid."""
    sides = detail.select(F.lit(1).alias("side"), "amount").unionByName(sku.select(F.lit(-1).alias("side"), "amount"))
    counts = sides.agg(F.sum("side").alias("rows"), F.coalesce(F.sum(F.col("side") * F.col("amount")), F.lit(0)).alias("amount"))
    with_right = version_at(sku.select("product_id", "dt", F.col("category").alias("has_category"), F.col("brand").alias("has_brand"), F.col("sku_price").alias("has_price")), history)
    wrong = with_right.filter(differs(F.col("has_category"), F.col("category")) | differs(F.col("has_brand"), F.col("brand")) | differs(F.col("has_price"), F.col("sku_price")))
    return united([
        history_checks(history), _named(counts, "wide table rows", F.sum(F.abs("rows"))), _named(counts, "wide table amount", F.count_if(F.abs("amount") > 0.01)),
        _named(wrong, "wide table attributes", F.count("*")), _named(orphans(sku, history), "no valid version", F.count("*")),
    ])


def order_checks(orders: DataFrame, detail: DataFrame, dws: DataFrame, ads: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """(check_name, violations) of the chain from raw orders to the day mart: keys and cells of dws that differ from detail aggregated anew; days of detail without dws; days and cells of ads that
    differ from dws summed; derived columns of ads that don't follow from its sums, null-safe; days with more detail than raw orders; days of detail without raw orders."""
    days = lambda df: df.select("dt").distinct() if as_of is None else df.filter(F.col("dt") <= F.lit(str(as_of)).cast("date")).select("dt").distinct()
    atoms = {"order_cnt": 0, "paid_cnt": 0, "paid_amount": 2, "refund_amount": 2}
    remade = daily_sales(ads.select("dt", *atoms))
    derived = ads.join(remade.select("dt", *[F.col(c).alias(f"r_{c}") for c in ("net_amount", "avg_order_amount", "pay_rate")]), "dt")
    off = derived.filter(differs(F.col("net_amount"), F.col("r_net_amount")) | differs(F.col("avg_order_amount"), F.col("r_avg_order_amount")) | differs(F.col("pay_rate"), F.col("r_pay_rate")) | (F.col("paid_cnt") > F.col("order_cnt")))
    n = lambda df, name: df.groupBy("dt").agg(F.count("*").alias(name))
    more = n(detail, "d").join(n(orders, "o"), "dt").filter("d > o")
    return united([
        _named(diff_copies(dws, user_order_day(detail), ["user_id", "dt"], atoms), "dws is detail aggregated", F.count("*")), _named(days(detail).join(days(dws), "dt", "left_anti"), "dws covers detail", F.count("*")),
        _named(diff_copies(ads.select("dt", *atoms), daily_sales(dws).select("dt", *atoms), ["dt"], atoms), "ads is dws summed", F.count("*")), _named(off, "derived columns", F.count("*")),
        _named(more, "detail within raw orders", F.count("*")), _named(days(detail).join(days(orders), "dt", "left_anti"), "raw orders cover detail", F.count("*")),
    ])


def lifecycle_checks(snapshot: DataFrame, expected: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(check_name, violations) of the accumulating snapshot, as it is stored, against its derivation (without update_time): whole rows that differ, both ways and with repetitions; rows more or
    fewer than expected; repeated orders; orders without a start; a lag without its milestones or the reverse; no stage. With `events`: their rows beyond one per (order_id, event_type)."""
    cols = [c for c in expected.columns if c != "update_time"]
    lag = lambda l, a, b: differs(F.col(l).isNotNull(), F.col(a).isNotNull() & F.col(b).isNotNull())  # noqa: E731, E741
    bad_lag = lag("pay_lag_hours", "order_time", "pay_time") | lag("ship_lag_days", "order_time", "ship_time") | lag("finish_lag_days", "order_time", "finish_time")
    signed = snapshot.select(*cols, F.lit(1).alias("sign")).unionByName(expected.select(*cols, F.lit(-1).alias("sign")))
    # One shuffle tells both sides' surplus.
    net = signed.groupBy(*cols).agg(F.sum("sign").alias("net"))
    sizes = signed.groupBy("sign").count().agg(F.abs(F.sum(F.col("sign") * F.col("count"))).alias("n"))
    parts = [
        _named(net, "surplus rows", F.sum(F.greatest(F.col("net"), F.lit(0)))), _named(net, "missing rows", F.sum(F.greatest(-F.col("net"), F.lit(0)))), _named(sizes, "row count", F.max("n")),
        _named(snapshot, "order unique", F.count("*") - F.count_distinct("order_id")), _named(snapshot, "start known", F.count_if(F.col("order_time").isNull())),
        _named(snapshot, "lags follow milestones", F.count_if(bad_lag)), _named(snapshot, "stage known", F.count_if(F.col("current_stage").isNull())),
    ]
    if events is not None:
        pairs = events.groupBy("order_id", "event_type").agg(F.count("*").alias("n"))
        parts.append(_named(pairs, "events unique", F.sum(F.col("n") - 1)))
    return united(parts)


def fingerprint(tables: dict[str, DataFrame], separator: str = "|", digest: str = "crc32") -> DataFrame:
    """(table_name, rows, checksum): independent of row order; nulls are marked, so that no two rows of different values read the same. digest: crc32, or md5, of which the first 48 bits count.

    The checksum is the rows' sum; of a sum that doesn't fit a bigint (of md5 beyond some 65,000 rows) the last 63 bits.
    """
    each = {"crc32": F.crc32, "md5": lambda t: F.conv(F.substring(F.md5(t), 1, 12), 16, 10).cast("bigint")}[digest]
    parts = []
    for name, df in tables.items():
        text = F.concat_ws(separator, *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in df.columns])
        # Upper bits and the last 24 are summed apart, neither of which overflows, and the carry goes up.
        halves = df.select(each(text).alias("h")).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("high", F.shiftright("h", 24)), ("low", F.col("h").bitwiseAND(F.lit((1 << 24) - 1))))])
        high = (F.col("high") + F.shiftright("low", 24)).bitwiseAND(F.lit((1 << 39) - 1))
        parts.append(halves.select(F.lit(name).alias("table_name"), "rows", F.shiftleft(high, 24).bitwiseOR(F.col("low").bitwiseAND(F.lit((1 << 24) - 1))).alias("checksum")))
    return united(parts)


def stream_health(progress: Mapping[str, object] | None, messages: DataFrame, identifier: Sequence[str], most_copies: float = 1.20, lag: int = 0, most_lag: int | None = None) -> dict[str, object]:
    """What a stream's last progress and its target table say: rows taken in the last batch, watermark, surplus rows per message, the messages that wait (`lag`, from json_topic.lag), and whether all is well. No progress yet isn't well."""
    n = messages.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*identifier)).alias("k")).first()
    ratio = n["n"] / n["k"] if n["k"] else 99.0
    taken = int(progress["numInputRows"]) if progress else -1
    return {"taken": taken, "watermark": (progress or {}).get("eventTime", {}).get("watermark"), "copies": ratio, "lag": lag, "ok": progress is not None and ratio <= most_copies and (most_lag is None or lag <= most_lag)}


def realtime_checks(live: DataFrame, batch: DataFrame, day: dt.date, allow_lag: int = 0, low: float = 0.7, high: float = 1.5) -> DataFrame:
    """(check_name, violations) of a live table against the batch table: its last day lags more than allowed; the day's rows are outside low..high of the mean of the seven days before in batch; days of both with other counts."""
    today = F.lit(str(day)).cast("date")
    late = live.agg(F.max("dt").alias("last"))
    week = batch.filter(F.col("dt").between(F.date_sub(today, 7), F.date_sub(today, 1))).groupBy("dt").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean"))
    seen = live.filter(F.col("dt") == today).agg(F.count("*").alias("n"))
    both = week.withColumn("one", F.lit(1)).join(seen.withColumn("one", F.lit(1)), "one")  # one row each
    counts = lambda df, sign: df.filter(F.col("dt") < today).groupBy("dt").agg((F.count("*") * sign).alias("n"))
    common = counts(live, 1).unionByName(counts(batch, -1)).groupBy("dt").agg(F.sum("n").alias("net"), F.count("*").alias("sides")).filter("sides = 2 AND net <> 0")
    return united([
        _named(late, "live table is fresh", F.sum(F.when(F.coalesce(F.datediff(today, "last"), F.lit(9999)) > allow_lag, 1).otherwise(0))),
        _named(both, "live volume", F.sum(F.when(F.col("n").between(low * F.col("mean"), high * F.col("mean")), 0).otherwise(1))), _named(common, "live equals batch", F.count("*")),
    ])
