"""Reconciliation between layers: freshness, closure of every day, whole-row differences, date holes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import day


def watermarks(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, rows, first_dt, last_dt) of each table, by its day column."""
    out = None
    for name, (df, c) in tables.items():
        one = df.agg(F.count("*").alias("rows"), day(F.min(c)).alias("first_dt"), day(F.max(c)).alias("last_dt")).select(F.lit(name).alias("table_name"), "rows", "first_dt", "last_dt")
        out = one if out is None else out.unionByName(one)
    return out


def closure(expected: DataFrame, actual: DataFrame, by: str = "dt") -> DataFrame:
    """(by, expected, actual): days on which two counts of rows differ, days that one side lacks included. Counts are united and summed, so each side is reduced before it moves."""
    both = expected.select(F.col(by), F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(F.col(by), F.lit(0).alias("e"), F.lit(1).alias("a")))
    return both.groupBy(by).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual")).filter("expected <> actual")


def symmetric_difference(left: DataFrame, right: DataFrame, tag: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(columns..., side, surplus): whole rows that one side holds more often than the other; a row that both hold equally often is no difference however often that is."""
    cols = left.columns
    both = left.select(*cols, F.lit(1).alias("sign")).unionByName(right.select(*cols, F.lit(-1).alias("sign")))
    net = both.groupBy(*cols).agg(F.sum("sign").alias("net")).filter("net <> 0")
    return net.select(*cols, F.when(F.col("net") > 0, tag[0]).otherwise(tag[1]).alias("side"), F.abs("net").cast("bigint").alias("surplus"))


def worst_days(differences: DataFrame, n: int = 10, by: str = "dt") -> DataFrame:
    """The n days with most differing rows."""
    return differences.groupBy(by).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), by).limit(n)


def date_holes(df: DataFrame, column: str = "dt") -> DataFrame:
    """(after, next, missing): gaps between the days that occur. One row per distinct day is ordered, not the table."""
    days = df.select(F.col(column).alias("d")).filter("d IS NOT NULL").distinct()
    gaps = days.select("d", F.lead("d").over(Window.orderBy("d")).alias("n"))
    return gaps.filter("datediff(n, d) > 1").select(day(F.col("d")).alias("after"), day(F.col("n")).alias("next"), (F.datediff("n", "d") - 1).cast("bigint").alias("missing"))


def side_by_side(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """(by, left, right, diff): a value of two sources on every day that either has; full outer join."""
    a, b = left.select(by, F.col(value).alias("left")), right.select(by, F.col(value).alias("right"))
    return a.join(b, by, "full").select(by, "left", "right", (F.coalesce("left", F.lit(0)) - F.coalesce("right", F.lit(0))).cast("decimal(18,2)").alias("diff"))


@dataclass(frozen=True)
class Check:
    """One line of a reconciliation."""

    name: str
    expected: str
    actual: str
    ok: bool


def reconcile(
    orders: DataFrame, detail: DataFrame, dws: DataFrame, ads: DataFrame, dws_copy: DataFrame | None = None, ads_copy: DataFrame | None = None, strict: bool = False, allow_lag: int = 0,
    fast: bool = False, sku: DataFrame | None = None, lifecycle: DataFrame | None = None, events: DataFrame | None = None, baseline: Mapping[str, int] | None = None,
) -> list[Check]:
    """All checks over the chain, each with what differs as a count; only counts and single days come to the driver.

    Closure of detail, and, if given, of the wide table and the lifecycle, with the raw tables by day (not with `fast`); whole-row differences to the copies; rows of the marts against those that detail asks for;
    freshness within `allow_lag` days; both marts end on one day; date holes, which only fail with `strict`; rows of tables against `baseline`, table name to rows.
    """
    zero = lambda name, df: Check(name, "0", str(n := df.count()), n == 0)
    equal = lambda name, a, b: Check(name, str(a), str(b), a == b)
    checks = []
    if not fast:
        distinct_orders = orders.filter("user_id IS NOT NULL").select("dt", "order_id").distinct()
        checks.append(zero("detail closes with raw orders", closure(distinct_orders, detail)))
        if sku is not None:
            checks.append(zero("wide table closes with raw orders", closure(distinct_orders, sku)))
        if lifecycle is not None and events is not None:
            touched = events.filter("order_id IS NOT NULL").select("dt", "order_id").distinct()
            checks.append(zero("lifecycle closes with events", closure(touched, touched.join(lifecycle.select("order_id"), "order_id", "left_semi"))))
    if dws_copy is not None:
        checks.append(zero("user days equal the copy", symmetric_difference(dws, dws_copy)))
    if ads_copy is not None:
        checks.append(zero("sales days equal the copy", symmetric_difference(ads, ads_copy)))
    checks.append(equal("rows of user days", detail.select("user_id", "dt").distinct().count(), dws.count()))
    checks.append(equal("rows of sales days", detail.select("dt").distinct().count(), ads.count()))
    last = {r["table_name"]: r["last_dt"] for r in watermarks({"detail": (detail, "dt"), "dws": (dws, "dt"), "ads": (ads, "dt")}).collect()}
    d = {k: dt.date.fromisoformat(v) if v else dt.date.min for k, v in last.items()}
    lag = (d["detail"] - d["dws"]).days
    checks.append(Check("user days are fresh", f"lag <= {allow_lag}", str(lag), lag <= allow_lag))
    checks.append(Check("both marts end on one day", str(last["dws"]), str(last["ads"]), last["dws"] == last["ads"]))
    holes = zero("no date holes", date_holes(ads))
    checks.append(holes if strict else Check(holes.name, holes.expected, holes.actual, True))
    held = {"orders": orders, "detail": detail, "dws": dws, "ads": ads}
    checks += [equal(f"baseline of {n}", rows, held[n].count()) for n, rows in (baseline or {}).items()]
    return checks


def summary(checks: Sequence[Check]) -> str:
    """One line for machines: RECON_RESULT|OK or BAD|checks|failed|names of the failed."""
    bad = [c.name for c in checks if not c.ok]
    return f"RECON_RESULT|{'BAD' if bad else 'OK'}|{len(checks)}|{len(bad)}|{','.join(bad)}"
