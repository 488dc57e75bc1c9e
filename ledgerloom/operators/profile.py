"""Data quality profile of every load of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.exprs import fresh
from ledgerloom.operators.prefix import range_sorted, running_sums
from ledgerloom.plans.joins import small

#: A pattern is given over these two columns: a value as a number (null for text) and as text.
NUM, TXT = "num", "txt"


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("decimal(38,10)")
    if isinstance(kind, T.NumericType):
        return F.expr(f"try_cast(`{name}` AS DECIMAL(38,10))")
    if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return F.unix_micros(c.cast("timestamp")).cast("decimal(38,10)")
    return F.lit(None).cast("decimal(38,10)")


def profile_loads(df: DataFrame, load: str, columns: Sequence[str], patterns: Mapping[str, Mapping[str, Column]] | None = None, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(load, column_name, metric, value double): the profile of each named column in each load, all exact.

    Metrics: rows, null_rate (nulls / rows), distinct and distinct_rate, top_share (rows of the most frequent value), min, max and
    q<p> (the smallest value that at least a share p of the values doesn't exceed; numbers only), ks (Kolmogorov-Smirnov
    distance to the load before) and each of `patterns[column]`: rows whose value meets the condition over `num` and `txt`.
    All but rows, null_rate, distinct, min, max, quantiles and ks are divided by the non-null values of the column in the load.

    Values are unpivoted and counted before they move, so a value that a third of the rows holds is one row per task. The counts, each once for its
    load and once as the past of the next load, are range-sorted by column, pair of loads and value; prefix counts per partition
    give every value's exact rank, from it quantiles and distincts, and the two cumulative curves of a pair, whose greatest
    distance is ks. No group is ever held in one task.

    Loads are ordered by `load`; a null load is a load and comes first. A column without non-null values in a load has rows, null_rate 1 and distinct 0 only;
    the divided metrics and ks are null there and left out, ks too where the load before has none. Numbers are compared to ten decimals, other values as text;
    NaN and numbers that a decimal can't hold are text. Equal values are one value. An empty table has no rows in the result.
    """
    patterns = patterns or {}
    each = [F.struct(F.lit(i).alias("c"), _number(df, n).alias(NUM), F.col(f"`{n}`").cast("string").alias("t")) for i, n in enumerate(columns)]
    flat = df.select(F.col(f"`{load}`").alias("load"), F.explode(F.array(*each)).alias("x")).select("load", "x.c", f"x.{NUM}", F.when(F.col(f"x.{NUM}").isNull(), F.col("x.t")).alias(TXT))
    value = F.col(NUM).isNotNull() | F.col(TXT).isNotNull()
    order = Window.orderBy(F.col("load").asc_nulls_first())  # over distinct loads only
    loads = small(df.select(F.col(f"`{load}`").alias("load")).distinct().select("load", F.row_number().over(order).alias("i")))

    # A pair i is load i (now) with load i - 1 (past): each value counts for its own pair and as the past of the next.
    sides = F.array(F.struct(F.lit(0).alias("ahead"), F.lit(1).alias("now"), F.lit(0).alias("past")), F.struct(F.lit(1).alias("ahead"), F.lit(0).alias("now"), F.lit(1).alias("past")))
    both = flat.join(loads, flat["load"].eqNullSafe(loads["load"])).withColumn("side", F.explode(sides)).select("c", (F.col("i") + F.col("side.ahead")).alias("pair"), NUM, TXT, "side.now", "side.past")
    counts = both.groupBy("c", "pair", NUM, TXT).agg(F.sum("now").alias("now"), F.sum("past").alias("past"))
    counts = counts.withColumns({"vnow": F.when(value, F.col("now")).otherwise(0), "vpast": F.when(value, F.col("past")).otherwise(0)})
    # No more distinct values than twice the cells.
    ranged = range_sorted(counts, ["c", "pair", NUM, TXT], rows=2 * len(columns) * df.count())
    curves = running_sums(ranged, ["c", "pair"], ["vnow", "vpast"]).withColumnsRenamed({"vnow_run": "rn", "vpast_run": "rp"})
    totals = ranged.groupBy("c", "pair").agg(F.sum("vnow").alias("all_now"), F.sum("vpast").alias("all_past"), F.sum("now").alias("rows"))
    per_value = curves.join(small(totals), ["c", "pair"])
    now = F.col("now") > 0
    share = lambda run, n: F.when(F.col(n) > 0, F.col(run) / F.col(n))
    qs = {f"q{q:g}": q for q in quantiles}
    stats = per_value.groupBy("c", "pair").agg(
        F.first("rows").alias("rows"),
        F.first("all_now").alias("values"),
        F.count_if(now & value).alias("distinct"),
        F.max(F.when(value, F.col("now"))).alias("top"),
        F.min(F.when(now, F.col(NUM))).cast("double").alias("min"),
        F.max(F.when(now, F.col(NUM))).cast("double").alias("max"),
        F.max(F.when(value & (F.col("all_past") > 0) & (F.col("all_now") > 0), F.abs(share("rn", "all_now") - share("rp", "all_past")))).alias("ks"),
        *[F.min(F.when(now & (F.col("rn") >= F.lit(q) * F.col("all_now")), F.col(NUM))).cast("double").alias(m) for m, q in qs.items()],
        *[F.sum(F.when((F.col("c") == i) & value & cond, F.col("now")).otherwise(0)).alias(f"{n}.{m}") for i, n in enumerate(columns) for m, cond in patterns.get(n, {}).items()],
    ).filter("rows > 0")

    ratio = lambda c: F.when(F.col("values") > 0, F.col(f"`{c}`") / F.col("values"))
    metric = lambda m, v: F.struct(F.lit(m).alias("m"), v.cast("double").alias("v"))
    rows = [
        metric("rows", F.col("rows")), metric("null_rate", (F.col("rows") - F.col("values")) / F.col("rows")), metric("distinct", F.col("distinct")),
        metric("distinct_rate", ratio("distinct")), metric("top_share", ratio("top")), metric("min", F.col("min")), metric("max", F.col("max")), metric("ks", F.col("ks")),
        *[metric(m, F.col(f"`{m}`")) for m in qs],
        *[F.when(F.col("c") == i, metric(m, ratio(f"{n}.{m}"))) for i, n in enumerate(columns) for m in patterns.get(n, {})],
    ]
    names = F.array(*[F.lit(n) for n in columns])
    long = stats.select("c", "pair", F.explode(F.array(*rows)).alias("x")).filter("x.v IS NOT NULL")
    return long.join(loads, long["pair"] == loads["i"]).select(F.col("load").alias(load), F.get(names, F.col("c")).alias(fresh([load], "column_name")), F.col("x.m").alias("metric"), F.col("x.v").alias("value"))
