import datetime as dt

import pytest

from ledgerloom.plans import chain
from tests.test_checks import ORDERS, day

PRODUCTS = "product_id bigint, product_name string, category string, brand string, price decimal(10,2), status string, update_time timestamp_ntz, snapshot_date date"
#: What each as-of query gives of the tables below, as rows.
ROWS = {"category_day_sales": 5, "order_sku_asof_inner": 7, "order_sku_orphans": 1, "top_category_days": 5, "order_sku_asof_left": 8, "order_sku_unmatched": 1}


@pytest.fixture
def folder(frame, tmp_path):
    """Product 1 changes its category on the third day, product 2 begins on the second; each has an order on each of four days."""
    noon = lambda n: dt.datetime.combine(day(n), dt.time(12))
    frame(PRODUCTS, [(p, "n", "a" if n < 2 else "b", "x", p, "on", noon(n), day(n)) for n in range(4) for p in (1, 2) if n >= p - 1]).write.parquet(f"{tmp_path}/ods_product.parquet")
    frame(ORDERS, [(10 * n + p, 1, p, 5, noon(n), "paid", day(n)) for n in range(4) for p in (1, 2)]).write.parquet(f"{tmp_path}/ods_order.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ROWS)
def test_as_of_queries_broadcast_nothing_by_estimates(spark, folder, name):
    """An exploded side is taken for as small as its file, so it was broadcast through the driver's memory whatever its rows."""
    got = chain.queries()[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Generate" not in plan
    assert got.count() == ROWS[name]


DAYS = [day(n).isoformat() for n in range(4)]
#: Columns and rows, in order, that each as-of query gives of the tables above.
FOUND = {
    "order_sku_asof_inner": (["order_id", "category"], [(1, "a"), (11, "a"), (12, "a"), (21, "b"), (22, "b"), (31, "b"), (32, "b")]),
    "order_sku_orphans": (["order_id", "product_id"], [(2, 2)]),
    "top_category_days": (["dt", "category", "orders", "CAST(amount AS int)"], [(DAYS[1], "a", 2, 10), (DAYS[2], "b", 2, 10), (DAYS[3], "b", 2, 10), (DAYS[0], "a", 1, 5), (DAYS[0], None, 1, 5)]),
    "order_sku_asof_left": (["order_id", "category"], [(1, "a"), (2, None), (11, "a"), (12, "a"), (21, "b"), (22, "b"), (31, "b"), (32, "b")]),
    "order_sku_unmatched": (["dt", "unmatched"], [(DAYS[0], 1)]),
}


@pytest.mark.parametrize("name", FOUND)
def test_as_of_queries_run_without_broadcasts_whatever_the_threshold(spark, folder, name):
    """At 60 times sf0.1 a side was taken for less than the default threshold of 10 MB, and its rows were more than the driver's heap holds. The plan that ran counts: adaptive execution may still turn joins into broadcasts."""
    columns, rows = FOUND[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = chain.queries()[name](spark, folder)
        got = got if name == "top_category_days" else got.orderBy(got.columns[0])
        got = got.selectExpr(*columns)
        assert [tuple(r) for r in got.collect()] == rows
        ran = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "isFinalPlan=true" in ran and "BroadcastExchange" not in ran
