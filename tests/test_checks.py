import datetime as dt
import hashlib

import pytest

from ledgerloom.operators import checks, facts, incremental, recon

D = dt.date(2024, 1, 1)
END = dt.date(9999, 12, 31)
ORDERS = "order_id bigint, user_id bigint, product_id bigint, amount decimal(10,2), order_time timestamp_ntz, status string, dt date"
EVENTS = "order_id bigint, user_id bigint, product_id bigint, amount decimal(10,2), order_time timestamp_ntz, event_type string, event_time timestamp_ntz, dt date"
HISTORY = "product_id bigint, valid_from date, valid_to date, is_current int, product_name string, category string, brand string, price decimal(10,2), status string"
SKU = "order_id bigint, dt date, product_id bigint, amount decimal(10,2), category string, brand string, sku_price decimal(10,2)"
ADS = "dt date, order_cnt bigint, paid_cnt bigint, paid_amount decimal(18,2), refund_amount decimal(18,2), net_amount decimal(18,2), avg_order_amount decimal(18,2), pay_rate decimal(10,4)"
DWS = "user_id bigint, dt date, order_cnt bigint, paid_cnt bigint, paid_amount decimal(18,2), refund_amount decimal(18,2)"


def day(n):
    return D + dt.timedelta(days=n)


def version(p, a, b, current=0, category="c"):
    return (p, a, b, current, "n", category, "b", 1, "on")


def counted(df):
    return {r["check_name"]: r["violations"] for r in df.collect()}


def dim(frame, history, sku=(), detail=None):
    detail = sku if detail is None else detail
    return counted(checks.dim_checks(frame(HISTORY, history), frame(SKU, detail), frame(SKU, sku)))


@pytest.mark.parametrize(
    ("history", "name", "bad"),
    [
        ([version(1, D, END, 1), version(2, D, END, 1)], "one current version", 0),
        ([version(1, D, day(3), 1), version(1, day(4), END, 1), version(2, D, END, 1)], "one current version", 1),
        ([version(1, D, day(3), 0), version(2, D, END, 1)], "one current version", 1),
        ([version(1, D, END, 1), version(1, day(1), END, 1), version(2, D, day(1), 0)], "one current version", 2),
        ([version(1, D, day(3)), version(1, day(4), END, 1)], "continuous versions", 0),
        ([version(1, D, END), version(1, day(4), END, 1)], "continuous versions", 1),
        ([version(1, D, day(2)), version(1, day(4), END, 1)], "continuous versions", 1),
        ([version(1, D, day(5)), version(1, day(4), END, 1)], "continuous versions", 1),
        ([version(1, D, END, 1)], "current means open", 0),
        ([version(1, D, day(3), 1)], "current means open", 1),
        ([version(1, D, END, 0)], "current means open", 1),
        ([version(1, D, None, 1)], "current means open", 1),
    ],
)
def test_dimension(frame, history, name, bad):
    assert dim(frame, history)[name] == bad


@pytest.mark.parametrize(("row", "wrong", "orphan"), [((1, D, 1, 5, "c", "b", 1), 0, 0), ((1, D, 1, 5, "stale", "b", 1), 1, 0), ((1, D, 9, 5, "c", "b", 1), 1, 1), ((1, D, 9, 5, None, None, None), 0, 1)])
def test_wide_table(frame, row, wrong, orphan):
    got = dim(frame, [version(1, D, END, 1)], [row])
    assert (got["wide table attributes"], got["no valid version"], got["wide table rows"], got["wide table amount"]) == (wrong, orphan, 0, 0)
    assert dim(frame, [version(1, D, END, 1)], [row], [])["wide table rows"] == 1


def chain(frame):
    rows = [(i, i % 3 + 1, 1, 10 * (i + 1), dt.datetime(2024, 1, 1 + i % 2, 5), ("paid", "refund", "paid")[i % 3], day(i % 2)) for i in range(8)]
    orders = frame(ORDERS, [*rows, rows[0], (99, None, 1, 5, dt.datetime(2024, 1, 1), "paid", D)])
    detail = facts.order_detail(orders)
    dws = facts.user_order_day(detail)
    return orders, detail, dws, facts.daily_sales(dws)


def test_clean_chain_has_no_violations(frame):
    assert set(counted(checks.order_checks(*chain(frame))).values()) == {0}
    assert all(c.ok for c in recon.reconcile(*chain(frame), *chain(frame)[2:], strict=True))


def test_faults_in_the_chain_are_seen(frame):
    orders, detail, dws, ads = chain(frame)
    got = counted(checks.order_checks(orders, detail, dws.filter("NOT (user_id = 1 AND dt = '2024-01-01')"), ads))
    assert got["dws is detail aggregated"] == 1 and got["ads is dws summed"] > 0
    assert counted(checks.order_checks(orders, detail, dws.filter("dt > '2024-01-01'"), ads))["dws covers detail"] == 1
    assert counted(checks.order_checks(orders.filter("dt > '2024-01-01'"), detail, dws, ads))["raw orders cover detail"] == 1
    assert counted(checks.order_checks(orders, detail.unionByName(detail), dws, ads))["detail within raw orders"] == 2
    broken = [c.name for c in recon.reconcile(orders, detail, dws.filter("user_id <> 1"), ads, dws) if not c.ok]
    assert broken == ["user days equal the copy", "rows of user days"]
    assert not next(c for c in recon.reconcile(orders, detail, dws.filter("dt < '2024-01-02'"), ads.filter("dt < '2024-01-02'")) if c.name == "user days are fresh").ok
    assert next(c for c in recon.reconcile(orders, detail, dws.filter("dt < '2024-01-02'"), ads.filter("dt < '2024-01-02'"), allow_lag=1) if c.name == "user days are fresh").ok


@pytest.mark.parametrize(
    ("row", "bad"),
    [((D, 10, 8, 100, 20, 80, 12.50, 0.8), 0), ((D, 10, 8, 100, 20, 90, 12.50, 0.8), 1), ((D, 10, 8, 100, 20, 80, 12.51, 0.8), 1), ((D, 10, 8, 100, 20, 80, 12.50, 0.7), 1), ((D, 8, 10, 100, 20, 80, 10, 1.25), 1), ((D, 10, 0, 0, 20, -20, 5, 0.0), 1), ((D, 10, 0, 0, 20, -20, None, 0.0), 0)],
)
def test_derived_columns(frame, row, bad):
    """A wrong average is seen with no paid order too."""
    got = counted(checks.order_checks(frame(ORDERS), frame(ORDERS).drop("x"), frame(DWS), frame(ADS, [row])))
    assert got["derived columns"] == bad


def test_symmetric_difference_counts_repetitions(frame, values):
    a, b = frame("k int, dt date", [(1, D), (2, D), (2, D), (3, None)]), frame("k int, dt date", [(2, D), (3, None), (4, D)])
    assert values(recon.symmetric_difference(a, b)) == [(1, "2024-01-01", "left", 1), (2, "2024-01-01", "left", 1), (4, "2024-01-01", "right", 1)]
    assert recon.worst_days(recon.symmetric_difference(a, b)).first()["rows"] == 3
    assert values(recon.date_holes(frame("dt date", [(D,), (day(1),), (day(4),), (None,)]))) == [("2024-01-02", "2024-01-05", 2)]
    assert recon.date_holes(frame("dt date")).count() == 0


def test_gate(frame):
    o = [(i, 1, 1, 1, None, "paid", day(i % 7)) for i in range(70)]
    e = [(i, 1, 1, 1, None, "pay", None, day(6)) for i in range(10)]
    gate = lambda o, e: {r["check_id"]: r["ok"] for r in checks.ods_gate(frame(ORDERS, o), frame(EVENTS, e), day(6)).collect()}
    assert set(gate(o, e).values()) == {True}
    assert not gate([r for r in o if r[6] != day(6)], e)["c1"] and not gate([r for r in o if r[6] != day(6)], e)["c2"]
    assert not gate([*o, o[6]], e)["c3"] and not gate(o, [*e, (1, 1, 1, 1, None, "payy", None, day(6))])["c4"] and not gate(o, [*e, (1, 1, 1, 1, None, None, None, day(6))])["c4"]
    assert not gate(o, e + e)["c5"] and not gate(o, [])["c5"] and not gate([r for r in o if r[6] != day(2)], e)["c6"]
    assert gate([], [])["c1"] is False


def test_lifecycle(frame, values):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    ev = lambda o, kind, when: (o, 1, 1, 5, t(1, 8), kind, when, when.date())
    rows = [ev(1, "order", t(1, 8)), ev(1, " PAY", t(1, 9)), ev(1, "ship", t(3, 0)), ev(2, "order", t(1, 9)), ev(2, "pay", t(1, 7)), ev(3, "order", t(2, 0)), ev(3, "cancel", t(2, 1)), ev(3, "order", t(2, 0))]
    events = frame(EVENTS, [*rows, (None, 1, 1, 5, None, "pay", t(1, 1), D)])
    got = {r.order_id: r for r in facts.lifecycle(events).collect()}
    assert (got[1].current_stage, got[1].pay_lag_hours, got[1].ship_lag_days, got[1].last_event_time) == ("ship", 1, 2, t(3, 0))
    # The stage is what happened last, not what is nearest to the end.
    assert (got[2].current_stage, got[2].pay_lag_hours) == ("order", -2) and got[3].current_stage == "cancel"
    part = facts.lifecycle(events, facts.scope_orders(events, day(2), day(2)))
    assert values(part) == [x for x in values(facts.lifecycle(events)) if x[0] == 1]
    clean = facts.lifecycle(events)
    assert set(counted(checks.lifecycle_checks(clean, clean)).values()) == {0}
    bad = counted(checks.lifecycle_checks(clean.unionByName(clean.filter("order_id = 1")).filter("order_id <> 2"), clean))
    assert (bad["surplus rows"], bad["missing rows"], bad["order unique"]) == (1, 1, 1)


def test_lifecycle_of_events_out_of_order(frame, values):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    ev = lambda o, kind, when: (o, 1, 1, 5, None, kind, when, D)
    rows = [ev(1, "pay", t(1, 7)), ev(1, "order", t(1, 9)), ev(2, "order", t(1, 9)), ev(2, "cancel", t(2, 0)), ev(2, "ship", t(4, 0)), ev(3, "order", t(1, 0)), ev(3, "finish", t(9, 0)), ev(3, "cancel", t(9, 0)), ev(4, "pay", None), ev(5, None, t(1, 1)), ev(6, "ship", t(5, 0)), ev(6, "finish", t(3, 0))]
    events = frame(EVENTS, rows)
    got = {r.order_id: r for r in facts.lifecycle(events, update_time=t(20, 1)).collect()}
    assert {o: r.current_stage for o, r in got.items()} == {1: "order", 2: "ship", 3: "cancel", 4: "order", 5: "order", 6: "ship"}
    assert (got[2].ship_lag_days, got[3].finish_lag_days, got[6].ship_lag_days, got[6].finish_lag_days) == (3, 8, None, None)
    assert got[4].last_event_time == dt.datetime(1970, 1, 1) and {r.update_time for r in got.values()} == {t(20, 1)}
    assert values(facts.lifecycle(events).drop("update_time")) == values(facts.expected_lifecycle(events))
    stale = counted(checks.lifecycle_checks(facts.lifecycle(events.filter("event_type <> 'ship'")), facts.expected_lifecycle(events), events.unionByName(events.limit(2))))
    assert (stale["surplus rows"], stale["missing rows"], stale["row count"], stale["events unique"], stale["start known"]) == (2, 3, 1, 2, 2)
    assert facts.lifecycle(frame(EVENTS)).count() == 0 == facts.expected_lifecycle(frame(EVENTS)).count()


def test_detail_takes_the_largest_amount_and_drops_signs(frame, values):
    o = frame(ORDERS, [(1, 1, 1, -9, None, "paid", D), (1, 1, 1, 5, None, "paid", D), (1, 1, 1, 9, None, "refund", day(1)), (2, None, 1, 5, None, "paid", D), (3, 1, None, None, None, None, None)])
    assert [x[:3] for x in values(facts.order_detail(o).withColumn("amount", facts.F.col("amount").cast("string")), "order_id", "dt", "amount")] == [(1, "2024-01-01", "9.00"), (1, "2024-01-02", "9.00"), (3, None, None)]
    assert facts.order_detail(o, D, D).count() == 1


def test_fan_out_needs_the_range(frame):
    history = frame(HISTORY, [version(1, day(i), day(i)) for i in range(8)])
    detail = facts.order_detail(frame(ORDERS, [(i, 1, 1, 5, None, "paid", day(i % 8)) for i in range(40)]))
    assert facts.version_at(detail, history).count() == 40


def test_fingerprint_ignores_order_and_marks_nulls(frame):
    one = lambda rows: checks.fingerprint({"t": frame("a string, b string", rows)}).first()["checksum"]
    assert one([("x", None), ("y", "z")]) == one([("y", "z"), ("x", None)])
    assert one([("x", None)]) != one([(None, "x")]) and one([("x", None)]) != one([("x", "")])
    assert one([]) == 0


def test_ranges():
    r = incremental.resolve_range
    assert r(None, D, day(5)) == (D, day(5)) and r(day(5), D, day(5)) is None and r(day(3), D, day(5)) == (day(4), day(5))
    assert r(day(5), D, day(5), 3) == (day(3), day(5)) and r(day(1), D, day(5), 9) == (D, day(5)) and r(None, None, None) is None
    m = incremental.mart_range
    assert m((D, day(4)), (D, day(5)), 3) == (day(2), day(5)) and m((None, None), (D, day(5))) == (D, day(5)) and m((D, D), (None, None)) is None
    with pytest.raises(incremental.Refused):
        m((day(4), day(4)), (D, day(5)), 3)
    with pytest.raises(incremental.Refused):
        incremental.explicit_range(day(2), D)
    with pytest.raises(incremental.Failed):
        incremental.coverage_gate((D, day(1)), D, day(2))


def test_dry_run_and_drift(frame, values):
    df = frame("k int, dt date", [(1, D), (2, D), (3, day(2))])
    d = incremental.dry_run(df, D, day(2))
    assert (d.rows, d.days, d.missing) == (3, 2, (day(1),))
    assert incremental.bounds(df) == (D, day(2)) and incremental.bounds(df.limit(0)) == (None, None)
    assert values(incremental.drift_outside(df, df.filter("k <> 1"), day(1))) == [(1, "2024-01-01", "stored", 1)]
    with pytest.raises(incremental.Failed):
        incremental.verify_written(df, df.limit(1), "k", "k")
    incremental.verify_written(df, df, "k", "k")


def test_stream_health_and_live_against_batch(frame):
    m = frame("k int, t string", [(1, "a"), (1, "a"), (2, None)])
    assert checks.stream_health(None, m, ["k", "t"])["ok"] is False
    got = checks.stream_health({"numInputRows": 3, "eventTime": {"watermark": "x"}}, m, ["k", "t"])
    assert (got["taken"], got["watermark"], got["copies"], got["ok"]) == (3, "x", 1.5, False)
    assert checks.stream_health({"numInputRows": 0}, m.limit(0), ["k"])["ok"] is False
    days = lambda *ns: frame("dt date", [(day(i),) for i, n in enumerate(ns) for _ in range(n)])
    live = lambda a, b, **k: counted(checks.realtime_checks(a, b, day(3), **k))
    assert set(live(days(4, 4, 4, 4), days(4, 4, 4)).values()) == {0}
    assert live(days(4, 4, 4, 9), days(4, 4, 4))["live volume"] == 1 and live(days(4, 4, 4, 1), days(4, 4, 4))["live volume"] == 1
    assert live(days(4, 3, 4, 4), days(4, 4, 4))["live equals batch"] == 1
    assert live(days(4, 4, 4), days(4, 4, 4))["live table is fresh"] == 1 and live(days(4, 4, 4), days(4, 4, 4), allow_lag=1)["live table is fresh"] == 0
    assert live(days(), days()) == {"live table is fresh": 1, "live volume": 1, "live equals batch": 0}


def test_fingerprint_of_many_rows(spark):
    """A sum of 48-bit digests that no bigint holds: its last 63 bits."""
    n = 140_000
    want = sum(int(hashlib.md5(f"={i}".encode()).hexdigest()[:12], 16) for i in range(n))
    got = checks.fingerprint({"t": spark.range(n)}, digest="md5").first()
    assert want >= 2**63 and (got["rows"], got["checksum"]) == (n, want % 2**63)
