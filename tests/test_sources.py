import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli
from ledgerloom.operators import facts, incremental
from ledgerloom.plans import pipeline
from ledgerloom.plans.warehouse import Warehouse
from ledgerloom.sources import csv_snapshot, generators, json_topic, sinks, versioned
from ledgerloom.sources.versioned import Conflict, VersionedTable

D = dt.date(2024, 1, 1)
SCHEMA = "k bigint, v string, dt date"


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", "dt")


def test_versions_and_time_travel(frame, values, table):
    assert table.manifest() is None
    table.append(frame(SCHEMA, [(1, "a", D), (2, "b", day(1)), (9, "n", None)]))
    table.overwrite_partitions(frame(SCHEMA, [(3, "c", D)]), ["2024-01-01"])
    assert values(table.read()) == [(2, "b", "2024-01-02"), (3, "c", "2024-01-01"), (9, "n", None)]
    assert values(table.read(1), "k") == [(1,), (2,), (9,)]
    assert values(table.read(first="2024-01-02"), "k") == [(2,)]
    assert [s["rows"] for s in table.snapshots()] == [3, 3]
    with pytest.raises(ValueError):
        table.read(7)
    with pytest.raises(ValueError):
        table.overwrite_partitions(frame(SCHEMA, [(3, "c", D)]), ["2024-01-02"])


def test_a_day_that_became_empty_is_emptied(frame, values, table):
    table.append(frame(SCHEMA, [(1, "a", D), (2, "b", day(1))]))
    table.overwrite_partitions(frame(SCHEMA), ["2024-01-01"])
    assert values(table.read(), "k") == [(2,)]


def test_changes_by_key_and_condition(frame, values, table):
    table.append(frame(SCHEMA, [(1, "a", D), (2, "b", day(1)), (None, "n", day(2))]))
    untouched = table.manifest()["parts"]["2024-01-02"]
    table.upsert(frame(SCHEMA, [(1, "A", day(2)), (None, "N", day(2)), (5, "e", D), (5, "f", D)]), ["k"])
    assert values(table.read(), "k", "v") == [(1, "A"), (2, "b"), (5, "f"), (None, "N")]
    assert table.manifest()["parts"]["2024-01-02"] == untouched

    table.update_where(F.col("k") == 2, {"v": F.lit("B")})
    table.delete_where(F.col("k") == 5)
    table.delete_keys(frame("k bigint", [(None,)]), ["k"])
    assert values(table.read(), "k", "v") == [(1, "A"), (2, "B")]
    table.drop_partitions(lambda v: v >= "2024-01-03")
    assert values(table.read(), "k") == [(1,)]
    table.truncate()
    assert table.read().count() == 0


def test_overtaken_commit_changes_nothing(frame, table):
    table.append(frame(SCHEMA, [(1, "a", D)]))
    base = table.manifest()
    table.append(frame(SCHEMA, [(2, "a", D)]))
    with pytest.raises(Conflict):
        table._commit(base, {}, frame(SCHEMA).schema, "late")
    assert table.read().count() == 2


def test_crash_before_the_commit_leaves_the_table_as_it_was(frame, table, monkeypatch):
    table.append(frame(SCHEMA, [(1, "a", D)]))
    monkeypatch.setattr(table, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.append(frame(SCHEMA, [(2, "b", D)]))
    monkeypatch.undo()
    assert table.read().count() == 1
    table.expire(1, grace=dt.timedelta(0))
    assert len(table.store.names("data")) == 1


def test_compaction_and_expiry_keep_the_rows(frame, values, table):
    for i in range(6):
        table.append(frame(SCHEMA, [(i, "a", D)]))
    before = values(table.read())
    table.compact()
    assert len(table.files()) == 1 and values(table.read()) == before
    gone = table.expire(2, grace=dt.timedelta(0))
    assert len(gone) == 5 and len(table.versions()) == 2 and values(table.read()) == before
    assert table.expire(1, older_than=dt.datetime(2000, 1, 1, tzinfo=dt.UTC)) == []


def test_backup(frame, values, table, tmp_path):
    table.append(frame(SCHEMA, [(1, "a", D)]))
    versioned.backup(f"{tmp_path}/t", f"{tmp_path}/b")
    assert versioned.verify_backup(f"{tmp_path}/b") == []
    table.append(frame(SCHEMA, [(2, "b", D)]))
    versioned.restore(f"{tmp_path}/b", f"{tmp_path}/t")
    assert values(table.read(), "k") == [(1,)]
    part = next(os.path.join(a, n) for a, _, ns in os.walk(f"{tmp_path}/b") for n in ns if n.endswith(".parquet"))
    with open(part, "ab") as f:
        f.write(b"x")
    assert versioned.verify_backup(f"{tmp_path}/b")
    with pytest.raises(ValueError):
        versioned.restore(f"{tmp_path}/b", f"{tmp_path}/t")


def message(i, when="2024-01-01 10:00:00", **more):
    return json.dumps({"order_id": i, "user_id": 1, "product_id": 1, "amount": 5.25, "order_time": when, "event_type": "pay", "event_time": when} | more)


def lines(path, name, *texts):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write("\n".join(texts) + "\n")


def test_topic_replay(spark, tmp_path, values):
    lines(f"{tmp_path}/m", "1.json", message(1), message(1, event_time="2024-01-01 09:00:00"), message(2, when="2024-01-02 00:00:00", user_id=None), message(3, amount=-1), "{broken", message(4, when="no time"))
    m = json_topic.read_topic(spark, f"{tmp_path}/m", json_topic.EVENT)
    assert json_topic.counters(m) == {"raw": 6, "rejected": 1, "null_user": 1, "negative": 1}
    assert values(json_topic.replay_events(m, D), "order_id", "event_time") == [(1, "2024-01-01T09:00:00"), (3, "2024-01-01T10:00:00")]
    assert json_topic.replay_orders(json_topic.read_topic(spark, f"{tmp_path}/m", json_topic.ORDER), D).count() == 3


def test_stream_takes_each_message_once(spark, tmp_path, values, table):
    src, cp = f"{tmp_path}/m", f"file://{tmp_path}/cp"
    go = lambda: json_topic.ingest_stream(spark, src, json_topic.EVENT, "event_time", table, cp, "w", files_per_batch=1)
    lines(src, "1.json", message(1))
    go()
    lines(src, "2.json", message(2), message(3))
    lines(src, "3.json", message(4))
    go()
    go()
    assert values(table.read(), "order_id") == [(1,), (2,), (3,), (4,)]
    held = table.manifest()["version"]
    assert table.append(table.read(), ("w", 1)) == held
    lines(src, "4.json", message(5), "{broken")
    with pytest.raises(Exception, match="parse"):
        go()
    assert table.read().count() == 4


def test_guards(frame, table):
    with pytest.raises(json_topic.Rejected):
        json_topic.guard(0, 0, 0, 0)
    with pytest.raises(json_topic.Rejected):
        json_topic.guard(5, 1, 5, 5)
    with pytest.raises(json_topic.Rejected):
        json_topic.full_reload(table, frame(SCHEMA), ["k"])
    json_topic.full_reload(table, frame(SCHEMA, [(1, "a", D)]), ["k"])
    json_topic.refresh_today(table, frame(SCHEMA, [(2, "b", D), (3, "x", day(1))]), D)
    json_topic.refresh_today(table, frame(SCHEMA, [(2, "b", D), (3, "x", day(1))]), D)
    assert [r.k for r in table.read().collect()] == [2]


HEAD = "product_id,product_name,category,brand,price,status,update_time"


def test_csv_snapshots(spark, tmp_path, values):
    at = f"{tmp_path}/product_snapshot_20240101.csv"
    lines(str(tmp_path), "product_snapshot_20240101.csv", HEAD, '1,"a, b",c,,5.50,on_sale,2024-01-01 01:02:03')
    lines(str(tmp_path), "product_snapshot_20240102.csv", HEAD)
    rows = csv_snapshot.load_snapshots(spark, [at, at.replace("0101.", "0102.")])
    assert values(rows, "product_id", "product_name", "brand", "snapshot_date") == [(1, "a, b", None, "2024-01-01")]
    t = VersionedTable(spark, f"file://{tmp_path}/p", "snapshot_date")
    csv_snapshot.store_snapshots(t, rows, [D, day(1)])
    assert t.read().count() == 1
    assert csv_snapshot.in_range([at], day(1)) == []
    lines(str(tmp_path), "product_snapshot_20240103.csv", HEAD.replace("brand", "brnd"), "1,a,b,c,5,on,2024-01-01 00:00:00")
    with pytest.raises(csv_snapshot.Malformed):
        csv_snapshot.load_snapshots(spark, [f"{tmp_path}/product_snapshot_20240103.csv"])
    lines(str(tmp_path), "product_snapshot_20240104.csv", HEAD, "x,a,b,c,5,on,2024-01-01 00:00:00")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        csv_snapshot.load_snapshots(spark, [f"{tmp_path}/product_snapshot_20240104.csv"]).collect()
    with pytest.raises(csv_snapshot.Malformed):
        csv_snapshot.day_of("products.csv")


def test_sinks(spark, frame, tmp_path):
    df = frame("a int, b string, c decimal(10,2)", [(1, None, 1234567.5)])
    assert sinks.as_text(df).first()[0] == "1\t\\N\t1234567.50"
    sinks.write_text(df, f"{tmp_path}/x")
    with pytest.raises(Exception, match="exist"):
        sinks.write_text(df, f"{tmp_path}/x")
    assert sinks.run_statements(spark, "SELECT 1; -- a; b\n\nSELECT ';' AS x;\n;") == 2


def test_generators_are_deterministic_and_shaped(spark):
    o = generators.orders(spark, D, 3, 200).cache()
    assert o.count() == 600 and o.select("order_id").distinct().count() == 600
    assert 10 <= o.filter("user_id IS NULL").count() <= 60 and o.filter("to_date(order_time) <> dt").count() == 0
    assert o.exceptAll(generators.orders(spark, D, 3, 200).repartition(7)).count() == 0
    e = generators.order_events(o)
    assert e.filter("to_date(event_time) <> dt").count() == 0 and e.filter("event_type = 'order'").select("order_id").distinct().count() == 600
    assert e.count() > e.dropDuplicates(["order_id", "event_type"]).count()
    assert generators.products(spark, D, 4).count() == 200


def test_pipeline(tmp_path):
    ran, alerts = [], []
    step = lambda n, *after: pipeline.Step(n, lambda d: ran.append(n), after)
    bad = pipeline.Step("bad", lambda d: 1 / 0, ["a"])
    ok = pipeline.run(D, [step("c", "b"), step("b", "a"), step("a")], ledger=f"{tmp_path}/l.csv", lock=f"{tmp_path}/lock")
    assert ok.ok and ran == ["a", "b", "c"]
    out = pipeline.run(D, [step("a"), bad, step("z", "bad")], ledger=f"{tmp_path}/l.csv", alert=lambda n, e: alerts.append(n))
    assert out.states == {"a": "done", "bad": "failed", "z": "skipped"} and alerts == ["bad"] and "ZeroDivision" in out.errors["bad"]
    with open(f"{tmp_path}/l.csv") as f:
        assert len(f.readlines()) == 7
    with pytest.raises(ValueError):
        pipeline.order([step("a", "b"), step("b", "a")])
    with pytest.raises(ValueError):
        pipeline.order([step("a", "x")])
    assert list(pipeline.backfill(D, day(2), [bad, step("a")])) == [D]


def test_lock(tmp_path):
    lock = f"{tmp_path}/lock"
    with pipeline.serial(lock):
        with pytest.raises(pipeline.Busy), pipeline.serial(lock):
            pass
    os.mkdir(lock)
    os.utime(lock, (1, 1))
    with pipeline.serial(lock, stale_s=60):
        pass
    assert not os.path.exists(lock)


def test_warehouse_from_raw_to_marts(spark, tmp_path, monkeypatch, capsys):
    w = Warehouse(spark, f"file://{tmp_path}/lake")
    o = generators.orders(spark, D, 8, 60)
    w.tables["ods_product"].append(generators.products(spark, D, 8))
    w.tables["ods_order"].append(o.filter("dt < '2024-01-08'"))
    w.tables["ods_order_event"].append(generators.order_events(o.filter("dt < '2024-01-08'"), copies=0, shifted=0))
    w.build_dims()
    assert w.build_facts() == (D, day(6)) and w.build_marts() == (D, day(6))
    assert all(c.ok for c in w.recon(strict=True))
    w.tables["ods_order"].append(o.filter("dt = '2024-01-08'"))
    assert w.build_facts(lookback=2) == (day(5), day(7)) and w.build_marts() == (day(4), day(7))
    marts = sorted(map(tuple, w.read("ads_daily_sales").collect()))
    w.build_dims(full=True)
    w.build_facts(first=D, last=day(7))
    w.build_marts(truncate=True)
    assert sorted(map(tuple, w.read("ads_daily_sales").collect())) == marts
    w.tables["dws_user_order_day"].delete_where(F.col("user_id") == 5)
    assert not all(c.ok for c in w.recon())
    w.build_marts(truncate=True)
    assert all(c.ok for c in w.recon())
    assert w.maintain(expire=True, keep=1)["ads_daily_sales"]["versions"] == 1
    with pytest.raises(ValueError):
        w.maintain(names=["nope"])
    lake = ["--lake", f"file://{tmp_path}/lake"]
    assert cli.main([*lake, "recon", "--strict"]) == 0 and "RECON|OK" in capsys.readouterr().out
    assert cli.main([*lake, "marts", "--truncate", "--range", "2024-01-01", "2024-01-02"]) == 1
    assert cli.main([*lake, "marts", "--range", "2024-01-02", "2024-01-01"]) == 1
    assert cli.main([*lake, "run", "--day", "2024-01-08", "--ledger", f"{tmp_path}/l.csv"]) == 0


def test_next_events_go_on_from_what_was_told(spark, frame):
    o = generators.orders(spark, D, 1, 300, no_user=0)
    told = generators.order_events(o, copies=0, shifted=0)
    first = told.filter("event_type = 'order'")
    later = [generators.next_events(first, day(i)) for i in range(6)]
    assert sum(x.count() for x in later) == told.filter("event_type <> 'order'").count()
    assert generators.next_events(told, day(1)).count() == 0
    assert generators.next_events(first.limit(0), D).count() == 0
    lives = (generators.Life(1, {"cancel": 3}),)
    assert {r.event_type for r in generators.next_events(first, D, lives=lives).collect()} == {"cancel"}
    bad = generators.dirty(told, copies=0.5, no_user=1, negative=1, late=1, late_days=3, regressed=1)
    assert bad.filter("user_id IS NOT NULL OR amount > 0").count() == 0 and bad.count() > 2 * told.count()
    assert generators.dirty(told, huge=1).filter("amount < 9999999").count() == 0
    sent = [(r.event_time, r.order_id) for r in generators.in_order(told.repartition(5)).collect()]
    assert sent == sorted(sent)


def test_builds_check_what_they_wrote(spark, tmp_path, capsys, monkeypatch):
    w = Warehouse(spark, f"file://{tmp_path}/lake")
    o = generators.orders(spark, D, 5, 40)
    w.tables["ods_product"].append(generators.products(spark, D, 5))
    w.tables["ods_order"].append(o)
    w.tables["ods_order_event"].append(generators.order_events(o))
    assert w.build_dims()["starts"] > 50 and w.build_dims() == {"leaves": 0, "starts": 0}
    # A day of snapshots that is written again, however old, is taken in.
    other = generators.products(spark, D, 5).filter("snapshot_date = '2024-01-02'").withColumn("category", F.when(F.col("product_id") == 3, "another").otherwise(F.col("category")))
    w.tables["ods_product"].overwrite_partitions(other, ["2024-01-02"])
    assert w.build_dims()["leaves"] == 1 and w.read("dim_product_scd2").filter("category = 'another'").count() == 1
    lake = ["--lake", f"file://{tmp_path}/lake"]
    assert cli.main([*lake, "build", "--table", "dwd_order_detail"]) == 0 and w.tables["dwd_order_sku_detail"].manifest() is None
    assert cli.main([*lake, "build", "--table", "facts", "--mode", "rebuild", "--strict-closure"]) == 0 and cli.main([*lake, "marts"]) == 0
    assert cli.main([*lake, "checks"]) == 0 and cli.main([*lake, "recon", "--baseline", '{"detail": 1}']) == 2 and "RECON_RESULT|BAD" in capsys.readouterr().out
    assert cli.main([*lake, "marts", "--dry-run"]) == 0 and "rows=" in capsys.readouterr().out
    # Appending days that are held doubles them, which the check after writing sees.
    assert cli.main([*lake, "build", "--table", "dwd_order_detail", "--mode", "append", "--start", "2024-01-02", "--end", "2024-01-02"]) == 2
    assert cli.main([*lake, "recon", "--range", "2024-01-03", "2024-01-05"]) == 0
    assert cli.main([*lake, "recon", "--range", "2024-01-01", "2024-01-02", "--fast"]) == 2 and cli.main([*lake, "checks"]) == 2
    assert "dws is detail aggregated" in capsys.readouterr().out
    assert cli.main([*lake, "build", "--table", "facts", "--mode", "rebuild"]) == 0
    # Raw orders that come later than the detail: closure sees the day, strictly or as a warning.
    monkeypatch.setattr(facts, "order_detail", lambda rows: real(rows).filter("order_id % 7 <> 0"))
    assert cli.main([*lake, "build", "--table", "dwd_order_detail", "--start", "2024-01-01", "--end", "2024-01-05"]) == 0 and "doesn't close" in capsys.readouterr().err
    assert cli.main([*lake, "build", "--table", "dwd_order_detail", "--start", "2024-01-01", "--end", "2024-01-05", "--strict-closure"]) == 2
    monkeypatch.undo()
    w.build_facts(first=D, last=day(4))
    # A mart day broken after it was written: the self check fails.
    w.tables["dws_user_order_day"].update_where(F.col("dt") == "2024-01-03", {"paid_cnt": F.col("paid_cnt") + 1})
    with pytest.raises(incremental.Failed):
        w.check_marts(D, day(4))
    w.build_marts(first=day(3), last=day(4))
    assert "before 2024-01-04" in w.warnings[0]
    assert cli.main([*lake, "gate", "--day", "2024-01-05"]) == 2 and "DQC_RESULT|BAD|2024-01-05|6|" in capsys.readouterr().out


real = facts.order_detail


def test_lock_is_kept_fresh_and_only_its_holder_frees_it(tmp_path):
    import time

    lock = f"{tmp_path}/lock"
    with pipeline.serial(lock, stale_s=0.8):
        time.sleep(1.2)
        with pytest.raises(pipeline.Busy), pipeline.serial(lock, stale_s=0.8):
            pass
    assert not os.path.exists(lock)
    with pipeline.serial(lock):
        os.rename(lock, f"{lock}.gone")
        os.mkdir(lock)
    assert os.path.exists(lock)


def test_ledger_and_waiting_for_another_workflow(tmp_path):
    ledger, tries = f"{tmp_path}/l.csv", []
    flaky = pipeline.Step("x", lambda d: tries.append(1) or (1 / 0 if len(tries) < 2 else 5))
    assert pipeline.run(D, [flaky], ledger=ledger, workflow="lake", attempts=2).ok
    import csv

    with open(ledger, newline="") as f:
        row = next(csv.DictReader(f))
    assert tuple(row) == pipeline.LEDGER and len(row) == 26 and (row["attempt"], row["result"], row["state"], row["run_state"]) == ("2", "5", "done", "done")
    assert pipeline.done_in(ledger, "x", D, "lake") and not pipeline.done_in(ledger, "x", day(1)) and not pipeline.done_in(f"{tmp_path}/none.csv", "x", D)
    assert pipeline.run(D, [pipeline.wait_for("w", ledger, "x", wait_s=0)]).ok
    assert pipeline.run(day(1), [pipeline.wait_for("w", ledger, "x", wait_s=0)]).errors["w"].startswith("Busy")


def test_lag_and_completeness_of_an_ingest(spark, tmp_path, table):
    src, cp = f"{tmp_path}/m", f"file://{tmp_path}/cp"
    lines(src, "1.json", message(1), message(2))
    assert json_topic.lag(spark, src, cp) == {"files": 1, "messages": 2, "gone": 0}
    json_topic.ingest_stream(spark, src, json_topic.EVENT, "event_time", table, cp, "w")
    lines(src, "2.json", message(3))
    assert json_topic.lag(spark, src, cp) == {"files": 1, "messages": 1, "gone": 0}
    json_topic.guard_complete(spark, src, cp, table.read().count())
    with pytest.raises(json_topic.Rejected):
        json_topic.guard_complete(spark, src, cp, 3)
    os.remove(f"{src}/1.json")
    with pytest.raises(json_topic.Rejected):
        json_topic.guard_complete(spark, src, cp, 2)


def test_backup_on_any_file_system(spark, frame, table, tmp_path):
    table.append(frame(SCHEMA, [(1, "a", D), (2, "b", day(1))]))
    root, to = table.store.root, f"file://{tmp_path}/copy"
    assert versioned.shared_backup(spark, root, to) == 3 and versioned.shared_verify(spark, to).count() == 0
    assert VersionedTable(spark, to, "dt").read().count() == 2
    part = next(os.path.join(a, n) for a, _, ns in os.walk(f"{tmp_path}/copy") for n in ns if n.endswith(".parquet"))
    os.remove(part)
    assert [r.why for r in versioned.shared_verify(spark, to).collect()] == ["missing"]
    assert [(m["version"], m["partitions"], m["folders"]) for m in table.manifests()] == [(1, 2, 2)]
    table.refresh()
