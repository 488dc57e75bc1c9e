import datetime as dt
import random

import pytest

from ledgerloom.operators.asof import attributes_at
from ledgerloom.operators.dims import TRACKED_3, TRACKED_5, current_from_scd2, scd1_latest, scd2_full, scd2_incremental
from ledgerloom.operators.history import HeldHistory, history_from_snapshots
from ledgerloom.operators.snapdiff import snapshot_changes
from ledgerloom.plans.joins import bitmap, in_bitmap

SCHEMA = "product_id bigint, product_name string, category string, brand string, price decimal(10,2), status string, update_time timestamp_ntz, snapshot_date date"
D = [dt.date(2024, 1, i) for i in range(1, 10)]


def at(day, hour=0):
    return dt.datetime.combine(day, dt.time(hour))


def snapshots(seed, products=25):
    r = random.Random(seed)
    rows = []
    for d in D[:3] + D[4:]:  # one day was never delivered
        for p in [*range(products), None]:
            if r.random() < 0.15:
                continue
            for _ in range(r.choice([1, 1, 1, 2])):
                rows.append((p, f"n{p}", r.choice(["a", "a", "a", "b", None]), None, r.choice([1, 1, 1, 2]), "on", at(d, r.randrange(24)), d))
            if r.random() < 0.2:
                rows.append(rows[-1])
    return rows


def latest(rows):
    """Per (product, day) the row that counts, ties by brute force left out of the data below."""
    out = {}
    for r in rows:
        k = (r[0], r[7])
        if k not in out or r[6] > out[k][6]:
            out[k] = r
    return out


def no_ties(rows):
    seen, out = {}, []
    for r in rows:
        k = (r[0], r[7], r[6])
        if k in seen and seen[k] != r:
            continue
        seen[k] = r
        out.append(r)
    return out


def brute_history(rows):
    by = {}
    for (p, d), r in sorted(latest(rows).items(), key=lambda x: x[0][1]):
        v = by.setdefault(p, [])
        if not v or v[-1][1][1:6] != r[1:6]:
            v.append((d, r))
    out = set()
    for p, v in by.items():
        for i, (d, r) in enumerate(v):
            end = v[i + 1][0] - dt.timedelta(days=1) if i + 1 < len(v) else dt.date(9999, 12, 31)
            out.add((p, d.isoformat(), end.isoformat(), int(i + 1 == len(v)), r[2], None if r[4] is None else float(r[4])))
    return out


def out(df):
    return {(r.product_id, r.valid_from.isoformat(), r.valid_to.isoformat(), r.is_current, r.category, None if r.price is None else float(r.price)) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_merkle_history_equals_brute_force_and_windows(frame, seed, leaf):
    rows = no_ties(snapshots(seed))
    df = frame(SCHEMA, rows)
    got = history_from_snapshots(df, "product_id", "snapshot_date", "update_time", TRACKED_5, keys_per_leaf=leaf)
    assert got.count() == len(brute_history(rows))
    assert out(got) == brute_history(rows)
    if leaf == 8:
        assert out(scd2_full(df, "product_id", "snapshot_date", TRACKED_5)) == {x for x in brute_history(rows) if x[0] is not None}


def test_attributes_in_groups_of_snapshots(frame):
    """With a bitmap for one start only every snapshot is a group of its own."""
    rows = no_ties(snapshots(4))
    assert out(history_from_snapshots(frame(SCHEMA, rows), "product_id", "snapshot_date", "update_time", TRACKED_5, most=1)) == brute_history(rows)


def test_bitmap_loses_no_hash(spark):
    hashes = spark.range(5_000).selectExpr("xxhash64(id) AS h", "id")
    marked, bits = bitmap(hashes.filter("id < 1000"), "h", 1_000)
    kept = {r.id for r in in_bitmap(hashes, "h", marked, bits).collect()}
    assert kept >= set(range(1_000)) and len(kept) < 1_500
    few, bits = bitmap(hashes.filter("id < 1000"), "h", 1)
    assert bits == 12 and {r.id for r in in_bitmap(hashes, "h", few, bits).collect()} >= set(range(1_000))
    assert in_bitmap(hashes, "h", *bitmap(hashes.limit(0), "h", 0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_held_history_grows_as_the_full_one(spark, frame, tmp_path, seed):
    rows = no_ties(snapshots(seed))
    h = HeldHistory(spark, f"file://{tmp_path}/h", "product_id", "snapshot_date", "update_time", TRACKED_5, leaf_bits=5)
    days = sorted({r[7] for r in rows})
    for upto in (3, 4, 7, len(days)):
        come = [r for r in rows if r[7] in days[:upto]]
        h.add(frame(SCHEMA, come))
        assert out(h.read()) == brute_history(come)
    before = [s["version"] for s in h.starts.snapshots()]
    assert h.add(frame(SCHEMA, rows)) == {"leaves": 0, "starts": 0} and [s["version"] for s in h.starts.snapshots()] == before
    assert {s["operation"] for s in h.starts.snapshots()} == {"append"}
    # One product's row of an earlier day comes again with other values, another vanishes from that day, and a day between two held ones is delivered at last.
    changed = [(*r[:2], "other", *r[3:]) if (r[0], r[7]) == (3, days[2]) else r for r in rows if (r[0], r[7]) != (4, days[2])]
    told = h.add(frame(SCHEMA, changed), [days[2]])
    assert out(h.read()) == brute_history(changed) and 0 < told["leaves"] <= 2
    late = [*changed, *[(*r[:6], at(D[3]), D[3]) for (_, d), r in latest(changed).items() if d == days[0]]]
    h.add(frame(SCHEMA, late))
    assert out(h.read()) == brute_history(late)


def test_held_history_reads_attributes_of_changed_leaves_only(spark, frame, tmp_path):
    rows = [(p, "n", "a", None, 1, "on", at(d), d) for d in D[:2] for p in range(200)]
    h = HeldHistory(spark, f"file://{tmp_path}/h", "product_id", "snapshot_date", "update_time", TRACKED_5, leaf_bits=8)
    assert h.add(frame(SCHEMA, rows))["starts"] == 200
    more = rows + [(p, "n", "b" if p == 7 else "a", None, 1, "on", at(D[2]), D[2]) for p in range(200)]
    assert h.add(frame(SCHEMA, more)) == {"leaves": 1, "starts": 1}
    assert h.read().filter("product_id = 7").count() == 2
    assert HeldHistory(spark, f"file://{tmp_path}/e", "product_id", "snapshot_date", "update_time", TRACKED_5).add(frame(SCHEMA)) == {"leaves": 0, "starts": 0}


@pytest.mark.parametrize("cut", [1, 3, 6])
def test_incremental_equals_full(frame, cut):
    rows = [r for r in no_ties(snapshots(5)) if r[0] is not None]
    df = frame(SCHEMA, rows)
    first = scd2_full(df.filter(df.snapshot_date < D[cut]), "product_id", "snapshot_date", TRACKED_5)
    later = df.filter(df.snapshot_date >= D[cut])
    got = scd2_incremental(first, later, "product_id", "snapshot_date", TRACKED_5)
    assert out(got) == out(scd2_full(df, "product_id", "snapshot_date", TRACKED_5))
    again = scd2_incremental(got, later.filter(later.snapshot_date <= D[cut]), "product_id", "snapshot_date", TRACKED_5)
    assert out(again) == out(got)


def test_return_to_an_old_value_is_a_version_but_repetition_is_none(frame):
    rows = [(1, "n", c, None, 1, "on", at(d), d) for c, d in zip(["home", "book", "book", "clothing"], D)]
    df = frame(SCHEMA, rows)
    assert scd2_full(df, "product_id", "snapshot_date", TRACKED_3).count() == 3
    part = scd2_full(df.filter(df.snapshot_date <= D[1]), "product_id", "snapshot_date", TRACKED_3)
    assert scd2_incremental(part, df.filter(df.snapshot_date > D[1]), "product_id", "snapshot_date", TRACKED_3).count() == 3
    assert current_from_scd2(part).first()["category"] == "book"
    assert scd1_latest(df).first()["category"] == "clothing"


def test_empty_and_single_snapshots(frame):
    df = frame(SCHEMA)
    args = ("product_id", "snapshot_date", "update_time", TRACKED_5)
    assert history_from_snapshots(df, *args).count() == 0
    assert snapshot_changes(df, *args).count() == 0
    one = frame(SCHEMA, [(None, None, None, None, None, None, None, D[0]), (None, None, None, None, None, None, None, D[0]), (1, None, None, None, None, None, None, None)])
    assert [r.is_current for r in history_from_snapshots(one, *args).collect()] == [1]
    assert snapshot_changes(one, *args).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_changes_equal_brute_force(frame, seed):
    rows = no_ties(snapshots(seed))
    have, days = latest(rows), sorted({r[7] for r in rows})
    want = set()
    for a, b in zip(days, days[1:]):
        for p in {k[0] for k in have}:
            x, y = have.get((p, a)), have.get((p, b))
            if x or y:
                change = "added" if not x else "removed" if not y else "changed" if x[1:6] != y[1:6] else None
                if change:
                    want.add((p, b.isoformat(), change))
    got = [(r[0], r[1].isoformat(), r[2]) for r in snapshot_changes(frame(SCHEMA, rows), "product_id", "snapshot_date", "update_time", TRACKED_5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


VERSIONS = "product_id bigint, valid_from date, valid_to date, category string, price decimal(10,2), update_time timestamp_ntz"


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_attributes_at_equal_brute_force(frame, hot_rows):
    r = random.Random(4)
    far = dt.date(9999, 12, 31)
    versions = []
    for p in range(6):
        start = D[0] - dt.timedelta(days=r.randrange(3))
        while start < D[-1]:
            end = r.choice([start + dt.timedelta(days=r.randrange(4)), far])
            versions.append((p, start, end, f"c{start}", p, at(start)))
            start = end + dt.timedelta(days=1 + r.randrange(2)) if end != far else far
    versions += [(0, D[2], D[4], "later start wins", 1, at(D[0])), (1, None, D[3], "never", 1, None), (1, D[5], D[2], "backwards", 1, None), (None, D[0], far, "no key", 1, None)]
    events = [(i, r.choice([0, 0, 0, 1, 2, 3, 4, 5, 99, None]), r.choice([*D, None]), "own") for i in range(120)]
    events.append(events[0])
    got = attributes_at(frame("order_id bigint, product_id bigint, dt date, category string", events), frame(VERSIONS, versions), "product_id", "dt", ["category", "price"], precedence=["update_time"], hot_rows=hot_rows)
    assert got.columns == ["order_id", "product_id", "dt", "category", "asof_category", "price", "asof_found"]
    listed = [tuple(x) for x in got.select("order_id", "asof_category", "asof_found").collect()]

    def right(e):
        ok = [v for v in versions if v[0] is not None and v[0] == e[1] and e[2] and v[1] and v[2] and v[1] <= e[2] <= v[2]]
        return max(ok, key=lambda v: (v[1], v[5] or dt.datetime.min))[3] if ok else None

    assert sorted(map(repr, listed)) == sorted(repr((e[0], right(e), right(e) is not None)) for e in events)


def test_attributes_at_with_empty_sides(frame):
    events, versions = "order_id bigint, product_id bigint, dt date", frame(VERSIONS)
    assert attributes_at(frame(events), versions, "product_id", "dt", ["category"]).count() == 0
    row = attributes_at(frame(events, [(1, 2, D[0])]), versions, "product_id", "dt", ["category"]).first()
    assert row["category"] is None and row["asof_found"] is False


def test_attributes_at_with_versions_that_overlap(frame):
    """Long, short and nested validities, equal starts with other ends: each event has what brute force gives."""
    r = random.Random(7)
    far, versions = dt.date(9999, 12, 31), []
    for i in range(120):
        start = D[0] + dt.timedelta(days=r.randrange(-3, 30))
        versions.append((r.randrange(4), start, r.choice([start + dt.timedelta(days=r.choice([0, 1, 2, 5, 12, 25])), far if r.random() < 0.1 else start]), f"c{i}", i, None if r.random() < 0.2 else at(D[r.randrange(3)])))
    events = [(i, r.randrange(5), D[0] + dt.timedelta(days=r.randrange(-5, 40))) for i in range(300)]
    got = attributes_at(frame("order_id bigint, product_id bigint, dt date", events), frame(VERSIONS, versions), "product_id", "dt", ["category"], precedence=["update_time"])

    def right(e):
        ok = [v for v in versions if v[0] == e[1] and v[1] <= e[2] <= v[2]]
        return max(ok, key=lambda v: (v[1], v[5] or dt.datetime.min, v[3]))[3] if ok else None

    assert sorted((x.order_id, x.category, x.asof_found) for x in got.collect()) == sorted((e[0], right(e), right(e) is not None) for e in events)
