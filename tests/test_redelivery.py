import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming.redelivery import ASK, NEW, NO_TIME, SEEN, deliveries, one_copy, repeated

SCHEMA = "id bigint, kind string, at timestamp_ntz, extra string"
T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, batches):
    """Each batch a file, in order."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        part = next(f for f in os.listdir(f"{tmp_path}/w{i}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/w{i}/{part}", f"{tmp_path}/in/{i:03d}.parquet")
        os.utime(f"{tmp_path}/in/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return known(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), known(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))


def known(df):
    return df.filter("id IS NOT NULL AND kind IS NOT NULL")


def counted(bs):
    count = {}
    for r in (r for b in bs for r in b if r[0] is not None):
        count[r[:2]] = count.get(r[:2], 0) + 1
    return count


def batches(seed, n=5, size=60):
    """Days pass from batch to batch; ids come again soon, long after, and with clocks that run behind; some have no time."""
    r, out, seen = random.Random(seed), [], []
    for b in range(n):
        rows = []
        for _ in range(size):
            if seen and r.random() < 0.3:
                i, k = r.choice(seen)
            else:
                i, k = len(seen), r.choice("pq")
                seen.append((i, k))
            when = T0 + dt.timedelta(days=10 * b, hours=r.randrange(48)) - dt.timedelta(days=r.choice([0, 0, 0, 25]))
            rows.append((r.choice([i, i, i, None]) if r.random() < 0.1 else i, k, None if r.random() < 0.05 else when, f"{b}-{r.random()}"))
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_one_copy_of_each_and_all_repeated_ones(spark, tmp_path, seed):
    bs = batches(seed)
    d = deliveries(*stream(spark, tmp_path, bs), ["id", "kind"], "at", F.col("extra"), delay="5 days", buckets=3)
    count = counted(bs)
    micros = lambda t: NO_TIME if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    first = {}
    for r in (r for b in bs for r in b if r[0] is not None):
        first.setdefault(r[:2], []).append((r[2] is None, micros(r[2]), r[3]))
    kept = {(r["id"], r["kind"]): (r["t"], r["p"], r["copies"]) for r in one_copy(d).collect()}
    assert kept == {k: (*min(v)[1:], count[k]) for k, v in first.items()}
    assert sorted(tuple(r) for r in repeated(d).collect()) == sorted(k for k, n in count.items() if n > 1)
    told = d.told()
    assert told.count() == sum(count.values())
    assert {r["verdict"] for r in told.select("verdict").distinct().collect()} == {NEW, SEEN, ASK}
    # The state decides most: what it accepted more than once had been forgotten.
    assert d.accepted.count() > 0.8 * len(count) and d.accepted.select("id", "kind").distinct().count() > 0.9 * d.accepted.count()


def test_kept_copy_does_not_depend_on_batches(spark, tmp_path):
    bs = batches(5)
    parts = [deliveries(*stream(spark, tmp_path / str(i), x), ["id", "kind"], "at", F.col("extra"), delay="5 days") for i, x in enumerate([bs, [sum(bs, [])]])]
    a, b = (sorted(map(tuple, one_copy(d).collect())) for d in parts)
    assert a == b


def test_restart_goes_on_where_it_ended(spark, tmp_path):
    bs = batches(3, n=2)
    s = stream(spark, tmp_path, bs)
    first = deliveries(*s, ["id", "kind"], "at", delay="5 days", buckets=2, checkpoint=f"file://{tmp_path}/cp").accepted.count()
    again = deliveries(*s, ["id", "kind"], "at", delay="5 days", buckets=2, checkpoint=f"file://{tmp_path}/cp").accepted.count()
    assert first == again


def test_restart_under_another_number_of_partitions(spark, tmp_path):
    """The same messages again after a restart: the state still knows all of them."""
    rows = [(i, "k", T0 + dt.timedelta(hours=i % 40), "") for i in range(1_000)]
    stream(spark, tmp_path, [rows])
    cp = f"file://{tmp_path}/cp"
    both = lambda: (known(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), known(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert deliveries(*both(), ["id", "kind"], "at", checkpoint=cp).accepted.count() == 1_000
        import os
        import shutil

        shutil.copy(f"{tmp_path}/in/000.parquet", f"{tmp_path}/in/001.parquet")
        os.utime(f"{tmp_path}/in/001.parquet", (1_700_000_100, 1_700_000_100))
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        d = deliveries(*both(), ["id", "kind"], "at", checkpoint=cp)
        assert d.accepted.count() == 1_000 and d.rest.count() == 1_000 and repeated(d).count() == 1_000 and one_copy(d).count() == 1_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_settings_are_put_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    deliveries(*stream(spark, tmp_path, [[(1, "a", T0, "")]]), ["id", "kind"], "at", buckets=2)
    assert spark.conf.get(key) == before


def test_no_messages_with_an_identifier(spark, tmp_path):
    d = deliveries(*stream(spark, tmp_path, [[(None, "a", T0, ""), (1, None, T0, "")]]), ["id", "kind"], "at")
    assert one_copy(d).count() == 0 and repeated(d).count() == 0 and d.told().count() == 0


def test_one_identifier_on_most_rows(spark, tmp_path):
    rows = [(1 if i % 3 else i, "k", T0 + dt.timedelta(seconds=i), str(i)) for i in range(3_000)]
    d = deliveries(*stream(spark, tmp_path, [rows[:1_500], rows[1_500:]]), ["id", "kind"], "at", F.col("extra"))
    assert [tuple(r) for r in repeated(d).collect()] == [(1, "k")] and one_copy(d).count() == 1_001
    assert one_copy(d).filter("id = 1").first()["copies"] == 2_000
