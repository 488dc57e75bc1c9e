import os

from ledgerloom.plans.joins import small, spread
from ledgerloom.plans.scratch import checkpointed, clean, new_path, shared_dir, written


def test_paths_lie_below_the_shared_folder_and_go_with_clean(spark):
    df = written(spark.range(5), "t")
    path = new_path(spark, "x")
    assert path.startswith(shared_dir(spark)) and df.count() == 5
    files = [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    assert clean(spark) > 0 and not any(os.path.exists(f) for f in files)


def test_checkpoint_keeps_rows_and_partitions(spark):
    df = checkpointed(spark.range(100).repartitionByRange(3, "id"))
    assert df.count() == 100 and df.rdd.getNumPartitions() == 3


def test_only_counted_rows_are_broadcast(spark):
    plan = lambda n: spark.range(100).join(small(spark.range(50), n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(50) and "strategy=broadcast" not in plan(49)


def test_spread_leaves_enough_partitions_alone(spark):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() >= 4
    assert spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9
