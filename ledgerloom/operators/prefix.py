"""Range-sorted tables with exact running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.scratch import checkpointed


#: Rows of a range partition, about.
PARTITION_ROWS = 2_000_000


def range_sorted(df: DataFrame, order: Sequence[str], partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """The rows range-partitioned and sorted by `order`, checkpointed: partition and place of each row are final. rows: how many there are, or an upper bound: there are partitions enough for that many, and no fewer than the session has."""
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // PARTITION_ROWS))
    return checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))


def _starts(table: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """For each row but the first: whether its group is another than that of the row before; nulls are equal."""
    n = table.num_rows
    other = np.zeros(max(0, n - 1), dtype=bool)
    for g in group:
        c = table.column(g)
        a, b = c.slice(0, n - 1), c.slice(1)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), both)
        other |= ~same.to_numpy(zero_copy_only=False)
    return other


def running_sums(ranged: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The rows of a range_sorted table, ordered by group first, with `<name>_run` for each name of `sums`: the sum of that bigint column over its group up to and including the row.

    One pass sums every partition's part of the last group in it; the offset a partition starts with follows from the parts before. There is one
    offset a partition: only the first group in a partition can have begun in an earlier one. A second pass adds up within partitions, so a
    group of any size is spread over all its partitions. Nulls in the summed columns count 0. Null groups are groups.
    """
    keys, parts = [f"g{i}" for i in range(len(group))], [f"s{i}" for i in range(len(sums))]
    picked = ranged.select(F.spark_partition_id().alias("p"), *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, group)], *[F.col(f"`{c}`").alias(s) for s, c in zip(parts, sums)])
    per = picked.groupBy("p", *keys).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in parts])
    # Of each partition its first and its last group, which is all that can cross a border: one row a partition.
    order = F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)) for k in keys])
    group_hash = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))]).alias("g")
    totals = F.struct(group_hash, *parts)
    ends = per.groupBy("p").agg(F.min_by(totals, order).alias("first"), F.max_by(totals, order).alias("last")).orderBy("p").collect()
    offsets: dict[int, list[int]] = {}
    carried, at = [0] * len(sums), None
    for e in ends:
        offsets[e["p"]] = carried if e["first"]["g"] == at else [0] * len(sums)
        mine = [e["last"][s] for s in parts]
        carried = [c + m for c, m in zip(carried, mine)] if e["last"]["g"] == at and e["first"]["g"] == at else mine
        at = e["last"]["g"]
    names = [f"{s}_run" for s in sums]
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        carry = np.array(offsets.get(TaskContext.get().partitionId(), [0] * len(sums)), dtype=np.int64)
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tail = batch.slice(n - 1, 1)
            if last is not None:
                joint = pa.concat_tables([pa.Table.from_batches([last]), pa.Table.from_batches([batch.slice(0, 1)])]).combine_chunks().to_batches()[0]
                if _starts(joint, group)[0]:
                    carry = np.zeros(len(sums), dtype=np.int64)
            begins = np.flatnonzero(np.concatenate([[True], _starts(batch, group)]))
            length = np.diff(np.append(begins, n))
            arrays = []
            for i, s in enumerate(sums):
                v = pc.fill_null(batch.column(s), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                run = np.cumsum(v)
                before = np.concatenate([[0], run])[begins]
                before[0] -= carry[i]
                run = run - np.repeat(before, length)
                arrays.append(pa.array(run, pa.int64()))
                carry[i] = run[-1]
            last = tail
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return ranged.mapInArrow(add_up, schema)
