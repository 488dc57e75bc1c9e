"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import cell_text, fresh, hash_pair
from ledgerloom.plans.joins import bitmap, in_bitmap
from ledgerloom.plans.scratch import written


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, int | None] | Sequence[str], only_left: str = "only_in_left", only_right: str = "only_in_right") -> DataFrame:
    """Rows (keys..., diff): every key that one side lacks or holds another number of times, every field that differs.

    Both sides are unpivoted to key-field-value cells, united with signed counts and grouped; cells and keys whose counts don't cancel are what differs. That is done in two steps, so that little
    moves where most cancels: first the cells of each row go into one signed sum of hashes, of 128 bits, by key; a key at which the sums and counts of both sides cancel has equal cells. Only the rows of
    the other keys, which a bitmap of bounded size finds, are then unpivoted, and their cells counted and put together by key. Equal keys, and equal cells, are summed before they move, so a key that is
    repeated often costs no more than another.

    fields: names, or names with the number of decimals to compare to (half up); None compares the value's text.
    diff: `only_left` or `only_right`; `row_count` where both have the key but not equally often; else a field's name.
    A null is a value of its own, in keys too. With equal row counts a field differs if the multisets of its values differ; with
    unequal ones, if one side has a value that the other has not. Repeated rows that both sides repeat equally are no difference.
    Empty text isn't null. An empty side makes all keys of the other one-sided. Columns that aren't named are not read.
    """
    scales = dict(fields) if isinstance(fields, Mapping) else dict.fromkeys(fields)
    names = list(scales)
    ks = [f"k{i}" for i in range(len(keys))]

    def cells(df: DataFrame, sign: int) -> DataFrame:
        each = [F.struct(F.lit(-1).alias("f"), F.lit(None).cast("string").alias("v"))]
        each += [F.struct(F.lit(i).alias("f"), cell_text(df, n, s).alias("v")) for i, (n, s) in enumerate(scales.items())]
        flat = df.select(*[F.col(f"`{k}`").alias(a) for a, k in zip(ks, keys)], F.explode(F.array(*each)).alias("c"))
        return flat.select(*ks, "c.f", "c.v", F.lit(sign).alias("sign"))

    def rows(df: DataFrame, sign: int) -> DataFrame:
        """A row's keys and the four parts of the hash of its cells, signed."""
        h1, h2 = hash_pair([*[F.col(f"`{k}`").cast("string") for k in keys], *[cell_text(df, n, s) for n, s in scales.items()]])
        low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
        parts = [low(h1), F.shiftrightunsigned(h1, 32), low(h2), F.shiftrightunsigned(h2, 32)]
        return df.select(*[F.col(f"`{k}`").alias(a) for a, k in zip(ks, keys)], *[(p * sign).alias(f"s{i}") for i, p in enumerate(parts)], F.lit(sign).cast("bigint").alias("n"))

    sums = rows(left, 1).unionByName(rows(right, -1)).groupBy(*ks).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)], F.sum("n").alias("n"))
    # Keys of two types are compared, and hashed, as the type that holds both.
    kinds = [sums.schema[a].dataType for a in ks]
    key_hash = lambda cols: F.xxhash64(*[x for c, kind in zip(cols, kinds) for x in (c.isNull(), c.cast(kind).cast("string"))])
    open_keys = written(sums.filter("s0 <> 0 OR s1 <> 0 OR s2 <> 0 OR s3 <> 0 OR n <> 0").select(key_hash([F.col(k) for k in ks]).alias("h")), "keys")
    marked, bits = bitmap(open_keys, "h", open_keys.count())

    def some(df: DataFrame) -> DataFrame:
        taken = fresh(df.columns, "key_hash")
        return in_bitmap(df.withColumn(taken, key_hash([F.col(f"`{k}`") for k in keys])), taken, marked, bits).drop(taken)

    counted = (
        cells(some(left), 1).unionByName(cells(some(right), -1))
        .groupBy(*ks, "f", "v")
        .agg(F.sum("sign").alias("net"), F.count_if(F.col("sign") > 0).alias("l"), F.count_if(F.col("sign") < 0).alias("r"))
    )
    left_over = counted.filter("net <> 0")
    row = F.col("f") == -1
    one_sided = (F.col("l") == 0) | (F.col("r") == 0)
    by_key = left_over.groupBy(*ks).agg(
        F.max(F.when(row, F.col("l"))).alias("l"),
        F.max(F.when(row, F.col("r"))).alias("r"),
        *[F.max(F.when(F.col("f") == i, F.when(one_sided, 2).otherwise(1))).alias(f"f{i}") for i in range(len(names))],
    )
    unequal = F.col("l").isNotNull()
    found = [F.when(unequal, F.lit("row_count"))]
    found += [F.when(F.col(f"f{i}") >= F.when(unequal, 2).otherwise(1), F.lit(n)) for i, n in enumerate(names)]
    diff = (
        F.when(F.col("r") == 0, F.array(F.lit(only_left)))
        .when(F.col("l") == 0, F.array(F.lit(only_right)))
        .otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    )
    out = fresh(keys, "diff")
    return by_key.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], F.explode(diff).alias(out))
