"""Joins whose cost is bounded whatever the size or skew of a side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import written

#: Rows up to which small() broadcasts; narrow rows are meant, some tens of MB at most.
BROADCAST_ROWS = 100_000
#: A bitmap of hashes has at most 2**MAP_BITS bits, 16 MB, whatever it marks: it may be broadcast. It has LOAD bits for each hash it marks, if that is within the bound.
MAP_BITS, LOAD = 27, 16


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, written once and counted: with a broadcast hint if there are at most `most`, else as they are, for a shuffle join."""
    kept = written(df, "small")
    return F.broadcast(kept) if kept.count() <= most else kept


def lookup_left(events: DataFrame, facts: DataFrame, keys: Sequence[str], counted: DataFrame, n: str, hot_rows: int = 1_000_000, pieces: int = 64) -> DataFrame:
    """Left join of events to facts, which hold one row per key at most, with hot keys spread.

    counted: keys and, in column `n`, how many events each has. Keys with more than `hot_rows` events, of which there can be no more than
    events / hot_rows, get `pieces` copies of their fact, and their events are dealt over the copies; all others join as they are.
    Null keys match nothing. Plain equality on the keys. The facts are never broadcast: how many there are isn't known, and the size of files or plans doesn't tell.
    """
    hot = counted.filter(F.col(n) > hot_rows).select(*keys)
    flagged = small(hot)
    if flagged.isEmpty():
        return events.join(facts.hint("merge"), list(keys), "left")
    mark = flagged.withColumn("__hot", F.lit(True))
    salted = events.join(mark, list(keys), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*events.columns), F.lit(pieces))).otherwise(F.lit(0).cast("bigint"))).drop("__hot")
    spread = facts.join(mark, list(keys), "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__hot")
    return salted.join(spread.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores. For costly work per row on a table of few files; a table with more partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def bitmap(hashes: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(block, words) and the number of bits: which hashes occur, as blocks of 4,096 bits; n: how many there are. No more than 2**MAP_BITS bits in all."""
    bits = min(MAP_BITS, max(12, (LOAD * max(1, n) - 1).bit_length()))
    at = hashes.select((F.col(column).bitwiseAND(F.lit((1 << bits) - 1))).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("v"))
    held = words.groupBy(F.shiftright("word", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int"), "v"))).alias("m"))
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint"))).alias("words")), bits


def in_bitmap(rows: DataFrame, column: str, marked: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash, in bigint column `column`, may be marked; none that is marked is lost."""
    low = f"(`{column}` & {(1 << bits) - 1}L)"
    hit = F.expr(f"shiftrightunsigned(__words[CAST(({low} >> 6) & 63 AS INT)], CAST({low} & 63 AS INT)) & 1 = 1")
    blocks = marked.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    return rows.withColumn("__block", F.expr(f"{low} >> 12")).join(F.broadcast(blocks), "__block").filter(hit).drop("__block", "__words")
