"""Messages delivered more than once: one copy of each, from a stream with a keyed state store.

The state store is Spark's own, with one value for each identifier, on the JVM: an identifier is held from its first message until the watermark has
passed that message's event time by the delay, and then forgotten. State, offsets and the accepted messages are committed together,
batch by batch. Whatever the state didn't accept is looked up afterwards among all that was accepted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import new_path

#: What is known of a message: the state accepted it; an accepted one has its identifier; the state couldn't accept it (older than the watermark, or without a time) and no accepted one has its identifier.
NEW, SEEN, ASK = 0, 1, 2
#: Event time of messages without one.
NO_TIME = -(1 << 62)
#: State is kept on disk, in bounded memory, with a log of changes, so that a batch writes what it changed and not what there is.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@dataclass(frozen=True)
class Deliveries:
    """Every message of a stream, once: those that the state store accepted, and the rest. Both (identifier..., t, p): event time in microseconds (NO_TIME: none) and payload."""

    identifier: tuple[str, ...]
    accepted: DataFrame
    rest: DataFrame

    def told(self) -> DataFrame:
        """(identifier..., t, p, verdict) of every message; of those not accepted by lookup among all that was accepted, of whatever age. An identifier asks once, however often it came."""
        keys = list(self.identifier)
        known = self.rest.select(keys).distinct().join(self.accepted.select(keys).distinct(), keys, "left_semi").withColumn("known", F.lit(True))
        looked_up = self.rest.join(known, keys, "left").withColumn("verdict", F.when(F.col("known"), SEEN).otherwise(ASK)).drop("known")
        return self.accepted.withColumn("verdict", F.lit(NEW)).unionByName(looked_up)


def _keyed(messages: DataFrame, identifier: Sequence[str], event_time: str, payload: Column | None) -> DataFrame:
    """(identifier..., t, p, file, row): file and row are the place at which a message was delivered, the same whenever and by whomever its file is read."""
    time = F.coalesce(F.unix_micros(F.col(f"`{event_time}`").cast("timestamp")), F.lit(NO_TIME))
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return messages.select(*[F.col(f"`{c}`") for c in identifier], time.alias("t"), (payload if payload is not None else F.lit(None)).cast("string").alias("p"), *place)


def deliveries(
    stream: DataFrame, batch: DataFrame, identifier: Sequence[str], event_time: str, payload: Column | None = None, delay: str = "10 days", buckets: int | None = None, checkpoint: str | None = None,
) -> Deliveries:
    """Run the stream to its present end and return what became of its messages.

    stream: a streaming frame over Parquet files, without null identifiers. batch: the same rows as a batch frame, made before the stream runs, so that it has no file which the stream lacks.
    The state store accepts a message if it holds none of its identifier; it holds an identifier until the watermark (latest event time of earlier batches less `delay`) has passed its event time
    by `delay`. Messages that came too late for the state or have no event time aren't accepted and aren't lost: they are in the rest, as are copies. An identifier that was forgotten may be accepted
    again; one_copy and repeated() see that.
    A stream that is started again with its `checkpoint` goes on where it ended, whatever the session's settings are by then, as the number of state partitions (`buckets`, by default
    spark.sql.shuffle.partitions at the first start) is part of the checkpoint. A batch that was cut off is redone to the same effect.
    """
    spark = stream.sparkSession
    base = checkpoint or new_path(spark, "deliveries")
    timed = _keyed(stream, identifier, event_time, payload).filter(F.col("t") > NO_TIME)
    first = timed.withColumn("clock", F.timestamp_micros("t")).withWatermark("clock", delay).dropDuplicatesWithinWatermark(list(identifier)).drop("clock")
    with _set(spark, STATE_SETTINGS | ({"spark.sql.shuffle.partitions": str(buckets)} if buckets else {})):
        first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    accepted = spark.read.schema(first.schema).parquet(f"{base}/out") if _any_output(spark, f"{base}/out") else spark.createDataFrame([], first.schema)
    rest = _keyed(batch, identifier, event_time, payload).join(accepted.select("file", "row"), ["file", "row"], "left_anti")
    return Deliveries(tuple(identifier), accepted.drop("file", "row"), rest.drop("file", "row"))


class _set:
    """Settings of a session for a while."""

    def __init__(self, spark: SparkSession, settings: dict[str, str]) -> None:
        self.spark, self.settings = spark, settings

    def __enter__(self) -> None:
        self.held = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.held.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def _any_output(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not x.getPath().getName().startswith("_") for x in fs.listStatus(p))


def one_copy(d: Deliveries) -> DataFrame:
    """(identifier..., p, t, copies): one row for each identifier: of all its copies the one with the earliest event time, none being latest, then the smallest payload, null first; copies: all that came.

    Which copy is kept doesn't depend on batches or on what the state held. Copies are reduced before they move, so an identifier that came any number of times is a row a task.
    """
    best = F.min(F.struct((F.col("t") == NO_TIME).alias("none"), F.col("t").alias("t"), F.col("p").alias("p")))
    kept = d.accepted.unionByName(d.rest).groupBy(*d.identifier).agg(best.alias("m"), F.count("*").alias("copies"))
    return kept.select(*d.identifier, "m.p", "m.t", "copies")


def repeated(d: Deliveries) -> DataFrame:
    """(identifier...): those that came on more than one row: not accepted more than once, accepted again after they had been forgotten, or not accepted once and found among all that was accepted."""
    keys = list(d.identifier)
    rest = d.rest.groupBy(*keys).agg(F.count("*").alias("n"))
    # The lookup: each identifier of the rest, counted, meets the accepted messages of that identifier.
    both = rest.withColumn("taken", F.lit(0)).unionByName(d.accepted.select(*keys, F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("taken")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("taken").alias("taken")).filter((F.col("n") > 1) | (F.col("taken") > 1) | ((F.col("n") > 0) & (F.col("taken") > 0))).select(*keys)
