"""Messages as JSON lines: batch replay of a day, and a stream that commits each batch once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.facts import first_events
from ledgerloom.sources.versioned import VersionedTable

#: Wire formats: times are text and are cast, so that no session zone shifts them.
ORDER = "order_id bigint, user_id bigint, product_id bigint, amount decimal(10,2), order_time string, status string"
EVENT = "order_id bigint, user_id bigint, product_id bigint, amount decimal(10,2), order_time string, event_type string, event_time string"
CORRUPT = "_corrupt"


class Rejected(ValueError):
    """Messages that don't parse, or a source that can't be complete."""


def parse(lines: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema, and the text of messages that are no JSON object of it in `_corrupt`. Times become timestamps without zone, null where they aren't times."""
    parsed = lines.select(F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("m"), "value")
    kinds = T.StructType.fromDDL(schema)
    cols = [F.expr(f"try_cast(m.`{f.name}` AS timestamp_ntz)").alias(f.name) if f.name.endswith("_time") else F.col(f"m.`{f.name}`") for f in kinds.fields]
    return parsed.select(*cols, F.when(F.col("m").isNull(), F.col("value")).otherwise(F.col(f"m.{CORRUPT}")).alias(CORRUPT))


def read_topic(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All messages from the earliest on."""
    return parse(spark.read.text(path), schema)


def replay_orders(messages: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Order messages of a day by order_time, all copies, with dt."""
    rows = messages.filter(F.col(CORRUPT).isNull()).drop(CORRUPT).withColumn("dt", F.to_date("order_time"))
    return rows if day is None else rows.filter(F.col("dt") == F.lit(str(day)).cast("date"))


def replay_events(messages: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Event messages of a day by event_time, the earliest of each (dt, order_id, event_type)."""
    rows = messages.filter(F.col(CORRUPT).isNull()).drop(CORRUPT).withColumn("dt", F.to_date("event_time"))
    return first_events(rows if day is None else rows.filter(F.col("dt") == F.lit(str(day)).cast("date")))


def counters(messages: DataFrame) -> dict[str, int]:
    """Messages, rejected ones, those without user and with a negative amount; one pass, nothing written: a dry run."""
    return messages.agg(F.count("*").alias("raw"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected"), F.count_if(F.col(CORRUPT).isNull() & F.col("user_id").isNull()).alias("null_user"), F.count_if(F.col("amount") < 0).alias("negative")).first().asDict()


def ingest_stream(spark: SparkSession, path: str, schema: str, day_from: str, table: VersionedTable, checkpoint: str, writer: str, files_per_batch: int | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> Any:
    """Take what is new since the checkpoint and append it to the table, then stop; the streaming query is returned.

    A batch's number is committed with its rows, so one that is run again after a crash adds nothing. A message that doesn't parse
    fails the batch before anything is written. `dt` is the date of column `day_from`.
    """
    source = spark.readStream.format("text")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def commit(batch: DataFrame, number: int) -> None:
        if table.transaction(writer) >= number:
            return
        parsed = parse(batch, schema)
        bad = parsed.filter(F.col(CORRUPT).isNotNull()).limit(1).collect()
        if bad:
            raise Rejected(f"message that doesn't parse: {bad[0][CORRUPT][:200]}")
        rows = parsed.drop(CORRUPT).withColumn("dt", F.to_date(day_from))
        table.append(transform(rows) if transform else rows, (writer, number))

    query = source.load(path).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def taken(spark: SparkSession, checkpoint: str) -> set[str]:
    """The files that a stream with this checkpoint has taken, by its log: one name a file, as the log itself holds them."""
    log = f"{checkpoint}/sources/0"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return set()
    rows = spark.read.text(log).filter("value LIKE '{%'").select(F.get_json_object("value", "$.path").alias("p")).filter("p IS NOT NULL").distinct().collect()
    return {r["p"].rsplit("/", 1)[-1] for r in rows}


def lag(spark: SparkSession, path: str, checkpoint: str) -> dict[str, int]:
    """What of a folder of messages a stream hasn't taken yet: files and messages; and files that it took and that are gone since, which a reload couldn't get back."""
    per = {r["f"].rsplit("/", 1)[-1]: r["n"] for r in spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    known = taken(spark, checkpoint)
    open_ = {f: n for f, n in per.items() if f not in known}
    return {"files": len(open_), "messages": sum(open_.values()), "gone": len(known - per.keys())}


def guard_complete(spark: SparkSession, path: str, checkpoint: str, held: int) -> None:
    """Refuse a table that doesn't hold just the messages of the files its stream took, and a source that lost files."""
    found = lag(spark, path, checkpoint)
    if found["gone"]:
        raise Rejected(f"{found['gone']} files are gone from the source")
    messages = spark.read.text(path).count() - found["messages"]
    if held != messages:
        raise Rejected(f"the table holds {held} rows, the stream took {messages} messages")


def guard(messages: int, before: int, after: int, written: int) -> None:
    """Refuse an empty source and a table that didn't grow by just what was written."""
    if messages == 0:
        raise Rejected("the source is empty")
    if after - before != written:
        raise Rejected(f"the table grew by {after - before}, written were {written}")


def refresh_today(table: VersionedTable, computed: DataFrame, day: dt.date) -> int:
    """Overwrite one day's partition with what was computed for it; doing it again changes nothing but the version."""
    return table.overwrite_partitions(computed.filter(F.col("dt") == F.lit(str(day)).cast("date")), [str(day)])


def full_reload(table: VersionedTable, rows: DataFrame, keys: list[str]) -> int:
    """Upsert a whole re-read of the source; an empty one is refused."""
    if rows.isEmpty():
        raise Rejected("the source is empty")
    return table.upsert(rows, keys)
