"""Daily full snapshots as CSV files, the day in the file name."""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.versioned import VersionedTable

#: Fixed format of a product snapshot file and of its name.
COLUMNS = "product_id bigint, product_name string, category string, brand string, price decimal(10,2), status string, update_time timestamp_ntz"
NAME = r"product_snapshot_(\d{8})\.csv"


class Malformed(ValueError):
    """A file whose name or header isn't as agreed."""


def day_of(path: str) -> dt.date:
    m = re.search(NAME + "$", path)
    if not m:
        raise Malformed(f"no day in the name {path}")
    return dt.datetime.strptime(m[1], "%Y%m%d").date()


def in_range(paths: Sequence[str], first: dt.date | None = None, last: dt.date | None = None) -> list[str]:
    """The files of a closed range of days."""
    return sorted(p for p in paths if (first is None or day_of(p) >= first) and (last is None or day_of(p) <= last))


def load_snapshots(spark: SparkSession, paths: Sequence[str], columns: str = COLUMNS) -> DataFrame:
    """The rows with snapshot_date, from the name of each file, or of the folder of files, of a day. Every header is checked first; a value that doesn't fit its declared type fails the job."""
    kinds = T.StructType.fromDDL(columns)
    # The first line of every file, in one job; a file's first line is the row that its reader numbers first.
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n"))
    heads = {r["f"]: r["value"] for r in lines.filter("at = 0").groupBy("f").agg(F.min_by("value", "n").alias("value")).collect()}
    for p in paths:
        day_of(p)
    for p, h in heads.items():
        got = next(csv.reader([h]))
        if missing := [c for c in kinds.names if c not in got]:
            raise Malformed(f"{p} lacks {missing}")
        if got != kinds.names:
            raise Malformed(f"{p} has {got}, expected {kinds.names}")
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), NAME, 1), "yyyyMMdd")
    rows = spark.read.schema(kinds).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(list(paths))
    return rows.select("*", day.alias("snapshot_date"))


def store_snapshots(table: VersionedTable, snapshots: DataFrame, days: Sequence[dt.date]) -> int:
    """Replace the days' partitions, then compare the rows held with the rows read; a mismatch is an error."""
    version = table.overwrite_partitions(snapshots, [str(d) for d in days])
    m = table.manifest(version)
    held = sum(d["rows"] for x in days for d in m["parts"].get(str(x), []))
    read = snapshots.count()
    if held != read:
        raise Malformed(f"read {read} rows, hold {held}")
    return version
