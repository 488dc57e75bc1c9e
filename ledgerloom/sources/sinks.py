"""Text and JDBC endpoints, and a runner for files of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_text(df: DataFrame, separator: str = "\t", null: str = "\\N") -> DataFrame:
    """One column `value`: the row's values with a separator between them, nulls as `null`; numbers as they are, without grouping."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns]).alias("value"))


def write_text(df: DataFrame, path: str, rows_per_file: int = 60_000) -> None:
    """The rows as text files of at most `rows_per_file` lines; a folder that exists is an error, so a batch isn't loaded twice under one name."""
    as_text(df).write.option("maxRecordsPerFile", rows_per_file).mode("error").text(path)


def read_jdbc(spark: SparkSession, url: str, select: str, **options: str) -> DataFrame:
    """The rows of a SELECT that the database runs. The driver's jar must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", select).options(**options).load()


def run_statements(spark: SparkSession, text: str) -> int:
    """Run each statement of a file; comments to the end of a line and empty statements are left out. Semicolons within quotes don't end a statement."""
    statements, current, quote = [], "", ""
    for line in text.splitlines():
        at = 0
        while at < len(line):
            c = line[at]
            if not quote and line.startswith("--", at):
                break
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            if c == ";" and not quote:
                statements.append(current)
                current = ""
            else:
                current += c
            at += 1
        current += "\n"
    statements.append(current)
    todo = [s for s in statements if s.strip()]
    for s in todo:
        spark.sql(s)
    return len(todo)
