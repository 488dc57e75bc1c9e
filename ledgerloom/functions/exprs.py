"""Column expressions shared by operators. All are built from JVM functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Open end of a validity period.
OPEN_END = "9999-12-31"


def hash_pair(cols: Sequence[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values. A null is hashed as such: (null, 'a') and ('a', null) differ."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(-7046029254386353131), *marked)


def day(c: Column) -> Column:
    """A date as a string yyyy-MM-dd."""
    return F.date_format(c, "yyyy-MM-dd")


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: null equals null and differs from everything else."""
    return ~a.eqNullSafe(b)


def cell_text(df: DataFrame, name: str, scale: int | None) -> Column:
    """The value as text, numbers with a scale rounded half up to it. NaN, infinities and numbers too large for a decimal keep their own text."""
    c = F.col(name)
    kind = df.schema[name].dataType
    if scale is None or not isinstance(kind, (T.NumericType,)):
        return c.cast("string")
    exact = F.expr(f"try_cast(`{name}` AS DECIMAL(38,{scale}))")
    # -0.00 and 0.00 are the same amount; decimals have no signed zero.
    return F.coalesce(exact.cast("string"), c.cast("string"))


def fresh(taken: Sequence[str], wanted: str) -> str:
    """`wanted`, with underscores before it as long as a column of that name (in any case) exists."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted
