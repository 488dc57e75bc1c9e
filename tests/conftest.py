from decimal import Decimal

import pytest
from pyspark.sql import types as T

from ledgerloom.plans.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, memory="3g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def frame(spark):
    """frame("a bigint, b string", rows): a small frame; numbers become decimals where the schema says so."""

    def made(schema, rows=()):
        kinds = T.StructType.fromDDL(schema)
        money = [isinstance(f.dataType, T.DecimalType) for f in kinds.fields]
        return spark.createDataFrame([tuple(Decimal(str(v)) if m and v is not None else v for v, m in zip(r, money)) for r in rows], kinds)

    return made


@pytest.fixture
def values():
    """The rows of a frame as sorted tuples, dates as text."""

    def listed(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in r) for r in df.collect()), key=repr)

    return listed
