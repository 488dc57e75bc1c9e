import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.prefix import range_sorted, running_sums
from ledgerloom.operators.profile import profile_loads



def patterns():
    return {"n": {"negative": F.col("num") < 0}, "s": {"odd": ~F.col("txt").isin("a", "b")}}


def brute(rows, qs=(0.25, 0.5, 0.75)):
    out = {}
    loads = sorted({r[0] for r in rows}, key=lambda d: (d is not None, d or dt.date.min))
    for c, i in (("n", 1), ("s", 2)):
        before = None
        for load in loads:
            every = [r[i] for r in rows if r[0] == load]
            v = [x for x in every if x is not None]
            put = lambda m, x: out.__setitem__((load, c, m), x)  # noqa: B023, E731
            put("rows", len(every)), put("null_rate", (len(every) - len(v)) / len(every)), put("distinct", len(set(v)))
            if v:
                put("distinct_rate", len(set(v)) / len(v)), put("top_share", max(Counter(v).values()) / len(v))
                if c == "n":
                    put("negative", sum(x < 0 for x in v) / len(v)), put("min", min(v)), put("max", max(v))
                    for q in qs:
                        s = sorted(v)
                        put(f"q{q:g}", next(x for k, x in enumerate(s, 1) if k >= q * len(s)))
                else:
                    put("odd", sum(x not in ("a", "b") for x in v) / len(v))
                if before:
                    put("ks", max(abs(sum(x <= p for x in v) / len(v) - sum(x <= p for x in before) / len(before)) for p in set(v) | set(before)))
            before = v
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(frame, seed):
    r = random.Random(seed)
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)] + [None]
    rows = [(r.choice(days), r.choice([None, -3, 0, 1, 1, 2, 9, 40]), r.choice([None, "a", "b", "ä", "", "long " * 2000])) for _ in range(300)]
    got = profile_loads(frame("load date, n bigint, s string", rows), "load", ["n", "s"], patterns())
    listed = got.collect()
    found = {(x["load"], x["column_name"], x["metric"]): x["value"] for x in listed}
    assert len(found) == len(listed)
    want = brute(rows)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_all_null_column_and_empty_table(frame):
    df = frame("load date, n bigint, s string", [(dt.date(2024, 1, 1), None, "a")])
    got = {(x["column_name"], x["metric"]): x["value"] for x in profile_loads(df, "load", ["n", "s"], patterns()).collect()}
    assert got["n", "null_rate"] == 1 and got["n", "distinct"] == 0 and ("n", "negative") not in got and got["s", "odd"] == 0
    assert profile_loads(df.limit(0), "load", ["n"], patterns()).count() == 0


def test_clashing_column_names(frame):
    df = frame("pair date, num bigint, txt string, i int, c int", [(dt.date(2024, 1, 1), 5, "a", 1, 2)])
    got = {(x["column_name"], x["metric"]): x["value"] for x in profile_loads(df, "pair", ["num", "txt"], {}).collect()}
    assert got["num", "max"] == 5 and got["txt", "distinct"] == 1


def test_running_sums_over_a_group_that_spans_all_partitions(spark):
    df = spark.range(5_000).selectExpr("if(id < 4000, 'hot', concat('g', id % 7)) AS g", "id AS o", "id % 5 AS v")
    got = running_sums(range_sorted(df, ["g", "o"], 8), ["g"], ["v"]).toPandas().sort_values(["g", "o"])
    assert (got["v_run"] == got.groupby("g")["v"].cumsum()).all()
    assert len(got) == 5_000
    assert running_sums(range_sorted(df.limit(0), ["g", "o"], 8), ["g"], ["v"]).count() == 0
