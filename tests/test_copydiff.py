from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators.copydiff import diff_copies

SCHEMA = "k bigint, d string, n bigint, x double, extra string"
FIELDS = {"n": 0, "x": 2}


def brute(left, right):
    """By dictionaries of rows, as the docstring says."""
    out = set()
    rows = lambda side, k: [r for r in side if r[:2] == k]
    cents = lambda v: None if v is None else Decimal(str(v)).quantize(Decimal("0.01"), "ROUND_HALF_UP") + 0
    for k in {r[:2] for r in left} | {r[:2] for r in right}:
        a, b = rows(left, k), rows(right, k)
        if not b:
            out.add((*k, "only_in_left"))
        elif not a:
            out.add((*k, "only_in_right"))
        else:
            if len(a) != len(b):
                out.add((*k, "row_count"))
            for i, f in ((2, "n"), (3, "x")):
                va, vb = ([repr(cents(r[i]) if f == "x" else r[i]) for r in s] for s in (a, b))
                if (sorted(va) != sorted(vb)) if len(a) == len(b) else (set(va) != set(vb)):
                    out.add((*k, f))
    return out


CELL = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["a", None]), st.sampled_from([0, 5, None]), st.sampled_from([0.0, 1.005, 1.01, 0.1 + 0.2, 0.3, None]), st.just("z"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CELL, max_size=8), st.lists(CELL, max_size=8))
def test_equals_brute_force(spark, left, right):
    got = diff_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k", "d"], FIELDS)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(left, right)


def test_types_may_differ_between_copies(frame, values):
    a = frame("k bigint, v decimal(18,2)", [(1, Decimal("109.91")), (2, Decimal("0.00")), (3, None)])
    b = frame("k bigint, v double", [(1, 109.91000000000001), (2, -0.001), (3, float("nan"))])
    assert values(diff_copies(a, b, ["k"], {"v": 2})) == [(3, "v")]


def test_empty_sides_and_clashing_names(frame, values):
    a = frame("diff bigint, f string, v string, sign int", [(1, "x", "p", 7), (1, "x", "p", 7)])
    none = frame("diff bigint, f string, v string, sign int")
    assert values(diff_copies(a, none, ["diff", "f"], ["v", "sign"])) == [(1, "x", "only_in_left")]
    assert values(diff_copies(none, none, ["diff"], ["v"])) == []
    assert diff_copies(a, none, ["diff"], ["v"]).columns == ["diff", "_diff"]


def test_hot_key_moves_little(spark, frame, values):
    a = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "'v' AS v")
    b = a.unionByName(frame("k bigint, v string", [(7, "v")]))
    assert values(diff_copies(a, b, ["k"], ["v"])) == [(7, "row_count")]


def test_keys_of_two_types(frame, values):
    a, b = frame("k decimal(10,1), v int", [(1.5, 1), (2, 2), (3, 3)]), frame("k decimal(12,2), v int", [(1.5, 1), (2, 9), (4, 4)])
    assert [(float(k), d) for k, d in values(diff_copies(a, b, ["k"], ["v"]))] == [(2.0, "v"), (3.0, "only_in_left"), (4.0, "only_in_right")]


def test_most_rows_of_one_key(frame, values):
    many = [(1, i % 5) for i in range(3_000)]
    assert values(diff_copies(frame("k int, v int", many), frame("k int, v int", many[::-1]), ["k"], ["v"])) == []
    assert values(diff_copies(frame("k int, v int", many), frame("k int, v int", [*many[1:], (1, 7)]), ["k"], ["v"])) == [(1, "v")]
