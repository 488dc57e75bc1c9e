import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing
from ledgerloom.llm.packing import best_fit, fill_containers

ITEM = st.tuples(st.integers(1, 20), st.integers(-1, 3), st.integers(0, 2))


def naive(items, capacity, apart):
    """Look at every bin; take the tightest compatible one, of equals one without the item's source, of these the first."""
    bins, out = [], []
    for size, cluster, source in items:
        ok = [
            (b["left"], source in b["sources"], i) for i, b in enumerate(bins)
            if b["left"] >= size and (cluster < 0 or cluster not in b["clusters"]) and not any({source, s} in apart for s in b["sources"])
        ]
        i = min(ok)[2] if ok else len(bins)
        if not ok:
            bins.append({"left": capacity, "clusters": set(), "sources": set()})
        bins[i]["left"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"].add(source)
        out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEM, max_size=40), st.integers(20, 40), st.sampled_from([(), ((0, 1),), ((0, 1), (1, 2))]))
def test_best_fit_takes_the_tightest_compatible_bin(items, capacity, apart):
    got = best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], capacity, apart)
    assert got == naive(items, capacity, [set(p) for p in apart])


def checked(placed, items, specs, apart=()):
    """Every rule of the docstring but tightness, on the result's rows."""
    held, where = defaultdict(list), defaultdict(list)
    info = {i[0]: i for i in items}
    for r in placed:
        where[r.spec_id, r.doc_id].append(r)
        if r.container is not None:
            held[r.spec_id, r.container].append(r)
    assert set(where) == {(s, i[0]) for s, c in specs if c and c >= 1 for i in items}
    for (s, d), rows in where.items():
        tokens, capacity = info[d][3] or 0, dict(specs)[s]
        assert sum(r.tokens for r in rows) == tokens
        assert len(rows) == max(1, -(-tokens // capacity)) and sorted(r.piece for r in rows) == list(range(len(rows)))
        assert (rows[0].container is None) == (tokens == 0)
    for (s, c), rows in held.items():
        assert sum(r.tokens for r in rows) == rows[0].fill <= rows[0].capacity
        clusters = [info[r.doc_id][2] for r in rows if info[r.doc_id][2] is not None]
        assert len(clusters) == len(set(clusters))
        assert not any({info[a.doc_id][1], info[b.doc_id][1]} == set(p) for a in rows for b in rows for p in apart)
    return held


ITEMS = "doc_id bigint, source string, cluster bigint, tokens bigint"
SPECS = "spec_id int, capacity_tokens int"


@pytest.mark.parametrize("apart", [(), (("a", "b"),)])
@pytest.mark.parametrize("group_items", [25_000, 40])
def test_rules_and_fill(frame, apart, group_items):
    r = random.Random(7)
    items = [(i, r.choice(["a", "b", "c", None]), r.choice([None, None, None, i % 9]), r.choice([0, 1, 3, 5, 8, 13, 30, 90, 250, None])) for i in range(400)]
    specs = [(1, 64), (2, 200), (3, None), (4, 0)]
    placed = fill_containers(frame(ITEMS, items), frame(SPECS, specs), apart, group_items=group_items).collect()
    held = checked(placed, items, specs, apart)
    for s, capacity in specs[:2]:
        fills = [rows[0].fill for (x, _), rows in held.items() if x == s]
        assert sum(fills) / (len(fills) * capacity) > 0.97 if not apart else True


def test_a_third_of_all_items_in_one_cluster(frame):
    items = [(i, "a", 1 if i % 3 == 0 else None, 4) for i in range(300)]
    held = checked(fill_containers(frame(ITEMS, items), frame(SPECS, [(1, 12)])).collect(), items, [(1, 12)])
    assert len(held) == 100


def test_more_capacities_than_a_list_holds(frame, monkeypatch):
    monkeypatch.setattr(packing, "SPECS", 2)
    items, specs = [(i, "a", None, i % 7) for i in range(20)], [(i, 10 + i) for i in range(5)]
    checked(fill_containers(frame(ITEMS, items), frame(SPECS, specs)).collect(), items, specs)


def test_empty_items_and_specs(frame):
    assert fill_containers(frame(ITEMS), frame(SPECS, [(1, 5)])).count() == 0
    assert fill_containers(frame(ITEMS, [(1, "a", None, 5)]), frame(SPECS)).count() == 0
