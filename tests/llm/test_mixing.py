import random
from collections import defaultdict

import pytest

from ledgerloom.llm.mixing import mix

SIZED, TARGETS = "doc_id bigint, source string, tokens bigint", "mix_name string, source string, target_share double, max_repeats int"


def made(seed=3):
    r = random.Random(seed)
    docs = [(i, r.choice(["big"] * 8 + ["mid"] * 3 + ["small", None, "other"]), r.choice([0, 3, 5, 8, 20, None])) for i in range(600)]
    return docs, [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4), ("m", "absent", 0.1, 3), ("one", "mid", 1.0, 3), ("no", "absent", 1.0, 3)]


def test_shares_repeats_and_order(frame):
    docs, targets = made()
    order, shares = (x.collect() for x in mix(frame(SIZED, docs), frame(TARGETS, targets)))
    tokens, source = {d[0]: d[2] for d in docs}, {d[0]: d[1] for d in docs}
    total = defaultdict(int)
    for d in docs:
        total[d[1]] += d[2] or 0
    for name in ("m", "one"):
        mine = sorted((r for r in order if r.mix_name == name), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.finish <= b.finish for a, b in zip(mine, mine[1:]))
        share = {t[1]: t[2] for t in targets if t[0] == name and total[t[1]]}
        share = {k: v / sum(share.values()) for k, v in share.items()}
        most = {t[1]: t[3] for t in targets if t[0] == name}
        budget = min(most[s] * total[s] / w for s, w in share.items())
        used, so_far = defaultdict(int), 0
        for r in mine:
            assert r.tokens == tokens[r.doc_id] > 0 and r.source == source[r.doc_id]
            used[r.source] += r.tokens
            so_far += r.tokens
            # fair at every place: no source is more than the largest document of each source away from its share
            assert all(abs(used[s] - w * so_far) <= 20 * (len(share) + 1) for s, w in share.items())
        assert budget - 20 * len(share) <= so_far <= budget * (1 + 1e-6)
        times = defaultdict(list)
        for r in mine:
            times[r.doc_id].append(r.repeat)
        assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= most[source[d]] for d, v in times.items())
    assert not [r for r in order if r.mix_name == "no"]
    rows = {(r.mix_name, r.source): r for r in shares}
    assert len(rows) == len(targets) and rows["m", "absent"].used_tokens == 0 and rows["no", "absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in shares if r.mix_name == "m") - 1) < 1e-9
    assert rows["m", "small"].used_tokens == sum(r.tokens for r in order if (r.mix_name, r.source) == ("m", "small"))


def test_one_source_holds_nearly_everything(frame):
    docs = [(i, "hot" if i % 30 else "rare", 7) for i in range(3_000)]
    order, shares = mix(frame(SIZED, docs), frame(TARGETS, [("m", "hot", 0.5, 1), ("m", "rare", 0.5, 5)]))
    got = {r.source: r for r in shares.collect()}
    assert got["rare"].most_repeats == 5 and abs(got["hot"].actual_share - 0.5) < 0.01
    assert order.count() == 1_000


def test_empty_and_wrong_inputs(frame):
    docs, targets = made()
    order, shares = mix(frame(SIZED), frame(TARGETS, targets))
    assert order.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}
    order, shares = mix(frame(SIZED, docs), frame(TARGETS))
    assert order.count() == 0 and shares.count() == 0
    with pytest.raises(ValueError, match="twice"):
        mix(frame(SIZED, docs), frame(TARGETS, [*targets, targets[0]]))
