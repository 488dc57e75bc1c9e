import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.components import components, duplicate_classes, minhash_keys, near_links, shingles, words_of


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components_equal_union_find(frame, shape):
    r = random.Random(3)
    edges = {"random": [(r.randrange(80), r.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(50)] + [(90, 91), (91, 90), (7, 7)], "none": []}[shape]
    nodes = {n for u, v in edges if u != v for n in (u, v)}
    got = {x.node: x.root for x in components(frame("u bigint, v bigint", [*edges, (None, 1), (2, None)])).collect()}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])


def words(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def changed(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"x{r.randrange(400)}"
    return ws


def sets(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def alike(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) >= 0.8 * len(x | y)


def test_links_give_the_components_of_all_pairs(frame):
    """Groups of near-copies of different tightness, one of them a third of all texts; short texts; against brute force over all pairs."""
    r = random.Random(5)
    texts = []
    for size in (1, 2, 3, 8, 60, 1, 1):
        base = words(r, r.choice([60, 200, 400]))
        texts += [changed(r, base, r.choice([0, 1, 2, 4])) for _ in range(size)]
    texts += [words(r, r.randrange(0, 8)) for _ in range(60)] + [["hear", "hear"], ["hear", "hear", "hear"]]
    texts = list({tuple(t): t for t in texts}.values())
    df = frame("id bigint, t string", [(i, " ".join(t)) for i, t in enumerate(texts)]).withColumn("hashes", F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w)))
    got = near_links(df.select("id", F.explode(minhash_keys(F.col("hashes"))).alias("key")), lambda ids: df.join(ids, "id", "left_semi").select("id", shingles(F.col("hashes")).alias("set")))
    links = [(x.u, x.v) for x in got.collect()]
    assert all(alike(texts[u], texts[v]) for u, v in links) and len(links) == len(set(links))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and alike(texts[i], texts[j])]
    assert closure(range(len(texts)), links) == closure(range(len(texts)), pairs)
    assert len(links) < 0.7 * len(pairs)


def test_classes(frame):
    r = random.Random(6)
    base = words(r, 100)
    texts = [" ".join(base), "CORRIGENDUM " + " ".join(base), " ".join(base), "hear hear", "hear hear", None, "", "...", "one two three", None, " ".join(words(r, 100)), "Hear, hear!"]
    reissues = {8: 3, 9: 10, 10: 999}
    rows = [(i, reissues.get(i), t) for i, t in enumerate(texts)] + [(0, None, texts[0])]
    got = {x.doc_id: x.cluster for x in duplicate_classes(frame("doc_id bigint, reissue_of bigint, text string", rows)).collect()}
    # A reissue of a copy is of the copy's class; a null text that names a reissue too; texts equal but for case and marks are near-duplicates.
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 8: 3, 11: 3, 5: 5, 6: 6, 7: 7, 9: 9, 10: 9}
    assert duplicate_classes(frame("doc_id bigint, reissue_of bigint, text string")).count() == 0


def test_a_text_longer_than_a_piece(frame):
    long = " ".join(f"w{i}" for i in range(12_000))
    rows = [(1, None, long), (2, None, long + " more"), (3, None, "w1 w2 w3 w4 w5")]
    assert {x.doc_id: x.cluster for x in duplicate_classes(frame("doc_id bigint, reissue_of bigint, text string", rows)).collect()} == {1: 1, 2: 1, 3: 3}
