"""Connected components, and classes of near-duplicate documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import hash_pair
from ledgerloom.plans.joins import bitmap, in_bitmap, small
from ledgerloom.plans.scratch import written

#: Words of a shingle, and the similarity of near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: MinHash: BANDS tables, whose keys are ROWS minima each. Of pairs at SIMILARITY less than one in two thousand shares no key.
BANDS, ROWS = 20, 5


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (u, v) the smallest node it is connected with; roots themselves included.

    Alternating star operations: every node hands its larger neighbours, then all smaller ones, to the smallest one it knows; a round is two shuffles over the edges left, written out, and the
    number of rounds grows with the logarithm of the components' size. No component is ever held in one task. Loops and repeated edges do no harm; null nodes are left out.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        after = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        signed = after.withColumn("n", F.lit(1)).unionByName(e.withColumn("n", F.lit(-1)))
        if signed.groupBy("u", "v").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = after


def words_of(text: Column) -> Column:
    """Lower-case words of a text, without punctuation, as an array; empty for null."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\d]+", " ")), " "), lambda w: w != "")


def shingles(hashes: Column) -> Column:
    """The set of shingles of an array of word hashes, as an array of hashes; a text of fewer words is one shingle."""
    n = F.size(hashes)
    # Shifted copies side by side: the array is made WORDS times, not once for each shingle.
    beside = F.arrays_zip(*[F.slice(hashes, 1 + i, F.greatest(n, F.lit(1))) for i in range(WORDS)])
    return F.array_distinct(F.transform(F.slice(beside, 1, F.greatest(n - (WORDS - 1), F.lit(1))), lambda x: F.xxhash64(x)))


def minhash_keys(hashes: Column) -> Column:
    """The keys of an array of word hashes in all tables, the table's number in each; none for an array without words or a null one."""
    rng = np.random.default_rng(20240301)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def keys(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in arrays:
            out = np.empty(len(s), dtype=object)
            for i, h in enumerate(s):
                out[i] = _keys(np.asarray([] if h is None else h, dtype=np.int64).view(np.uint64), a, b)
            yield pd.Series(out, dtype="object")

    return keys(hashes)


def _keys(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        s = s * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] if i < len(h) else np.uint64(0))
    s ^= s >> np.uint64(29)
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, n, 4_096):  # a long text in pieces
        v = s[i : i + 4_096, None] * a + b
        least = np.minimum(least, v.min(axis=0))
    key = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return (key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def near_links(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float = SIMILARITY) -> DataFrame:
    """(u, v): links between different texts whose sets of word shingles have a Jaccard similarity of at least `least`, verified exactly.

    keys: (id, key), a row for each MinHash key of a text. sets_of: gives (id, set), the shingles of the texts whose id is in the frame it is handed: those that share a key with another.
    Texts that share a key meet through pivots: the smallest text under a key becomes one and meets all others under the key; of those that aren't linked to it the four smallest become pivots next, then sixteen, and so on, until
    every one is a pivot or linked to one. So a group of texts alike is worked through by one text, not by all pairs, and a key under which texts differ by those that differ; each pair is verified once, whatever number of keys it shares.
    Two texts that a pivot is linked to both are of one component without being compared. A link between a text that was linked early and one that wasn't is missed under that key only if no pivot shows it; the texts have up to BANDS keys.
    """
    keys = written(keys, "keys")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = written(keys.join(shared, "key", "left_semi"), "members")
    sets = written(sets_of(written(members.select("id").distinct(), "involved")), "sets")
    open_, judged, most = members, None, 1
    while not open_.isEmpty():
        rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        pivots = written(open_.withColumn("rank", rank).filter(F.col("rank") <= most).select("key", F.col("id").alias("pivot")), "pivots")
        pairs = members.join(pivots, "key").filter("id <> pivot").select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["u", "v"], "left_anti")
        both = small(pairs).join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
        common = both.select("u", "v", F.size("x").alias("a"), F.size("y").alias("b"), F.size(F.array_intersect("x", "y")).alias("c"))
        new = common.select("u", "v", (F.col("c") >= F.lit(least) * (F.col("a") + F.col("b") - F.col("c"))).alias("linked"))
        # One table of all pairs judged so far, so that plans don't grow with the rounds.
        judged = written(new if judged is None else judged.unionByName(new), "judged")
        linked = judged.filter("linked")
        either = linked.select(F.col("u").alias("pivot"), F.col("v").alias("id")).unionByName(linked.select(F.col("v").alias("pivot"), F.col("u").alias("id")))
        done = open_.join(pivots, "key").join(either, ["id", "pivot"], "left_semi").select("key", "id").unionByName(pivots.select("key", F.col("pivot").alias("id")))
        open_ = written(open_.join(done, ["key", "id"], "left_anti"), "open")
        most *= 4
    return judged.filter("linked").select("u", "v") if judged is not None else members.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)


def duplicate_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, cluster): documents of one class have equal texts, or are, over any number of steps, reissues (`reissue_of`) or near-duplicates of each other; cluster is the class's smallest doc_id.

    Equal texts are told by two hashes and are one text before anything is compared. Null texts and texts without words are a class each, unless a reissue links them. A reissue_of that no document has links documents that name it.
    """
    h1, h2 = hash_pair([F.col("text")])
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    docs = written(documents.select("doc_id", "reissue_of", F.when(F.length("text") > 0, F.struct(h1.alias("a"), h2.alias("b"))).alias("hash"), minhash_keys(hashes).alias("keys")), "docs")
    texts = docs.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))

    def sets_of(involved: DataFrame) -> DataFrame:
        # Texts are read again, and only those that share a key are cut into shingles; none is moved.
        some = in_bitmap(documents.select("doc_id", "text").withColumn("h", F.xxhash64("doc_id")), "h", *bitmap(involved.select(F.xxhash64("id").alias("h")), "h", involved.count())).drop("h")
        return some.select(F.col("doc_id").alias("id"), shingles(hashes).alias("set")).join(involved, "id", "left_semi").dropDuplicates(["id"])

    # Only texts that occur more than once move again.
    equal = docs.filter("hash IS NOT NULL").join(docs.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).filter("n > 1").select("hash", "v"), "hash").select(F.col("doc_id").alias("u"), "v")
    edges = near_links(texts.select("id", F.explode("keys").alias("key")), sets_of).unionByName(equal).unionByName(docs.filter("reissue_of IS NOT NULL").select(F.col("doc_id").alias("u"), F.col("reissue_of").alias("v")))
    roots = components(edges).withColumnRenamed("node", "doc_id")
    return docs.select("doc_id").distinct().join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster"))
