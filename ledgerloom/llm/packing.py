"""Filling fixed-capacity containers with items."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.joins import small
from ledgerloom.plans.scratch import written

#: Items packed by one call of best_fit at most, on average.
GROUP_ITEMS = 25_000
#: Capacities in one list of a plan.
SPECS = 1_000


def best_fit(sizes: Sequence[int], clusters: Sequence[int], sources: Sequence[int], capacity: int, apart: Iterable[tuple[int, int]] = ()) -> list[int]:
    """The bin of each item, items given in the order in which they are placed.

    Bins are ordered by residual. A bitmap says which residuals occur; the search starts at the item's size and goes to the next larger residual
    until a compatible bin is found, which then is the tightest. A bin is compatible if its bitmap of duplicate clusters lacks the item's
    cluster and its bitmap of sources has none from which the item's source is to be kept `apart`. Both are kept by column: for
    each cluster or source a bitmap of the bins that hold it, so one operation tests all bins of a residual. Negative clusters conflict with none.
    Of equally tight bins one that doesn't hold the item's source yet is taken, else the first: sources are mixed as far as that costs no space.
    """
    at_residual: dict[int, int] = {}
    residuals = 0  # bit r: some bin has residual r
    with_cluster: dict[int, int] = {}
    with_source: dict[int, int] = {}
    foes: dict[int, list[int]] = {}
    for a, b in apart:
        foes.setdefault(a, []).append(b)
        foes.setdefault(b, []).append(a)
    bins: list[int] = []  # residuals
    out = []
    for size, cluster, source in zip(sizes, clusters, sources):
        barred = with_cluster.get(cluster, 0) if cluster >= 0 else 0
        for foe in foes.get(source, ()):
            barred |= with_source.get(foe, 0)
        higher = residuals >> size
        r, chosen = size, -1
        while higher:
            step = (higher & -higher).bit_length() - 1
            r += step
            fit = at_residual[r] & ~barred
            if fit:
                other = fit & ~with_source.get(source, 0) or fit
                chosen = (other & -other).bit_length() - 1
                break
            higher >>= step + 1
            r += 1
        if chosen < 0:
            chosen = len(bins)
            bins.append(capacity)
        else:
            at_residual[r] &= ~(1 << chosen)
            if not at_residual[r]:
                del at_residual[r]
                residuals &= ~(1 << r)
        left = bins[chosen] - size
        bins[chosen] = left
        at_residual[left] = at_residual.get(left, 0) | 1 << chosen
        residuals |= 1 << left
        if cluster >= 0:
            with_cluster[cluster] = with_cluster.get(cluster, 0) | 1 << chosen
        with_source[source] = with_source.get(source, 0) | 1 << chosen
        out.append(chosen)
    return out


def _round(items: DataFrame, number: int, apart: Sequence[tuple[str, str]], group_items: int) -> DataFrame:
    """Items with container and fill, packed in groups of bounded size."""
    # Groups are by count, dealt at random: every group has the same mixture of sizes, and their number grows with the items.
    per_spec = small(items.groupBy("spec_id").agg(F.ceil(F.count("*") / group_items).cast("int").alias("groups")))
    dealt = items.join(per_spec, "spec_id").withColumn("grp", F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece"), F.col("groups")).cast("int")).drop("groups")
    names = sorted({x for pair in apart for x in pair})
    code = {n: i for i, n in enumerate(names)}
    kept_apart = [(code[a], code[b]) for a, b in apart]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        known, _ = pd.factorize(frame["cluster"])
        frame["known"] = np.where(np.bincount(known)[known] > 1, known, -1)
        # Items with conflicts go first, while there is room for each of them in another bin; then the rest, largest first.
        frame["free"] = frame["known"] < 0
        frame = frame.sort_values(["free", "size", "doc_id", "piece"], ascending=[True, False, True, True], kind="stable", ignore_index=True)
        clusters = frame["known"].tolist()
        # Sources that are kept apart have the numbers that kept_apart names.
        others = {x: len(code) + i for i, x in enumerate(sorted({x for x in frame["source"].dropna() if x not in code}))}
        sources = [code.get(x, others.get(x, -1)) for x in frame["source"].where(frame["source"].notna(), None)]
        capacity = int(frame["capacity"].iloc[0])
        frame["bin"] = best_fit(frame["size"].tolist(), clusters, sources, capacity, kept_apart)
        frame["fill"] = frame.groupby("bin")["size"].transform("sum")
        frame["container"] = f"{number}-{frame['grp'].iloc[0]}-" + frame["bin"].astype(str)
        return frame[["spec_id", "capacity", "doc_id", "piece", "source", "cluster", "size", "container", "fill"]]

    return dealt.groupBy("spec_id", "grp").applyInPandas(pack, "spec_id int, capacity int, doc_id bigint, piece int, source string, cluster bigint, size bigint, container string, fill bigint")


def fill_containers(items: DataFrame, specs: DataFrame, apart: Sequence[tuple[str, str]] = (), loose: float = 0.01, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(spec_id, doc_id, piece, tokens, container, fill, capacity): where each item goes for each capacity.

    items: doc_id, source, cluster (of duplicates; null: none), tokens. specs: spec_id, capacity_tokens.
    An item larger than the capacity is split: pieces of exactly the capacity, each a full container, and a rest that is packed like an item. No other item is split.
    Items with the same cluster never share a container, nor do sources that `apart` names as pairs. Items are dealt to groups of bounded size, each packed by best fit,
    those with conflicts first, then largest first. Items of containers with more than a share `loose` unused are packed once more, by best fit over the groups together: fewer, again bounded groups;
    that result stands where it needs no more containers than they had.
    Items without tokens, or with null tokens, need no container: tokens 0, container and fill null. A spec with null capacity or one below 1 is left out.
    Repeated doc_ids are items of their own but for their order. Null sources are a source. Empty items or specs: an empty result.
    """
    listed = specs.filter("capacity_tokens >= 1").select(F.col("spec_id").cast("int"), F.col("capacity_tokens").cast("int")).distinct().toLocalIterator()
    each = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("cluster"), F.xxhash64(F.lit("none"), "doc_id")).alias("cluster"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    # Sizes are counted once, before a document is listed for each capacity.
    # Each item is listed for each capacity, of which a plan takes SPECS at a time.
    sizes, paired = written(each, "sizes"), None
    while (some := list(islice(listed, SPECS))) or paired is None:
        wanted = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).alias("capacity")) for s, c in some]) if some else F.expr("CAST(array() AS array<struct<spec_id:int,capacity:int>>)")
        part = sizes.select("*", F.inline(wanted))
        paired = part if paired is None else paired.unionByName(part)
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = F.col("tokens") % F.col("capacity")
    full = paired.filter("tokens >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1))).select("spec_id", "doc_id", "piece", F.col("capacity").cast("bigint").alias("tokens"), F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.col("capacity").cast("bigint").alias("fill"), "capacity")
    open_items = paired.withColumns({"size": rest, "piece": whole}).filter("size > 0").select("spec_id", "capacity", "doc_id", "piece", "source", "cluster", "size")
    none = paired.filter("tokens <= 0").select("spec_id", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("fill"), "capacity")
    first = written(_round(open_items, 1, apart, group_items), "packed")
    is_loose = F.col("capacity") - F.col("fill") > F.lit(loose) * F.col("capacity")
    again = written(_round(first.filter(is_loose).drop("container", "fill"), 2, apart, group_items), "repacked")
    used = lambda df, n: df.groupBy("spec_id").agg(F.count_distinct("container").alias(n))
    better = small(used(again, "later").join(used(first.filter(is_loose), "before"), "spec_id").select("spec_id", (F.col("later") <= F.col("before")).alias("better")))
    kept = first.join(better, "spec_id", "left").filter(~is_loose | ~F.coalesce("better", F.lit(False))).drop("better")
    moved = again.join(better.filter("better"), "spec_id", "left_semi")
    packed = kept.unionByName(moved).select("spec_id", "doc_id", "piece", F.col("size").alias("tokens"), "container", "fill", "capacity")
    return packed.unionByName(full).unionByName(none)
