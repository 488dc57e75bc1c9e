"""History of changing attributes, built from full snapshots by Merkle comparison: at once, or appended to a history that is held."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import OPEN_END, differs, hash_pair
from ledgerloom.operators.snapdiff import latest_hashes
from ledgerloom.plans.joins import LOAD, MAP_BITS, bitmap, in_bitmap
from ledgerloom.plans.scratch import written
from ledgerloom.sources.versioned import VersionedTable

#: Each branch of the tree has 2**FANOUT_BITS children.
FANOUT_BITS = 4


def _leaf(key: Column, leaf_bits: int) -> Column:
    return F.pmod(F.xxhash64(key.isNull(), key), F.lit(1 << leaf_bits))


def _digests(children: DataFrame) -> DataFrame:
    """(s, node, d1, d2, n) from rows of (s, node, d1, d2, n); independent of their order."""
    return children.groupBy("s", "node").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))


def leaf_digests(reduced: DataFrame, leaf_bits: int) -> DataFrame:
    """(s, node, d1, d2, n) of every leaf of every snapshot. reduced: rows (s, k, top) as of latest_hashes."""
    k1, k2 = hash_pair([F.col("k"), F.col("top.h1"), F.col("top.h2")])
    return _digests(reduced.select("s", _leaf(F.col("k"), leaf_bits).alias("node"), k1.alias("d1"), k2.alias("d2"), F.lit(1).cast("bigint").alias("n")))


def _differing(digests: DataFrame) -> DataFrame:
    """(s, node) whose digest isn't that of the node's snapshot before, or that have none before."""
    w = Window.partitionBy("node").orderBy("s")
    same = F.lag("d1").over(w).eqNullSafe(F.col("d1")) & F.lag("d2").over(w).eqNullSafe(F.col("d2")) & F.lag("n").over(w).eqNullSafe(F.col("n"))
    return digests.select("s", "node", same.alias("same")).filter("NOT same").drop("same")


def descend(leaves: DataFrame, leaf_bits: int) -> DataFrame:
    """(s, leaf) of the key buckets whose content differs from that of their last snapshot, found from the root of the hash tree down; of a branch that doesn't differ nothing below is looked at.

    leaves: a written table of leaf digests. Each level is written once, from the level below, a sixteenth of it. A bucket without rows in a snapshot has no digest there and is compared across it.
    """
    levels, steps, bits = [leaves], [], leaf_bits
    while bits > 0:
        steps.append(min(FANOUT_BITS, bits))
        levels.append(written(_digests(levels[-1].withColumn("node", F.shiftright("node", steps[-1]))), "level"))
        bits -= steps[-1]
    found = written(_differing(levels[-1]), "differing")
    for digests, step in zip(reversed(levels[:-1]), reversed(steps)):
        parents = found.withColumnRenamed("node", "parent")
        below = digests.withColumn("parent", F.shiftright("node", step)).join(parents.select("parent").distinct(), "parent", "left_semi")
        found = written(_differing(below).withColumn("parent", F.shiftright("node", step)).join(parents, ["s", "parent"], "left_semi").drop("parent"), "differing")
    return found.withColumnRenamed("node", "leaf")


def _starts(touched: DataFrame) -> DataFrame:
    """(k, s, top) of rows at which a key's hashes differ from those of its row before. touched: (k, s, top, base); a base row is what is held of the key, and no start."""
    w = Window.partitionBy("k").orderBy("s", F.col("base").desc())
    new = differs(F.lag("top.h1").over(w), F.col("top.h1")) | differs(F.lag("top.h2").over(w), F.col("top.h2"))
    return touched.select("k", "s", "top", "base", new.alias("new")).filter("new AND NOT base").select("k", "s", "top")


def _identified(rows: DataFrame) -> DataFrame:
    i1, i2 = hash_pair([F.col("k"), F.col("s"), F.col("top.u"), F.col("top.h1"), F.col("top.h2")])
    return rows.withColumns({"i1": i1, "i2": i2})


def _with_attributes(delivered: DataFrame, starts: DataFrame, key: str, snapshot: str, version: str, tracked: Sequence[str], most: int = (1 << MAP_BITS) // LOAD) -> DataFrame:
    """(k, s, top, i1, i2, attrs) of every start. starts: written, identified.

    The rows are read again, and only those whose identity is in a bitmap of the starts' identities are moved. Beyond `most` starts there is a bitmap, and a scan of just
    its snapshots, for each group of snapshots with no more starts than that, so that the bitmap's size stays bounded; a single snapshot with more lets more other rows pass, and
    loses none.
    """
    h1, h2 = hash_pair([F.col(f"`{c}`") for c in tracked])
    attrs = F.struct(*[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(tracked)], F.lit(0).alias("a"))
    per = [(r["s"], r["count"]) for r in starts.groupBy("s").count().orderBy("s").collect()]  # one row a snapshot
    groups: list[list] = []
    room = 0
    for s, n in per:
        if not groups or n > room:
            groups.append([])
            room = most
        groups[-1].append((s, n))
        room -= n
    got = None
    for g in groups or [[]]:
        some, mine = delivered, starts
        if len(groups) > 1:
            some, mine = delivered.filter(F.col(f"`{snapshot}`").between(F.lit(g[0][0]), F.lit(g[-1][0]))), starts.filter(F.col("s").between(F.lit(g[0][0]), F.lit(g[-1][0])))
        full = _identified(some.select(F.col(f"`{snapshot}`").alias("s"), F.col(f"`{key}`").alias("k"), F.struct(F.col(f"`{version}`").alias("u"), h1.alias("h1"), h2.alias("h2")).alias("top"), attrs.alias("attrs"))).select("i1", "i2", "attrs")
        marked = in_bitmap(full, "i1", *bitmap(mine, "i1", sum(n for _, n in g)))
        # Repeated deliveries of a row that counts are equal in all that is kept: they are one row.
        one = marked.groupBy("i1", "i2").agg(F.first("attrs").alias("attrs")).join(mine, ["i1", "i2"])
        got = one if got is None else got.unionByName(one)
    return got


def _with_ends(starts: DataFrame, key: str, version: str, tracked: Sequence[str]) -> DataFrame:
    """The history from rows (k, s, u, a0...) of every version's start."""
    following = F.lead("s").over(Window.partitionBy("k").orderBy("s"))
    end = F.lit(OPEN_END).cast("date")
    return starts.withColumn("following", following).select(
        F.col("k").alias(key), F.col("s").alias("valid_from"), F.coalesce(F.date_sub("following", 1), end).alias("valid_to"), F.col("following").isNull().cast("int").alias("is_current"),
        *[F.col(f"a{i}").alias(c) for i, c in enumerate(tracked)], F.col("u").alias(version),
    )


def _flat(got: DataFrame, tracked: Sequence[str], *more: str) -> DataFrame:
    return got.select("k", "s", F.col("top.u").alias("u"), *[F.col(f"attrs.a{i}").alias(f"a{i}") for i in range(len(tracked))], *more)


def bits_for(n_keys: int, keys_per_leaf: int = 8) -> int:
    """Bits of a leaf's number, for about so many keys in a leaf."""
    return max(FANOUT_BITS, (max(1, n_keys // keys_per_leaf) - 1).bit_length())


def history_from_snapshots(rows: DataFrame, key: str, snapshot: str, version: str, tracked: Sequence[str], keys_per_leaf: int = 8, most: int = (1 << MAP_BITS) // LOAD) -> DataFrame:
    """(key, valid_from, valid_to, is_current, tracked..., version): the full history of every key, from all snapshots at once.

    Only hashes of the rows move at first. Keys are dealt to buckets, the leaves of a hash tree per snapshot; from the root down only branches that differ from
    the snapshot before are followed. Rows of changed leaves are compared key by key; rows that differ from the key's last row before start a version. Within an unchanged leaf no key
    can have changed, so a key's rows in its leaf's changed snapshots hold all its versions. The attributes are read again for version starts only (_with_attributes).

    A version starts on a key's first snapshot and on each later one with other tracked attributes (null equals null); it ends the day before
    the next one starts, the last on 9999-12-31 with is_current 1. Absence from snapshots ends nothing. Of several rows of a key in a snapshot the one with the
    latest `version` counts, of equal ones the one with the larger hash. Rows without a snapshot are left out; a null key is a key. An empty table has no history.
    """
    delivered = rows.filter(F.col(f"`{snapshot}`").isNotNull())
    reduced = written(latest_hashes(delivered, key, snapshot, version, tracked), "hashes")
    leaf_bits = bits_for(reduced.agg(F.approx_count_distinct("k")).first()[0], keys_per_leaf)
    leaves = written(leaf_digests(reduced, leaf_bits), "leaves")
    touched = reduced.withColumn("leaf", _leaf(F.col("k"), leaf_bits)).join(descend(leaves, leaf_bits), ["s", "leaf"], "left_semi")
    starts = written(_identified(_starts(touched.withColumn("base", F.lit(False)))), "starts")
    return _with_ends(_flat(_with_attributes(delivered, starts, key, snapshot, version, tracked, most), tracked), key, version, tracked)


class HeldHistory:
    """A history that is kept, and grows as snapshots come.

    Kept below `root`: the leaf digests of every snapshot, and the start of every version with its attributes. Starts are only ever appended, but for the keys of leaves that a snapshot
    delivered again changes. Ends follow from starts when the history is read. leaf_bits is fixed for good; bits_for() says how many a number of keys asks for.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, snapshot: str, version: str, tracked: Sequence[str], leaf_bits: int = 16) -> None:
        self.spark, self.key, self.snapshot, self.version, self.tracked, self.leaf_bits = spark, key, snapshot, version, list(tracked), leaf_bits
        self.digests, self.starts = VersionedTable(spark, f"{root}/digests", "s"), VersionedTable(spark, f"{root}/starts", "part")

    def days(self) -> list[dt.date]:
        m = self.digests.manifest()
        return sorted(dt.date.fromisoformat(p) for p in m["parts"]) if m else []

    def read(self) -> DataFrame:
        return _with_ends(self.starts.read(), self.key, self.version, self.tracked)

    def _delivered(self, rows: DataFrame, days: Sequence[dt.date] | None = None) -> DataFrame:
        c = F.col(f"`{self.snapshot}`")
        return rows.filter(c.isNotNull() if days is None else c.isin(*[F.lit(str(d)).cast("date") for d in days]))

    def _reduced(self, delivered: DataFrame) -> DataFrame:
        return latest_hashes(delivered, self.key, self.snapshot, self.version, self.tracked).withColumn("leaf", _leaf(F.col("k"), self.leaf_bits))

    def _stored(self, delivered: DataFrame, starts: DataFrame) -> DataFrame:
        got = _with_attributes(delivered, starts, self.key, self.snapshot, self.version, self.tracked).withColumns({"leaf": _leaf(F.col("k"), self.leaf_bits), "h1": F.col("top.h1"), "h2": F.col("top.h2")})
        return _flat(got, self.tracked, "h1", "h2", "leaf").withColumn("part", F.shiftright("leaf", max(0, self.leaf_bits - FANOUT_BITS)))

    def add(self, rows: DataFrame, days: Sequence[dt.date] | None = None) -> dict[str, int]:
        """Take in snapshots of `rows`, the table of all snapshots: `days`, or, if not given, those that aren't held. Days held already, or before the last held one, are taken as delivered again.

        New snapshots after the last: only their rows are read; their trees are compared with that of the last held snapshot and with each other; rows of changed leaves are compared with what is held of their keys, and new starts
        are appended. Days delivered again: their tree is compared with the tree kept for the day; the histories of the keys in changed leaves, and of no others, are made anew from all snapshots.
        Returns leaves compared key by key and starts written. Doing it again changes nothing.
        """
        held = self.days()
        if days is None:
            days = [r[0] for r in self._delivered(rows).select(self.snapshot).distinct().collect() if r[0] not in set(held)]
        later = sorted(d for d in set(days) if not held or d > held[-1])
        again = sorted(set(days) - set(later))
        out = {"leaves": 0, "starts": 0}
        if again:
            self._again(rows, again, out)
        if later:
            self._later(rows, held[-1] if held else None, later, out)
        return out

    def _later(self, rows: DataFrame, last: dt.date | None, days: list[dt.date], out: dict[str, int]) -> None:
        delivered = self._delivered(rows, days)
        reduced = written(self._reduced(delivered), "hashes")
        new = written(leaf_digests(reduced, self.leaf_bits), "leaves")
        before = None if last is None else self.digests.read(first=str(last), last=str(last))
        leaves = new if before is None else written(new.unionByName(before.select(new.columns)), "leaves")
        changed = written(descend(leaves, self.leaf_bits).filter(F.col("s").isin(*[F.lit(str(d)).cast("date") for d in days])), "changed")
        touched = reduced.join(changed, ["s", "leaf"], "left_semi").select("k", "s", "top", F.lit(False).alias("base"))
        if self.starts.manifest():
            # What is held of a key is its latest start, in the changed leaves only.
            of_leaves = self.starts.read().join(changed.select("leaf").distinct(), "leaf", "left_semi")
            current = of_leaves.groupBy("k").agg(F.max(F.struct("s", "u", "h1", "h2")).alias("t")).select("k", "t.s", F.struct("t.u", "t.h1", "t.h2").alias("top"), F.lit(True).alias("base"))
            touched = touched.unionByName(current)
        starts = written(_identified(_starts(touched)), "starts")
        out["leaves"] += changed.select("leaf").distinct().count()
        out["starts"] += starts.count()
        self.starts.append(self._stored(delivered, starts))
        self.digests.append(new)

    def _again(self, rows: DataFrame, days: list[dt.date], out: dict[str, int]) -> None:
        new = written(leaf_digests(self._reduced(self._delivered(rows, days)), self.leaf_bits), "leaves")
        signed = new.withColumn("sign", F.lit(1)).unionByName(self._of(days, new).withColumn("sign", F.lit(-1)))
        changed = written(signed.groupBy("s", "node", "d1", "d2", "n").agg(F.sum("sign").alias("net")).filter("net <> 0").select(F.col("node").alias("leaf")).distinct(), "changed")
        n = changed.count()
        if n:
            every = self._delivered(rows, sorted({*self.days(), *days}))
            mine = in_bitmap(every.withColumn("leaf", _leaf(F.col(f"`{self.key}`"), self.leaf_bits)), "leaf", *bitmap(changed, "leaf", n)).join(changed, "leaf", "left_semi").drop("leaf")
            starts = written(_identified(_starts(self._reduced(mine).select("k", "s", "top", F.lit(False).alias("base")))), "starts")
            self.starts.replace_keys(changed, ["leaf"], written(self._stored(mine, starts), "again"))
            out["leaves"] += n
            out["starts"] += starts.count()
        self.digests.overwrite_partitions(new, [str(d) for d in days])

    def _of(self, days: list[dt.date], like: DataFrame) -> DataFrame:
        held = self.digests.read().filter(F.col("s").isin(*[F.lit(str(d)).cast("date") for d in days])) if self.digests.manifest() else like.limit(0)
        return held.select(like.columns)
