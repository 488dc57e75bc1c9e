"""Near-duplicates by partitioned SimHash tables and trigrams, and the labels that spread over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.joins import BROADCAST_ROWS, bitmap, in_bitmap, small
from ledgerloom.plans.scratch import written

#: A SimHash has 128 bits, of which each table takes a block of 16 as its key. Who asks looks up, in each table, its own key and those that differ from it in one or two of its UNSURE least certain bits.
BITS, TABLES, UNSURE = 128, 8, 7
WIDTH = BITS // TABLES
GRAM = 3
#: Trigrams worked on at a time.
CHUNK = 1 << 19
#: Rows of a table under one key from which on they are dealt to pieces, each of so many.
HOT_KEY = 500_000
#: Of those who ask under one key about so many go first; the others meet only the rows that these left unlabelled.
FIRST = 8

#: For each value of a byte a number with one byte for each of its bits, so that eight counters are added at once.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64: every bit of the result depends on every bit of the input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character trigrams of the padded texts, text after text, and how many each has. A text shorter than that is padded with blanks."""
    padded = [f" {t} " if t else "   " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in padded])
    h = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(1_000_003) + codes[i : len(codes) - GRAM + 1 + i]
    inside = np.ones(len(h), dtype=bool)
    ends = np.cumsum(length)[:-1]
    for i in range(1, GRAM):
        inside[ends - i] = False
    return _mixed(h[inside]), length - GRAM + 1


def margins(texts: list[str]) -> np.ndarray:
    """For each text and bit, how many trigrams have the bit less how many haven't, (texts, BITS); the SimHash is its sign."""
    out = np.zeros((len(texts), BITS), dtype=np.int64)
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        h, count = _grams(texts[at:end])
        # Segments of at most 255 trigrams, so that no counter of a byte overflows.
        per = -(-count // 255)
        owner = np.repeat(np.arange(end - at), per)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        seg = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per))
        ones = np.zeros((end - at, BITS), dtype=np.int64)
        for i in range(0, len(seg), max(1, CHUNK // 255)):
            s = seg[i : i + max(1, CHUNK // 255)]
            stop = seg[i + len(s)] if i + len(s) < len(seg) else len(h)
            part = h[s[0] : stop]
            both = np.stack([part, _mixed(part + np.uint64(0x9E3779B97F4A7C15))], axis=1).view(np.uint8).reshape(len(part), BITS // 8)
            sums = np.add.reduceat(_SPREAD[both], s - s[0], axis=0).view(np.uint8).reshape(len(s), BITS)
            np.add.at(ones, owner[i : i + len(s)], sums)
        out[at:end] = 2 * ones - count[:, None]
        at = end
    return out


def simhash_values(texts: list[str]) -> np.ndarray:
    """The SimHash of each text over its character trigrams: two signed 64-bit integers, (texts, 2)."""
    return np.packbits(margins(texts) > 0, axis=1, bitorder="little").view(np.int64).reshape(len(texts), 2)


def simhash(text: Column) -> Column:
    """SimHash of each text as struct (a, b); of a null text that of the empty one."""

    @F.pandas_udf("a bigint, b bigint")
    def values(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame(simhash_values(["" if t is None else t for t in s]), columns=["a", "b"])

    return values(text)


def table_keys(sim: Column) -> Column:
    """The key of a SimHash in each table, the table's number in it."""
    half = TABLES // 2
    block = lambda t: F.shiftrightunsigned(sim["a"] if t < half else sim["b"], WIDTH * (t % half)).bitwiseAND(F.lit((1 << WIDTH) - 1))
    return F.array(*[(F.lit(t << WIDTH) + block(t)).cast("int") for t in range(TABLES)])


def probe_values(texts: list[str]) -> np.ndarray:
    """The keys that each text asks for, (texts, keys): in each table its own, and those with one or two of the UNSURE bits turned whose margins are least."""
    m = margins(texts).reshape(len(texts), TABLES, WIDTH)
    own = np.packbits(m > 0, axis=2, bitorder="little").view(np.uint16).reshape(len(texts), TABLES).astype(np.int32)
    turned = (1 << np.argsort(np.abs(m), axis=2, kind="stable")[:, :, :UNSURE]).astype(np.int32)
    flips = [np.zeros_like(own), *[turned[:, :, i] for i in range(UNSURE)], *[turned[:, :, i] | turned[:, :, j] for i, j in combinations(range(UNSURE), 2)]]
    number = (np.arange(TABLES, dtype=np.int32) << WIDTH)[None, :]
    return np.concatenate([number + (own ^ f) for f in flips], axis=1)


def asking(text: Column) -> Column:
    """Struct (a, b, keys): SimHash of a text that asks, and the keys it asks for, its own first."""

    @F.pandas_udf("a bigint, b bigint, keys array<int>")
    def values(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            # In pieces, as a text has many keys.
            for i in range(0, max(1, len(s)), 10_000):
                part = s.iloc[i : i + 10_000].tolist()
                out = pd.DataFrame(simhash_values(part), columns=["a", "b"])
                out["keys"] = list(probe_values(part))
                if i == 0:
                    whole = [out]
                else:
                    whole.append(out)
            yield pd.concat(whole, ignore_index=True)

    return values(text)


def trigrams(text: Column) -> Column:
    """The set of trigrams of the padded text, as an array."""
    chars = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit("(?s)."), F.lit(0))
    # Shifted copies side by side; a place in a text isn't found again for each trigram.
    joined = chars
    for i in range(1, GRAM):
        joined = F.zip_with(joined, F.slice(chars, 1 + i, F.size(chars)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.slice(joined, 1, F.greatest(F.size(chars) - (GRAM - 1), F.lit(0))))


def alike(pairs: DataFrame, x: str, y: str, least: float, repeated: Column | None = None) -> DataFrame:
    """The pairs whose trigram sets have at least that Jaccard similarity and the lengths that ratio, so that a text repeated isn't like the text; where `repeated` is true, it is."""
    lx, ly = F.length(x) + 2, F.length(y) + 2
    long = F.least(lx, ly) >= F.lit(least) * F.greatest(lx, ly)
    # Lengths first, then each set once.
    near = pairs.filter(long if repeated is None else long | repeated).withColumns({"__x": trigrams(F.col(x)), "__y": trigrams(F.col(y))})
    return near.withColumn("__both", F.size(F.array_intersect("__x", "__y"))).filter(F.col("__both") >= F.lit(least) * (F.size("__x") + F.size("__y") - F.col("__both"))).drop("__x", "__y", "__both")


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"]))


def tables_of(texts: DataFrame) -> DataFrame:
    """(key, pid, sim): the tables over all rows, written once; a row for each text and table."""
    return written(texts.select("pid", "sim", F.explode(table_keys(F.col("sim"))).alias("key")), "tables")


def hot_keys(tables: DataFrame) -> DataFrame | None:
    """(key, pieces) of keys that hold more than HOT_KEY rows; None: there are none."""
    big = small(tables.groupBy("key").count().filter(F.col("count") > HOT_KEY).select("key", F.ceil(F.col("count") / HOT_KEY).cast("int").alias("pieces")))
    return None if big.isEmpty() else big


def candidates(asking: DataFrame, tables: DataFrame, big: DataFrame | None, max_hamming: int) -> DataFrame:
    """(asker, pid): pairs of a row that asks, (asker, key, sim) with a row for each key it asks for, and a row of the tables that are within the Hamming distance; each once.

    big: hot_keys(); they are dealt to pieces: their rows once, those who ask for each piece.
    """
    ask, held = asking.withColumn("piece", F.lit(0)), tables.withColumn("piece", F.lit(0))
    if big is not None:
        pieces = F.coalesce("pieces", F.lit(1))
        ask = asking.join(big, "key", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
        held = tables.join(big, "key", "left").withColumn("piece", F.pmod(F.xxhash64("pid"), pieces).cast("int")).drop("pieces")
    met = ask.withColumnRenamed("sim", "other").join(held, ["key", "piece"])
    return met.filter(hamming(F.col("sim"), F.col("other")) <= max_hamming).select("asker", "pid").distinct()


class LabelSpread:
    """Labels that go from trusted texts to all that near-duplicates connect with them.

    texts: pid (struct with a 64-bit hash `a` first), norm, sim, label (null: none). repeated: labels under which a text said several times is like the text. Two texts are linked if their SimHashes are within the Hamming distance and they are alike(). Texts of any length take part.
    The search goes outward a step at a time, each step from the texts found by the last, until a step finds none: the components that hold a trusted text, without ever forming links among the rest.

    A step is a shuffle join of the keys that its texts ask for with the tables. What was found, and what asked, leaves the tables. Of the texts that ask under one key about FIRST, by lot, go first, four times as many in
    the next step and so on, so that of a large group of texts alike nearly all are found by few, and the others don't meet them all once more.
    """

    def __init__(self, texts: DataFrame, max_hamming: int, least: float, repeated: tuple[str, ...] = ()) -> None:
        self.max_hamming, self.least, self.repeated = max_hamming, least, repeated
        self.texts = texts.select("pid", "norm", F.col("label").alias("own"))
        self.tables = tables_of(texts)
        self.big = hot_keys(self.tables)
        self.reached: DataFrame | None = None

    def leave(self, pids: DataFrame) -> None:
        """These rows have asked or been found: nothing finds them again."""
        self.reached = pids.select("pid") if self.reached is None else self.reached.unionByName(pids.select("pid"))

    def _left(self) -> DataFrame:
        if self.reached is None:
            return self.tables
        # Written anew, so that plans don't grow with the steps.
        self.reached = written(self.reached.distinct(), "reached")
        few = self.reached.count() <= BROADCAST_ROWS
        return self.tables.join(F.broadcast(self.reached) if few else self.reached, "pid", "left_anti")

    def go(self, front: DataFrame) -> DataFrame:
        """(pid, norm, label) of what is newly found from front, (norm, label), whose texts needn't be among the rows. A row takes the smallest label that reaches it first; a labelled row keeps its own and carries the search on."""
        queue, first, found = front.filter("norm IS NOT NULL").select("norm", "label"), FIRST, None
        while True:
            # Equal texts ask once.
            asks = queue.groupBy("norm").agg(F.min("label").alias("label"))
            asks = written(asks.select("norm", "label", F.xxhash64("norm").alias("asker"), asking(F.col("norm")).alias("q")).select("norm", "label", "asker", F.struct("q.a", "q.b").alias("sim"), "q.keys"), "asking")
            own = asks.select("asker", F.explode(F.slice("keys", 1, TABLES)).alias("key"))
            # There are no more than TABLES * 2**WIDTH keys, half a million: their counts may be broadcast.
            crowded = written(own.groupBy("key").count().filter(F.col("count") > first), "crowded")
            go, late = asks, None
            if not crowded.isEmpty():
                crowd = own.join(F.broadcast(crowded), "key").groupBy("asker").agg(F.max("count").alias("crowd"))
                lot = F.pmod(F.xxhash64(F.lit(3), "asker"), F.lit(1 << 30)) / (1 << 30)
                dealt = written(asks.join(crowd, "asker", "left").withColumn("late", F.coalesce(lot >= F.lit(first) / F.col("crowd"), F.lit(False))).drop("crowd"), "dealt")
                go, late = dealt.filter("NOT late"), dealt.filter("late").select("norm", "label")
            pairs = written(candidates(go.select("asker", "sim", F.explode("keys").alias("key")), self._left(), self.big, self.max_hamming), "pairs")
            rows = in_bitmap(self.texts.withColumn("h", F.col("pid.a")), "h", *bitmap(pairs.select(F.col("pid.a").alias("h")), "h", pairs.count())).drop("h")
            met = alike(pairs.join(rows, "pid").join(asks.select("asker", F.col("norm").alias("near"), "label"), "asker"), "norm", "near", self.least, F.col("label").isin(*self.repeated))
            new = written(met.groupBy("pid").agg(F.first("norm").alias("norm"), F.coalesce(F.first("own"), F.min("label")).alias("label")), "front")
            found = new if found is None else found.unionByName(new)
            queue = new.select("norm", "label") if late is None else new.select("norm", "label").unionByName(late)
            if queue.isEmpty():
                return found
            self.leave(new)
            first *= 4


def spread_labels(texts: DataFrame, max_hamming: int, least: float) -> DataFrame:
    """(pid, label): the labelled rows of `texts` and all that LabelSpread connects with the seeds: rows with seed true, or, without that column, all labelled rows."""
    seeds = texts.filter(F.col("label").isNotNull() & (F.coalesce("seed", F.lit(False)) if "seed" in texts.columns else F.lit(True)))
    spread = LabelSpread(texts, max_hamming, least)
    spread.leave(seeds)
    found = spread.go(seeds)
    return texts.filter("label IS NOT NULL").select("pid", "label").unionByName(found.join(texts.filter("label IS NULL").select("pid"), "pid").select("pid", "label"))
