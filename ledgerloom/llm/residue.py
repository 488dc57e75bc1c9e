"""Template residue, filler, error pages and script notices in texts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import residue_data as R
from ledgerloom.llm.neardup import LabelSpread, simhash
from ledgerloom.llm.wordless import MOST_FILLER, MOST_OTHERS, fit, scores
from ledgerloom.plans.joins import bitmap, in_bitmap, small, spread
from ledgerloom.plans.scratch import written

#: Spans in quotation marks, within a line, of any length. An apostrophe between letters isn't one.
_QUOTED = "(?=[\"'„«“‘])(?:" + "|".join((
    r'"[^"\n]{2,}+"', r"(?<![\p{L}\d])'(?=[^\n]{2})[^'\n]*+(?:(?<=[\p{L}\d])'(?=[\p{L}\d])[^'\n]*+)*+'(?![\p{L}\d])", r"„[^„“”\n]{2,}+[“”]", r"«[^«»\n]{2,}+»", r"“[^“”\n]{2,}+”", r"(?<![\p{L}\d])‘(?=[^\n]{2})[^‘’\n]*+(?:(?<=[\p{L}\d])’(?=[\p{L}\d])[^‘’\n]*+)*+’(?![\p{L}\d])",
)) + ")"
#: Ends of passages within a line: sentences, speaker labels and headings, parts of a headline, paragraph tags, rows of asterisks.
_ENDS = r"[.!?]\s+|:(?<!eference:|eferencia:|éférence:|organgsnummer:)\s+|\s[-–|]\s|</?p>|\*{3,}"
_NOTE = r"(?=[(\[<{])(?:\([^()\n]*+\)|\[[^\[\]\n]*+\]|<[^<>\n]++>|\{[^{}\n]++\})"
#: Passages a line may have before its number runs into the next line's; their order only matters within a document.
_LINE = 1 << 24

#: A word is common if this share of all distinct passages has it; a passage with this share of other words, that aren't names, may be in no language of the corpus.
COMMON, FOREIGN = 0.002, 0.8
#: From this score of the character model on, a foreign passage is filler. How often it occurs doesn't matter: formulas are told by their score.
FILLER_SCORE = 1.2
#: Trigram similarity of passages that are near-duplicates.
SIMILARITY = 0.6
#: See in_company().
SHARE, CHANCE = 0.3, 0.01


def _fields(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))


def slot_pattern() -> str:
    """Of unfilled slots: delimiters that only templates have, doubtful brackets around field names or words that ask for a value, and bare patterns of dates and numbers."""
    asking = r"(?iu:[\[<{(](?=[^\[\]<>{}()\n]*?(?<!\p{L})(?:" + _fields(R.ASKING) + r")(?!\p{L}))[^\[\]<>{}()\n]*+[\]>})])"
    field = r"(?iu:[\[<{]\s*(?:(?:the |des |de l['’]|del |de |der )?(?:" + _fields(R.FIELDS) + r")(?!\p{L})[ _.'’-]*)+\s*[\]>}])"
    return "|".join([*(f"(?:{p})" for p in R.SLOTS), asking, field, *(f"(?:{p})" for p in R.BARE)])


def slot_mark() -> str:
    """What no slot can do without, so that few lines are searched for all kinds of slots: every string that slot_pattern() finds holds it."""
    asking = r"(?iu:\([^\[\]<>{}()\n]*?(?:" + _fields(R.ASKING) + "))"
    # Each alternative begins with a character that most lines have few of.
    return r"(?=[{<%@|\[$_XNDTJPV(./-])(?:[{<%@|\[]|\$\D|__|XX|NN|(?<=[DdTtJj]{2})[./-]|DAY|TAG|JOUR|DÍA|DIA|NAME|VORNAME|PRÉNOM|PRENOM|NOMBRE|" + asking + ")"


def clean(text: Column) -> Column:
    """The text without invisible characters, escapes, hyphens at line ends and quoted spans; a line of one word is joined to the next."""
    t = F.translate(text, *R.PLAIN)
    for entity, plain in R.ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"-\n(?<=\p{L}-\n)(?=\p{L})", "")
    t = F.regexp_replace(t, r"(?m)^(\S+)\n(?=\S)", "$1 ")
    return F.regexp_replace(t, _QUOTED, " ")


def normal(passage: Column) -> Column:
    """Lower case, without digits and punctuation."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}]+", " "))


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, copy_of, pos, norm, code, slot, names): every passage of every text, and its place in the text's order. copy_of: the same for equal texts. code: a bare error code. names: mostly names."""
    mark = F.col("line").rlike(slot_mark())
    lines = documents.filter("text IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("copy_of"), F.posexplode(F.split(clean(F.col("text")), r"\n+")).alias("at", "line"))
    # Notes may hold sentence ends; slots may look like notes, so they are looked for first.
    slotted = lines.withColumn("slot", mark & F.col("line").rlike(slot_pattern()))
    parts = slotted.select("doc_id", "copy_of", "at", "slot", F.posexplode(F.split(F.regexp_replace("line", _NOTE, " "), _ENDS)).alias("part", "p"))
    norm = normal(F.col("p"))
    # Mostly words with a capital, but not all capitals: a list of names.
    names = (F.regexp_count("p", F.lit(r"\b\p{Lu}\p{Ll}")) * 2 > F.size(F.split(F.col("norm"), " "))) & (F.col("p") != F.upper("p"))
    place = (F.col("at").cast("bigint") * _LINE + F.col("part")).alias("pos")
    flat = parts.select("doc_id", "copy_of", place, norm.alias("norm"), F.trim("p").rlike(f"^(?iu:{R.CODES})[.!]?$").alias("code"), "slot", names.alias("names"))
    return flat.filter("norm <> '' OR slot OR code")


def is_mashed(words: list[str], common: frozenset[str], whole: bool = False) -> bool:
    """Whether a run of at least five words, or the whole of at least three (with `whole`, only that), is made of one or two words (of any number, if of x only) that aren't common."""

    folded = ["x" if set(w) == {"x"} else w for w in words]
    kinds = set(folded)
    if len(words) < 3 or len(words) - len(kinds) < 2:
        return False

    def ends(start: int) -> int:
        held: set[str] = set()
        for i in range(start, len(words)):
            if words[i] in common or not 2 <= len(words[i]) <= 8:
                return i
            held.add(folded[i])
            if len(held) > 2:
                return i
        return len(words)

    return ends(0) == len(words) or not whole and any(ends(i) - i >= 5 for i in range(len(words) - 4))


def by_words(norm: Column, common: frozenset[str]) -> Column:
    """(foreign, mashed, whole): the share of a passage's words that aren't common, 0 for fewer than four words; is_mashed, anywhere and as a whole."""

    known = common.__contains__

    def one(text: str) -> tuple[float, bool, bool]:
        ws = text.split(" ")
        n = len(ws)
        # Most passages repeat no word: only the others are looked at closely.
        close = n > 2 and (n - len(set(ws)) > 1 or "xx" in text)
        return 1 - sum(map(known, ws)) / n if n > 3 else 0.0, close and is_mashed(ws, common), close and is_mashed(ws, common, True)

    @F.pandas_udf("foreign double, mashed boolean, whole boolean")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame(list(map(one, s)), columns=["foreign", "mashed", "whole"])

    return judged(norm)


def common_words(distinct: DataFrame, least: float = COMMON) -> tuple[frozenset[str], int]:
    """Words that at least a share `least`, and two, of all distinct passages have. There can be no more of them than words in an average passage / least. And the number of distinct passages."""
    n = distinct.count()
    per_word = distinct.select(F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r["w"] for r in per_word.filter(F.col("n") >= max(2, least * n)).collect()), n


def label() -> Column:
    """The kind of residue that a passage is by itself, trusted; null: none."""
    return F.when(F.col("code"), "error").when(F.col("w.mashed"), "filler").when(F.col("norm").rlike(f"^(?iu)(?:{R.SAID_AGAIN})$"), "filler")


def phrases(spark: SparkSession) -> DataFrame:
    """(norm, label): the trusted wordings."""
    return spark.createDataFrame([(p, kind) for kind, ps in R.PHRASES.items() for p in ps], "norm string, label string")


def in_part() -> Column:
    """Whether a passage is residue only for words repeated somewhere in it: what stands around them may be a normal sentence."""
    norm, words = F.col("norm"), "|".join(R.REPEATED)
    return (F.col("w.mashed") & ~F.col("w.whole")) | (norm.rlike(rf"\b({words})(?: \1)+\b") & ~norm.rlike(rf"^(?:{words})(?: (?:{words}))*$"))


def _filler_model(all_passages: DataFrame, by_itself: DataFrame) -> tuple[dict[str, float], float] | None:
    """The character model, fitted on the foreign passages of texts that hold the classic filler, against all others. Bounded samples, taken by hash. None without such texts."""
    seeds = all_passages.filter("norm LIKE 'lorem ipsum%'").select("doc_id").distinct()
    foreign = by_itself.filter("foreign").select("pid", "norm")
    filler = all_passages.select("doc_id", "pid").join(seeds, "doc_id", "left_semi").join(foreign, "pid").select("pid", "norm").distinct()
    first = lambda df, n: [r["norm"] for r in df.orderBy("pid").limit(n).select("norm").collect()]
    some = first(filler, MOST_FILLER)
    return fit(some, first(by_itself.filter("NOT foreign AND label IS NULL"), MOST_OTHERS)) if some else None


def in_company(all_passages: DataFrame, labelled: DataFrame, distinct: int, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """(pid, norm, label): passages without label that stand beside labelled ones far more often than by chance.

    What a system left comes in runs: a notice, a request to try again, a reference. A passage counts as their company by the different neighbourhoods (passage before and after, so that copies of a text are one) in
    which a labelled passage is next to it, in relation to all different texts that hold it. It must have at least the share `share` of them, and by Chernoff's bound no more than `chance` of all `distinct` passages
    may be expected to have it, if each neighbourhood were beside a labelled passage as often as passages are that ever stand beside one. So one or two texts never suffice, and the bar rises with the corpus.
    """
    marks = labelled.select("pid", "label")
    held = in_bitmap(all_passages.withColumn("h", F.col("pid.a")), "h", *bitmap(marks.select(F.col("pid.a").alias("h")), "h", marks.count())).drop("h").join(marks, "pid")
    touched = held.select("doc_id").unionByName(all_passages.filter("code").select("doc_id")).distinct()
    touched = written(touched, "touched")
    of_docs = in_bitmap(all_passages.withColumn("h", F.xxhash64("doc_id")), "h", *bitmap(touched.select(F.xxhash64("doc_id").alias("h")), "h", touched.count())).drop("h").join(touched, "doc_id", "left_semi")
    told = of_docs.join(small(marks), "pid", "left").withColumn("label", F.coalesce("label", F.when(F.col("code"), "error")))
    w = Window.partitionBy("doc_id").orderBy("pos", "pid")  # a document's own passages
    beside = told.select("pid", "norm", "label", F.coalesce(F.lag("label").over(w), F.lead("label").over(w)).alias("near"), F.struct(F.lag("pid").over(w), F.lead("pid").over(w)).alias("between"))
    near = written(beside.filter("label IS NULL AND near IS NOT NULL AND norm <> ''").groupBy("pid").agg(F.first("norm").alias("norm"), F.mode("near", True).alias("label"), F.count_distinct("between").alias("hits")), "near")
    cand = near.filter("hits > 1")
    beside_any = near.count()
    if not beside_any:
        return near.select("pid", "norm", "label")
    held_by = in_bitmap(all_passages.withColumn("h", F.col("pid.a")), "h", *bitmap(cand.select(F.col("pid.a").alias("h")), "h", cand.count())).join(cand.select("pid"), "pid", "left_semi").groupBy("pid").agg(F.count_distinct("copy_of").alias("n"))
    base = min(beside_any / distinct, share)
    s = F.least(F.col("hits") / F.col("n"), F.lit(1.0))
    bits = s * F.log(s / base) + F.when(s < 1, (1 - s) * F.log((1 - s) / (1 - base))).otherwise(0.0)
    sure = (s >= share) & (s > base) & (F.col("n") * bits >= math.log(max(1, distinct) / chance))
    return cand.join(held_by, "pid").filter(sure).select("pid", "norm", "label")


def residue(documents: DataFrame, max_hamming: int = 40, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kinds): documents with residue in them, and which kinds.

    Texts are cut into passages: sentences, lines, labels. Quoted spans are taken out first, so that a speaker who quotes a notice isn't taken for one. Equal passages (without case, digits and
    punctuation) are one. Trusted labels come from notices in general use (R.PHRASES), from bare error codes, words said over and over, and from a character model for pseudo-Latin. Near-duplicates of trusted passages
    are found over partitioned SimHash tables of all passages, verified by Hamming distance and by text similarity (character trigrams, Jaccard `similarity`), and take over the label; from them the search goes on, until a
    connected component has no more members. Then passages that stand in labelled ones' company (in_company) are labelled, and the search goes on from these; until nothing new is found.
    Unfilled slots are residue by themselves. The label of a slot, or of words repeated within a passage, stays where it is: the sentence around them may be a normal one.
    How often a passage or a document occurs makes no difference to what is found in it.

    Null and empty texts are no residue. Repeated doc_ids are one. Texts are read whole, whatever their length.
    """
    all_passages = written(passages(spread(documents)).withColumn("pid", F.struct(F.xxhash64("norm").alias("a"), F.xxhash64(F.lit(7), "norm").alias("b"))), "passages")
    distinct = all_passages.filter("norm <> ''").groupBy("pid").agg(F.first("norm").alias("norm"), F.max("code").alias("code"), F.max("names").alias("names"))
    distinct = written(distinct, "distinct")
    common, n = common_words(distinct)
    judged = distinct.withColumns({"w": by_words(F.col("norm"), common), "sim": simhash(F.col("norm"))})
    foreign = (F.col("w.foreign") >= FOREIGN) & ~F.col("names")
    by_itself = written(judged.select("pid", "norm", foreign.alias("foreign"), label().alias("label"), (~in_part()).alias("seed"), "sim"), "by-itself")
    model = _filler_model(all_passages, by_itself)
    known = by_itself
    if model:
        # Only what the model is asked about goes through Python.
        asked = F.col("foreign") & F.col("label").isNull()
        scored = by_itself.filter(asked).withColumn("label", F.when(scores(F.col("norm"), *model) >= FILLER_SCORE, "filler"))
        known = written(by_itself.filter(~asked).unionByName(scored), "known")
    labelled = propagate(all_passages, known, n, max_hamming, similarity)
    by_passage = all_passages.join(labelled, "pid").select("doc_id", "label")
    slots = all_passages.filter("slot").select("doc_id", F.lit("template").alias("label"))
    codes = all_passages.filter("code").select("doc_id", F.lit("error").alias("label"))
    return by_passage.unionByName(slots).unionByName(codes).groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("kinds"))


def propagate(all_passages: DataFrame, known: DataFrame, distinct: int, max_hamming: int, similarity: float) -> DataFrame:
    """(pid, label) of all labelled passages: those of `known` that have a label, and those that likeness and company connect with them and with the trusted phrases."""
    seeds = known.filter("label IS NOT NULL AND seed")
    search = LabelSpread(known, max_hamming, similarity, ("filler",))
    search.leave(seeds)
    labelled = known.filter("label IS NOT NULL").select("pid", "norm", "label")
    front = phrases(known.sparkSession).unionByName(seeds.select("norm", "label"))
    while True:
        found = search.go(front)
        labelled = written(labelled.join(found.select("pid"), "pid", "left_anti").unionByName(found), "labelled")
        learned = written(in_company(all_passages, labelled, distinct).join(labelled.select("pid"), "pid", "left_anti"), "learned")
        if learned.isEmpty():
            return labelled.select("pid", "label")
        search.leave(learned)
        labelled = labelled.unionByName(learned)
        front = learned.select("norm", "label")
