"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.prefix import range_sorted, running_sums
from ledgerloom.plans.joins import small
from ledgerloom.plans.scratch import written


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, share, budget): what each mixture can be made of.

    share: the target share among the mixture's sources that have tokens, so that these add up to 1. budget: the largest total for which no source must
    be repeated more than max_repeats times. A source without tokens, a null source, a share or a number of repeats that is null or not positive: available
    tokens as they are, share 0. A mixture without usable source has budget 0.
    """
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats").join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    mine = Window.partitionBy("mix_name")  # a mixture's sources, as many as the target table names
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mine)).otherwise(0.0)
    limit = F.when(F.col("share") > 0, F.col("max_repeats") * F.col("available") / F.col("share"))
    return wanted.withColumn("share", share).withColumn("budget", F.coalesce(F.min(limit).over(mine), F.lit(0.0)))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(order, shares). order: (mix_name, position, doc_id, source, repeat, tokens, finish); shares: (mix_name, source, target_share, available_tokens, used_tokens, actual_share, most_repeats).

    Weighted fair queueing: each source's documents are shuffled by a hash, and each use of a document gets as virtual finish time the tokens of its source up to and
    including it, divided by the source's share; a later repeat of a source continues where the one before ended. All uses of a mixture are range-sorted by finish time (ties by source,
    document, repeat), their tokens summed up over all partitions, and the order ends where the budget of mix_plan is reached. Each
    source is then within one document of its share at every place in the order.
    sized: doc_id, source, tokens. Documents without tokens, without source or without target are in no mixture. Repeated targets of a source in a mixture are not supported: an error.
    Repeated doc_ids are documents of their own. Empty inputs give empty results.
    """
    plan = written(mix_plan(sized, targets), "plan")
    if plan.groupBy("mix_name", "source").count().filter("count > 1").limit(1).count():
        raise ValueError("a mixture names a source twice")
    usable = small(plan.filter("share > 0").select("mix_name", "source", "available", "share", "budget", "max_repeats"))
    asked = sized.filter("tokens > 0").join(usable, "source").withColumn("rnd", F.xxhash64(F.lit(seed), "mix_name", "doc_id"))
    queued = running_sums(range_sorted(asked, ["mix_name", "source", "rnd", "doc_id"]), ["mix_name", "source"], ["tokens"])
    # How often the document's finish time lies within the budget; a later repeat needs the whole source once more.
    fits = F.floor((F.col("share") * F.col("budget") - F.col("tokens_run")) / F.col("available") + F.lit(1e-9)).cast("int") + 1
    uses = queued.withColumn("times", F.least(fits, F.col("max_repeats"))).filter("times > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("times"))))
    uses = uses.select("mix_name", ((F.col("tokens_run") + (F.col("repeat") - 1) * F.col("available")) / F.col("share")).alias("finish"), "source", "doc_id", "repeat", "tokens", "budget", F.lit(1).cast("bigint").alias("one"))
    ordered = running_sums(range_sorted(uses, ["mix_name", "finish", "source", "doc_id", "repeat"]), ["mix_name"], ["tokens", "one"])
    order = ordered.filter(F.col("tokens_run") <= F.col("budget") + 1e-6 * F.col("budget")).select("mix_name", F.col("one_run").alias("position"), "doc_id", "source", "repeat", "tokens", "finish")
    got = order.groupBy("mix_name", "source").agg(F.sum("tokens").alias("used_tokens"), F.max("repeat").alias("most_repeats"))
    shares = plan.select("mix_name", "source", "target_share", F.col("available").alias("available_tokens")).join(got, ["mix_name", "source"], "left").withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    whole = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    return order, shares.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0))
