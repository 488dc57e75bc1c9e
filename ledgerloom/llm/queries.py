"""Queries p7 to p9 over documents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import duplicate_classes
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.packing import fill_containers
from ledgerloom.llm.residue import residue
from ledgerloom.llm.tokens import sized, token_count
from ledgerloom.plans.joins import spread
from ledgerloom.plans.scratch import written
from ledgerloom.sources.tables import table


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, cluster) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "reissue_of", "text"))
    sizes = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "tokens")
    return sizes.join(duplicate_classes(docs), "doc_id")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of documents that are the same but for small corrections, of each document."""
    return duplicate_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "reissue_of", "text")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of one that is too large, for each capacity."""
    return fill_containers(_clustered(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p7_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that hold two documents of one class: none may come out."""
    clustered = written(_clustered(spark, sf_dir), "clustered")
    placed = fill_containers(clustered, table(spark, sf_dir, "container_spec")).join(clustered.select("doc_id", "cluster"), "doc_id").filter("container IS NOT NULL")
    return placed.groupBy("spec_id", "container", "cluster").agg(F.count_distinct("doc_id").alias("documents")).filter("documents > 1")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens in them and the share of their space that is used, for each capacity."""
    placed = p7_containers(spark, sf_dir).filter("container IS NOT NULL")
    return placed.groupBy("spec_id", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which each mixture takes its documents."""
    return mix(written(sized(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), "tokens"), table(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each mixture."""
    return mix(written(sized(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), "tokens"), table(spark, sf_dir, "mix_target"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue in their text."""
    return residue(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue in their text, and its kinds."""
    return residue(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat_ws(",", "kinds").alias("kinds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_containers, p7_fill, p7_classes, p7_conflicts, p8_mixture, p8_shares, p9_found, p9_kinds)}


def oracle_sql() -> dict[str, str]:
    """None: token counts, packing and residue can't be said in SQL; tests hold them against brute force."""
    return {}
