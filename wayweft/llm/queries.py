"""The queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.llm import bpe, entity_match, mixing, repetition
from wayweft.runtime import materialise, once, table, table_path


def _streets(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_streets(table(spark, d, "centerline"), table(spark, d, "osm_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are the same stretch of the same street."""
    return _streets(spark, d).where(F.col("confidence") >= entity_match.MATCH).select("objectid", "way_id").distinct()


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs with their confidence."""
    return _streets(spark, d)


def p6_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Pairs where every line has one counterpart at most, with their confidence."""
    found = entity_match.match_streets(table(spark, d, "centerline"), table(spark, d, "osm_lines"), one_to_one=True)
    return found.where(F.col("confidence") >= entity_match.MATCH)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"), ["doc_id"], "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again, as a digest."""
    encoded = bpe.encode_corpus(table(spark, d, "documents"), ["doc_id"], "text")
    return bpe.decode_corpus(encoded, ["doc_id"], "ids").select("doc_id", F.md5("text").alias("digest"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    """Mix and report; the sizes are counted once per application and state of the documents, for both queries."""
    count = lambda: materialise(bpe.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text").withColumnRenamed("doc_id", "id"), "sizes")
    return mixing.mix_sources(once(spark, "token sizes", [table_path(d, "documents")], count), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: one row for each copy of a document."""
    return _mix(spark, d).records.select(F.col("id").alias("doc_id"), "source", "n_tokens", "copy")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, d).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mostly repeat themselves."""
    return repetition.repetitive(table(spark, d, "documents"), ["doc_id"], "text")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition.repetition(table(spark, d, "documents"), ["doc_id"], "text")


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that break the limit of the repeated share or that of the longest repeat."""
    return repetition.over_limits(table(spark, d, "documents"), ["doc_id"], "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p6_matches, p6_one_to_one, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_shares, p9_limits)}

SQL: dict[str, str] = {"p7_decoded": "SELECT doc_id, md5(text) AS digest FROM documents"}
