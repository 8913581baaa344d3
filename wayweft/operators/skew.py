"""Joins that survive a key that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.runtime import hot_keys, materialise

#: A key is hot from 1/HOT_SHARE of the rows of the large side on; there are at most HOT_SHARE of them.
HOT_SHARE = 200
#: Hot keys are spread over so many salts.
SALTS = 32


def salted_join(large: DataFrame, other: DataFrame, key: str, how: str = "inner", share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """large JOIN other ON key, with the rows of hot keys of `large` spread over `salts` partitions.

    Keys are counted with map-side combination. Only the rows of `other` that belong to hot keys are repeated.
    how: 'inner' or 'left'. Null keys join nothing, as in SQL.
    """
    counts = large.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(materialise(hot_keys(counts.where(F.col(key).isNotNull()), [key], "n", share), "hot-keys").withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c in large.columns if large.schema[c].dataType.typeName() != "map"]), F.lit(salts))).otherwise(0).cast("int")
    left = large.join(hot, key, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = other.join(hot, key, "left").withColumn("_salt", copies).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
