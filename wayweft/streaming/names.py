"""Name checks on streams: the same expressions as for tables, so a stream and a table give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.functions import names
from wayweft.plans.reports import name_mismatch


def mismatches(pairs: DataFrame, name1: str, name2: str, score: str | None = None) -> DataFrame:
    """Rows whose canonical names differ, with score_name; stateless, so it works for append streams without watermark."""
    rows = pairs.withColumn("score_name", names.match_score(F.array(name1), F.array(name2)))
    return rows.where(name_mismatch(F.col(score) if score else F.lit(100), F.col("score_name")))


def mismatch_counts(pairs: DataFrame, name1: str, name2: str, time: str, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Mismatches for each window of event time; rows that come later than `delay` after the newest are left out."""
    late = pairs.withWatermark(time, delay) if pairs.isStreaming else pairs
    return mismatches(late, name1, name2).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
