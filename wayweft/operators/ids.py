"""Dense sequential ids without funnelling the rows through one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayweft.runtime import materialise


def dense_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 1, step: int = 1) -> DataFrame:
    """Adds `name`: start, start + step, ... in the order of the given columns, which should be unique.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and the offsets come from one count
    for each partition. The numbered rows are written once, so both passes see the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ordered.withColumn("_mono", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_part": F.shiftright("_mono", 33), "_at": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    numbered = rows.join(F.broadcast(before), "_part")  # one row for each partition
    return numbered.withColumn(name, (F.col("_before") + F.col("_at")) * step + start).drop("_mono", "_part", "_at", "_before", "_n")
