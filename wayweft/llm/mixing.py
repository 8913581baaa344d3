"""Mixing sources to target weights by capped water-filling.

Every source gets its target share of the total; a source that would have to be repeated more often than allowed is
clamped at its cap and what it leaves is redistributed over the others in proportion to their weights, until no source
is over its cap. A source then contributes whole repetitions of all its records and, for the fraction that is left, the
records that come first in a seeded order, so the actual share is met to within one record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayweft.runtime import materialise

#: Hash buckets in which the fraction's boundary is searched; only one bucket per source is ever sorted by record.
BUCKETS = 65_536
#: Equal records that one row stands for while they are written out.
BLOCK = 100_000


@dataclass(frozen=True)
class Share:
    source: str
    weight: float
    size: int
    cap: int
    planned: float

    @property
    def epochs(self) -> float:
        return self.planned / self.size if self.size else 0.0


def water_fill(weights: dict[str, float], sizes: dict[str, int], repeats: dict[str, int], total: float | None = None) -> dict[str, Share]:
    """Planned size of each source. total: size of the mix; by default that of all records of the weighted sources.

    If the caps allow less than total, the mix is as large as they allow.
    """
    free = {s: w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    left = float(sum(sizes[s] for s in free) if total is None else total)
    planned: dict[str, float] = {}
    while free:
        largest = max(free.values())  # weights may be so small that their sum or product loses digits
        scaled = {s: w / largest for s, w in free.items()}
        whole = sum(scaled.values())
        wanted = {s: left * (w / whole) for s, w in scaled.items()}
        over = {s for s, n in wanted.items() if n > repeats[s] * sizes[s]}
        if not over:
            planned |= wanted
            break
        for s in sorted(over):
            planned[s] = float(repeats[s] * sizes[s])
            left -= planned[s]
            del free[s]
    return {s: Share(s, w, sizes.get(s, 0), repeats.get(s, 0), planned.get(s, 0.0)) for s, w in weights.items()}


@dataclass
class Mix:
    """records: id, source, n_tokens, copy (from 1); shares: the report described at mix_sources()."""

    records: DataFrame
    shares: DataFrame


def mix_sources(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> Mix:
    """Mixes records (id, source, n_tokens) after targets (source, weight, max_repeat).

    shares has a row for every source that occurs in either table: source, target_share (weight over the sum of
    weights), available_tokens, max_repeat, epochs, planned_tokens, mixed_tokens, actual_share.
    Defined cases: a null or negative weight is 0, a null max_repeat is 1; of a source listed twice the weights add up
    and the larger max_repeat holds; records of a source without target or with a null source are not used; targets
    without a source are no targets; records of no tokens, or of unknown size, take no part; repeated records are
    records of their own; empty tables give an empty mix. The targets are configuration: a row for each source.
    """
    sized = materialise(sized.select(F.col("id").alias("id"), "source", F.col("n_tokens").cast("long").alias("n_tokens")), "sized")
    spark = sized.sparkSession
    clean = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    stock = sized.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("available_tokens"))
    rows = clean.join(stock, "source", "left").collect()  # one row for each target
    weights = {r.source: r.weight for r in rows}
    plan = water_fill(weights, {r.source: r.available_tokens or 0 for r in rows}, {r.source: r.max_repeat for r in rows}, total)
    norm = sum(weights.values()) or 1.0
    planned = spark.createDataFrame([(p.source, p.weight / norm, p.cap, p.epochs, p.planned, int(p.epochs + 1e-9), max(0.0, p.planned - int(p.epochs + 1e-9) * p.size)) for p in plan.values()], "source string, target_share double, max_repeat int, epochs double, planned_tokens double, whole int, rest double")
    plans = F.broadcast(planned)  # one row for each target

    order = F.xxhash64(F.lit(seed), "source", "id")
    placed = sized.where("n_tokens > 0").join(plans.where("planned_tokens > 0").select("source", "whole", "rest"), "source").withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    filled = placed.groupBy("source", "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = filled.withColumn("upto", F.sum("n").over(below)).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))).alias("e")).select("source", F.col("e.bucket").alias("edge"), F.col("e.room").alias("room"))
    at = placed.join(F.broadcast(edge), "source", "left")  # one row for each target
    full = at.where("bucket < edge OR edge IS NULL").select("id", "source", "n_tokens", (F.col("whole") + F.when(F.col("edge").isNotNull(), 1).otherwise(F.when(F.col("rest") > 0, 1).otherwise(0))).alias("copies"))
    none = at.where("bucket > edge").select("id", "source", "n_tokens", F.col("whole").alias("copies"))
    # Equal records are one row with a count until the boundary is found, so a record that fills its source is no task's list.
    first = Window.partitionBy("source").orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = at.where("bucket = edge").groupBy("source", "whole", "room", "h", "id", "n_tokens").agg(F.count("*").alias("m"))
    cut = cut.withColumn("before", F.sum(F.col("n_tokens") * F.col("m")).over(first) - F.col("n_tokens") * F.col("m"))
    cut = cut.withColumn("taken", F.least(F.col("m"), F.greatest(F.lit(0), F.ceil((F.col("room") - F.col("before")) / F.col("n_tokens") + 0.5) - 1)))
    blocks = cut.withColumn("from", F.explode(F.sequence(F.lit(1), "m", F.lit(BLOCK)))).repartition("source", "id", "from")
    each = blocks.withColumn("i", F.explode(F.sequence("from", F.least(F.col("m"), F.col("from") + BLOCK - 1))))
    part = each.select("id", "source", "n_tokens", (F.col("whole") + F.when(F.col("i") <= F.col("taken"), 1).otherwise(0)).alias("copies"))
    chosen = full.unionByName(none).unionByName(part).where("copies > 0")
    records = chosen.select("id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))

    mixed = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    used = mixed.agg(F.sum("mixed_tokens").cast("double")).scalar()
    shares = (
        stock.join(plans, stock["source"].eqNullSafe(planned["source"]), "full_outer")
        .select(F.coalesce(stock["source"], planned["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "max_repeat", F.coalesce("epochs", F.lit(0.0)).alias("epochs"), F.coalesce("planned_tokens", F.lit(0.0)).alias("planned_tokens"))
        .join(mixed, "source", "left")
        .select("source", "target_share", "available_tokens", "max_repeat", "epochs", "planned_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / used, F.lit(0.0)).alias("actual_share"))
    )
    return Mix(records, shares)
