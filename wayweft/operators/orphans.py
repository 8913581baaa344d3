"""References to records that do not exist, reported per referring table and period.

Method: references are pre-aggregated per key and period before anything is shuffled. Keys that hold a large share of
all references are few by definition; with their periods they are broadcast against the rows of the target table, which
are not shuffled for it. The other keys meet the target in a shuffled anti-join. The two orphan sets are united, and only
orphan keys ever meet the references again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.runtime import hot_keys, materialise, month_index, month_text, small_or_shuffled

#: A key is heavy from 1/HEAVY_SHARE of all references on, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 10_000


def target_states(targets: DataFrame, key: str, version: str, live: str, loaded: str) -> DataFrame:
    """key, month, state of every target row: state orders the versions, its lowest bit says alive."""
    version_no = F.coalesce(F.col(version).cast("long"), F.lit(-1))
    alive = F.when(F.coalesce(F.col(live), F.lit(True)), 1).otherwise(0)
    rows = targets.where(F.col(key).isNotNull() & F.col(loaded).isNotNull())
    return rows.select(F.col(key).alias("key"), month_index(F.col(loaded)).alias("month"), (version_no * 2 + alive).alias("state"))


def _dead(last: Column) -> Column:
    """There is no row, or the last one says not alive."""
    return last.isNull() | (F.pmod(last, F.lit(2)) == 0)


def orphan_keys(refs: DataFrame, states: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """refs (key, period, and any other columns) -> key, period, n_refs, heavy of the keys that lead nowhere in a period.

    Light keys meet the target's history, of which partial aggregation leaves at most one row per key and month, in a
    shuffled join. Heavy keys, at most heavy_share, are checked while the target is read.
    """
    counts = materialise(refs.groupBy("key", "period").agg(F.count("*").alias("n_refs")), "ref-counts")
    heavy = F.broadcast(materialise(hot_keys(counts, ["key"], "n_refs", heavy_share), "heavy-keys"))
    up_to = F.max(F.when(F.col("month") <= F.col("period"), F.col("state"))).alias("last")

    light = counts.join(heavy, "key", "left_anti")
    history = states.groupBy("key", "month").agg(F.max("state").alias("state"))
    seen = light.select("key", "period", "n_refs").join(history, "key", "left").groupBy("key", "period", "n_refs").agg(up_to)
    light_dead = seen.where(_dead(F.col("last"))).select("key", "period", "n_refs", F.lit(False).alias("heavy"))

    of_heavy = materialise(counts.join(heavy, "key", "left_semi").repartition("key"), "heavy-counts")
    checked = states.join(heavy, "key", "left_semi").join(small_or_shuffled(of_heavy.select("key", "period")), "key").groupBy("key", "period").agg(up_to)
    heavy_dead = of_heavy.join(checked, ["key", "period"], "left").where(_dead(F.col("last"))).select("key", "period", "n_refs", F.lit(True).alias("heavy"))
    return light_dead.unionByName(heavy_dead)


def way_and_junction_refs(ways: DataFrame, jcts: DataFrame) -> DataFrame:
    """ref_table, ref_id, period (month index), key: every reference once for each row; null references are none."""
    w = ways.select(F.lit("osm_ways").alias("ref_table"), F.col("id").alias("ref_id"), month_index(F.col("loaded_at")).alias("period"), F.explode(F.array_distinct("nodes")).alias("key"))
    j = jcts.select(F.lit("jcts").alias("ref_table"), F.col("jct_id").alias("ref_id"), month_index(F.col("loaded_at")).alias("period"), F.col("node_id").alias("key"))
    return w.unionByName(j).where(F.col("key").isNotNull() & F.col("period").isNotNull())


def orphan_references(ways: DataFrame, jcts: DataFrame, nodes: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Distinct references without a live node at the end of the month they were delivered in.

    Result: ref_table, period (yyyy-MM), ref_id, node_id. A node is live when among its rows loaded up to the end of
    that month the one with the highest version is visible; a null version is the lowest, a null `visible` is no
    deletion, and of equal versions a visible one counts. Null references, null elements, and rows without loaded_at
    give nothing; a null ref_id is kept; repeated references count once; empty tables give an empty result.
    """
    refs = way_and_junction_refs(ways, jcts)
    states = target_states(nodes, "id", "version", "visible", "loaded_at")
    dead = materialise(orphan_keys(refs, states, heavy_share), "orphan-keys")
    of_heavy = refs.join(small_or_shuffled(dead.where("heavy").select("key", "period")), ["key", "period"], "left_semi")
    heavy_all = F.broadcast(dead.where("heavy").select("key").distinct())  # at most heavy_share keys
    of_light = refs.join(heavy_all, "key", "left_anti").join(dead.where("not heavy").select("key", "period"), ["key", "period"], "left_semi")
    found = of_heavy.unionByName(of_light).distinct()
    return found.select("ref_table", month_text(F.col("period")).alias("period"), "ref_id", F.col("key").alias("node_id"))


def heavy_keys(ways: DataFrame, jcts: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """node_id, n_refs of the keys that hold at least 1/heavy_share of all references: those that are checked by broadcast."""
    counts = way_and_junction_refs(ways, jcts).groupBy("key").agg(F.count("*").alias("n_refs"))
    return counts.join(F.broadcast(hot_keys(counts, ["key"], "n_refs", heavy_share)), "key").select(F.col("key").alias("node_id"), "n_refs")


def orphan_report(found: DataFrame) -> DataFrame:
    """ref_table, period, n_refs, n_keys of orphan_references()."""
    return found.groupBy("ref_table", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("node_id").alias("n_keys"))
