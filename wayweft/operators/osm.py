"""OSM ways and nodes to path networks.

ways: way_id, tags map<string,string>, node_ids array<bigint>;  nodes: node_id, pt, tags.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions import geom, maps, names
from wayweft.functions.projection import Projection
from wayweft.operators.ids import dense_ids

Rect = tuple[float, float, float, float]


def clip_nodes(nodes: DataFrame, projection: Projection | None = None, clip: Rect | None = None) -> DataFrame:
    """Projects first, then keeps the nodes in the (planar, half-open) rectangle."""
    if projection is not None:
        nodes = nodes.withColumn("pt", projection.point(F.col("pt")))
    return nodes if clip is None else nodes.where(geom.in_rect(F.col("pt"), clip))


def highway_ways(ways: DataFrame) -> DataFrame:
    """Ways with a highway tag."""
    return ways.where(F.map_contains_key("tags", F.lit("highway")))


def way_refs(ways: DataFrame) -> DataFrame:
    """way_id, pos, node_id of every reference."""
    return ways.select("way_id", F.posexplode("node_ids").alias("pos", "node_id"))


def keep_live_refs(ways: DataFrame, nodes: DataFrame, clipped: bool = False) -> DataFrame:
    """Ways with only the references that lead to a node, in order; the gap becomes a straight line.

    clipped: also drop ways with fewer than two such references (repeats count).
    """
    live = way_refs(ways).join(nodes.select("node_id"), "node_id", "left_semi").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("r"))
    live = live.select("way_id", F.transform("r", lambda r: r["node_id"]).alias("node_ids"))
    kept = ways.drop("node_ids").join(live, "way_id", "inner" if clipped else "left")
    kept = kept.withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<bigint>"))).select(*ways.columns)
    return kept.where(F.size("node_ids") >= 2) if clipped else kept


def destutter(refs: Column) -> Column:
    """Without references equal to the one before."""
    return F.filter(refs, lambda r, i: (i == 0) | ~r.eqNullSafe(F.get(refs, i - 1)))


def well_formed(ways: DataFrame) -> DataFrame:
    """Ways of at least two references."""
    return ways.where(F.size("node_ids") >= 2)


def node_ref_counts(ways: DataFrame) -> DataFrame:
    """node_id, way_id, refs: how often each way refers to a node."""
    return way_refs(ways).where("node_id IS NOT NULL").groupBy("node_id", "way_id").agg(F.count("*").alias("refs"))


def node_degrees(ways: DataFrame) -> DataFrame:
    """node_id, n_ways: distinct ways through each node."""
    return node_ref_counts(ways).groupBy("node_id").agg(F.count("*").alias("n_ways"))


def intersections(ways: DataFrame) -> DataFrame:
    """Nodes of more than one way."""
    return node_degrees(ways).where("n_ways > 1").select("node_id")


def vacuum(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes with a tag or a reference."""
    used = way_refs(ways).select("node_id").distinct().withColumn("_used", F.lit(True))
    return nodes.join(used, "node_id", "left").where((F.coalesce(F.size("tags"), F.lit(0)) > 0) | F.col("_used")).drop("_used")


def split_at_junctions(ways: DataFrame) -> DataFrame:
    """way_id, idx, node_ids of the stretches between way ends and nodes of several ways; other columns are kept.

    A way is cut where its own node is used by another way, not where it meets itself. The shuffled rows are single
    references; a way's list comes together again under its own id.
    """
    degree = node_degrees(ways)
    marked = way_refs(ways).join(degree, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "n_ways"))).alias("r"))
    n = F.size("r")
    marked = marked.where(n >= 2)
    breaks = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (i == n - 1) | (F.get(F.col("r"), i)["n_ways"] > 1))
    marked = marked.withColumn("b", breaks)
    parts = F.transform(F.sequence(F.lit(0), F.size("b") - 2), lambda k: F.transform(F.slice("r", F.get(F.col("b"), k) + 1, F.get(F.col("b"), k + 1) - F.get(F.col("b"), k) + 1), lambda r: r["node_id"]))
    found = marked.select("way_id", F.posexplode(parts).alias("idx", "node_ids"))
    rest = [c for c in ways.columns if c not in ("way_id", "node_ids")]
    return found.join(ways.select("way_id", *rest), "way_id") if rest else found


def with_points(stretches: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds pts, the places of node_ids in order; references without a node are left out."""
    refs = stretches.select(*keys, F.posexplode("node_ids").alias("pos", "node_id")).join(nodes.select("node_id", "pt"), "node_id")
    lines = refs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "pt"))).alias("r")).select(*keys, F.transform("r", lambda r: r["pt"]).alias("pts"))
    return stretches.join(lines, list(keys))


@dataclass
class OsmData:
    ways: DataFrame
    nodes: DataFrame


def prepare(ways: DataFrame, nodes: DataFrame, projection: Projection | None = None, clip: Rect | None = None) -> OsmData:
    """Projects and clips, keeps highways, and cleans references and nodes, in that order."""
    nodes = clip_nodes(nodes, projection, clip)
    ways = keep_live_refs(highway_ways(ways), nodes, clip is not None)
    ways = well_formed(ways.withColumn("node_ids", destutter(F.col("node_ids"))))
    return OsmData(ways, vacuum(nodes, ways))


def create_path_network(data: OsmData, seg_props: Sequence[str] | None = None, jct_props: Sequence[str] | None = None, config: names.CanonConfig = names.DEFAULT):
    """(segs, jcts) of OSM data: segments between shared nodes, numbered by way and position, with canonical names."""
    parts = split_at_junctions(data.ways)
    lines = with_points(parts, data.nodes, ["way_id", "idx"]).where(F.size("pts") >= 2)
    tags = F.col("tags") if seg_props is None else maps.only_keys(F.col("tags"), seg_props)
    segs = dense_ids(lines, ["way_id", "idx"], "seg_id").select(
        "seg_id", F.element_at("node_ids", 1).alias("from_jct"), F.element_at("node_ids", -1).alias("to_jct"), "pts",
        names.canonical_names(names.osm_names(F.col("tags")), config).alias("names"), maps.merge(tags, F.create_map(F.lit("way_id"), F.col("way_id").cast("string"))).alias("tags"),
    )
    ends = segs.select(F.explode(F.array("from_jct", "to_jct")).alias("jct_id")).distinct()
    node_tags = F.col("tags") if jct_props is None else maps.only_keys(F.col("tags"), jct_props)
    jcts = ends.join(data.nodes.select(F.col("node_id").alias("jct_id"), "pt", node_tags.alias("tags")), "jct_id")
    return segs, jcts
