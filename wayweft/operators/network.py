"""Path networks: segments and junctions as two DataFrames.

segs: seg_id, from_jct, to_jct, pts, names, tags (and match_id, match_rev once matched);  jcts: jct_id, pt, tags.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions import geom, maps, names
from wayweft.operators.ids import dense_ids


@dataclass(frozen=True)
class Network:
    """A path network with what its lengths mean."""

    segs: DataFrame
    jcts: DataFrame
    name: str = ""
    units: str = "meters"
    srs: object = None

    @property
    def scale(self) -> dict[str, float]:
        return maps.scales(self.units)

    def with_(self, **changes) -> "Network":
        return replace(self, **changes)


def line_parts(features: DataFrame) -> DataFrame:
    """One row for each line of LineString and MultiLineString features (ord, geom_type, parts, ...): adds part, pts."""
    return features.where(F.col("geom_type").isin("LineString", "MultiLineString")).select("*", F.posexplode("parts").alias("part", "pts")).drop("parts")


def from_centerlines(
    features: DataFrame, names_of: Callable[[DataFrame], Column] | None = None, keep: Column | None = None, props: Sequence[str] | None = None,
    clip: tuple[float, float, float, float] | None = None, name: str = "", units: str = "meters", config: names.CanonConfig = names.DEFAULT,
) -> Network:
    """A network from line features (ord, geom_type, parts, props map<string,string>).

    keep filters features; segments are numbered in input order after it and before clipping, so clipped segments leave
    gaps. Ends at exactly the same place share a junction; junctions are numbered as first seen. Other geometries are
    skipped, parts of fewer than two points too. config: rules of the canonical names.
    """
    if keep is not None:
        features = features.where(keep)
    parts = line_parts(features).where(F.size("pts") >= 2)
    tags = F.col("props") if props is None else maps.only_keys(F.col("props"), props)
    own = names_of(parts) if names_of else F.array().cast("array<string>")
    rows = dense_ids(parts.select("ord", "part", "pts", own.alias("names"), tags.alias("tags")), ["ord", "part"], "seg_id")
    if clip is not None:
        rows = rows.where(geom.any_in_rect(F.col("pts"), clip))
    rows = rows.withColumns({"p": geom.first(F.col("pts")), "q": geom.last(F.col("pts"))})
    zero = lambda v: v + F.lit(0.0)  # noqa: E731  (-0.0 and 0.0 are one place)
    ends = rows.select(F.explode(F.array(F.struct((F.col("seg_id") * 2).alias("at"), F.col("p").alias("pt")), F.struct((F.col("seg_id") * 2 + 1).alias("at"), F.col("q").alias("pt")))).alias("e"))
    places = ends.groupBy(zero(F.col("e.pt.x")).alias("x"), zero(F.col("e.pt.y")).alias("y")).agg(F.min("e.at").alias("at"))
    places = dense_ids(places, ["at"], "jct_id").select("jct_id", "x", "y")
    for end, jct in (("p", "from_jct"), ("q", "to_jct")):
        rows = rows.withColumns({"x": zero(F.col(f"{end}.x")), "y": zero(F.col(f"{end}.y"))}).join(places.withColumnRenamed("jct_id", jct), ["x", "y"]).drop("x", "y")
    segs = rows.select("seg_id", "from_jct", "to_jct", "pts", names.canonical_names(F.col("names"), config).alias("names"), "tags")
    jcts = places.select("jct_id", F.struct("x", "y").alias("pt"), F.create_map().cast("map<string,string>").alias("tags"))
    return Network(segs, jcts, name, units)


def half_edges(segs: DataFrame, loops_twice: bool = False) -> DataFrame:
    """Directed view: jct, end_jct, seg_id, upstream, bearing (on leaving jct), pts from jct outward, len.

    A loop gives one half-edge, against its direction but with its starting bearing, unless loops_twice.
    """
    with_len = segs.withColumn("len", geom.length(F.col("pts")))
    stored = "from_bearing" in segs.columns
    out = F.col("from_bearing") if stored else geom.from_bearing(F.col("pts"))
    back = F.col("to_bearing") if stored else geom.to_bearing(F.col("pts"))
    rest = [c for c in segs.columns if c not in ("from_jct", "to_jct", "pts", "from_bearing", "to_bearing")]
    down = with_len.select(F.col("from_jct").alias("jct"), F.col("to_jct").alias("end_jct"), *rest, F.lit(False).alias("upstream"), out.alias("bearing"), "pts", "len")
    bearing = back if loops_twice else F.when(F.col("from_jct") == F.col("to_jct"), out).otherwise(back)
    up = with_len.select(F.col("to_jct").alias("jct"), F.col("from_jct").alias("end_jct"), *rest, F.lit(True).alias("upstream"), bearing.alias("bearing"), F.reverse("pts").alias("pts"), "len")
    return (down if loops_twice else down.where("jct <> end_jct")).unionByName(up)


def jct_segments(segs: DataFrame) -> DataFrame:
    """jct_id, seg_ids (sorted, each once), degree."""
    ends = segs.select(F.explode(F.array_distinct(F.array("from_jct", "to_jct"))).alias("jct_id"), "seg_id")
    return ends.groupBy("jct_id").agg(F.array_sort(F.collect_set("seg_id")).alias("seg_ids")).withColumn("degree", F.size("seg_ids"))


def jct_names(segs: DataFrame) -> DataFrame:
    """jct_id, names: union of the names of its segments, sorted."""
    ends = segs.select(F.explode(F.array_distinct(F.array("from_jct", "to_jct"))).alias("jct_id"), F.explode("names").alias("name")).distinct()
    return ends.groupBy("jct_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def next_half_edge(half: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """For half-edges (default: all) the one that continues best at the far end: seg_id, jct, next_seg, next_end, delta.

    The smallest angle between the starting bearings, below 180 and at most 90; the edge itself, reversed, is a
    candidate too; on a tie the lowest segment id.
    """
    of = half if of is None else of
    a = of.select("seg_id", "jct", "end_jct", F.col("bearing").alias("b1"))
    b = half.select(F.col("jct").alias("end_jct"), F.col("seg_id").alias("next_seg"), F.col("end_jct").alias("next_end"), F.col("bearing").alias("b2"))
    met = a.join(b, "end_jct").withColumn("delta", geom.compass_bearing_delta(F.col("b1"), F.col("b2")))
    best = met.where("delta < 180").groupBy("seg_id", "jct").agg(F.min(F.struct("delta", "next_seg", "next_end")).alias("m"))
    return best.where("m.delta <= 90").select("seg_id", "jct", "m.next_seg", "m.next_end", "m.delta")


def split_segments(segs: DataFrame, cuts: DataFrame) -> DataFrame:
    """segs with those of cuts (seg_id, d, from_start, new_jct, new_seg) split at distance d from the given end.

    The piece at that end keeps its id, the rest gets new_seg with the same names and tags; both meet at new_jct.
    A cut that is not inside the segment is ignored.
    """
    columns = segs.columns
    c = segs.join(cuts, "seg_id", "left")
    at = F.when(F.col("from_start"), F.col("d")).otherwise(geom.length(F.col("pts")) - F.col("d"))
    c = c.withColumn("_cut", F.when(F.col("new_seg").isNotNull(), geom.cut(F.col("pts"), at)))
    fixed = [k for k in columns if k not in ("seg_id", "from_jct", "to_jct", "pts")]
    piece = lambda i, f, t, p: F.struct(i.alias("seg_id"), f.alias("from_jct"), t.alias("to_jct"), p.alias("pts"))
    s, n, f, t, j = (F.col(k) for k in ("seg_id", "new_seg", "from_jct", "to_jct", "new_jct"))
    head, tail = F.col("_cut.head"), F.col("_cut.tail")
    pieces = F.when(F.col("_cut").isNull(), F.array(piece(s, f, t, F.col("pts")))).when(F.col("from_start"), F.array(piece(s, f, j, head), piece(n, j, t, tail))).otherwise(F.array(piece(s, j, t, tail), piece(n, f, j, head)))
    return c.select(*fixed, F.explode(pieces).alias("_p")).select(*[F.col(f"_p.{k}").alias(k) if k in ("seg_id", "from_jct", "to_jct", "pts") else F.col(k) for k in columns])


def check(net: Network) -> DataFrame:
    """Violations of integrity: kind, id. Empty for a sound network."""
    segs, jcts = net.segs, net.jcts
    bad = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    twice = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    out = bad(segs.where(F.coalesce(F.size("pts"), F.lit(0)) < 2), "short segment", "seg_id").unionByName(bad(twice(segs, "seg_id"), "repeated segment id", "seg_id")).unionByName(bad(twice(jcts, "jct_id"), "repeated junction id", "jct_id"))
    for end, at in (("from_jct", geom.first(F.col("pts"))), ("to_jct", geom.last(F.col("pts")))):
        met = segs.withColumn("_at", at).join(jcts.select(F.col("jct_id").alias(end), "pt"), end, "left")
        out = out.unionByName(bad(met.where("pt IS NULL"), f"{end} missing", "seg_id")).unionByName(bad(met.where("pt IS NOT NULL AND (pt.x <> _at.x OR pt.y <> _at.y)"), f"{end} elsewhere", "seg_id"))
    ends = segs.select(F.explode(F.array("from_jct", "to_jct")).alias("jct_id"))
    return out.unionByName(bad(jcts.join(ends, "jct_id", "left_anti"), "junction without segment", "jct_id"))


def match_stats(net: Network) -> DataFrame:
    """One row: counts, matched counts and percentages of junctions and segments, and miles."""
    miles = geom.in_units(geom.length(F.col("pts")), net.units, "miles")
    seg = net.segs.agg(
        F.count("*").alias("num_segs"), F.count_if(F.col("match_id").isNotNull()).alias("num_segs_matched"),
        F.coalesce(F.sum(miles), F.lit(0.0)).alias("miles"), F.coalesce(F.sum(F.when(F.col("match_id").isNotNull(), miles)), F.lit(0.0)).alias("miles_matched"),
    )
    matched = F.col("match_id").isNotNull() if "match_id" in net.jcts.columns else F.lit(False)
    both = seg.withColumns({"num_jcts": net.jcts.agg(F.count("*")).scalar(), "num_jcts_matched": net.jcts.agg(F.count_if(matched)).scalar()})
    return both.withColumns({"percent_segs_matched": maps.percent(F.col("num_segs_matched"), F.col("num_segs")), "percent_jcts_matched": maps.percent(F.col("num_jcts_matched"), F.col("num_jcts"))})


def bbox(lines: DataFrame, pts: str = "pts", by: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of `by`) xmin, ymin, xmax, ymax over all points; nulls for none."""
    axis = lambda end, k: end(F.transform(pts, lambda p: p[k]))
    return lines.select(*by, axis(F.array_min, "x").alias("a"), axis(F.array_min, "y").alias("b"), axis(F.array_max, "x").alias("c"), axis(F.array_max, "y").alias("d")).groupBy(*by).agg(F.min("a").alias("xmin"), F.min("b").alias("ymin"), F.max("c").alias("xmax"), F.max("d").alias("ymax"))
