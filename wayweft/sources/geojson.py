"""GeoJSON in and out."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.functions import geom, maps, names
from wayweft.operators.network import Network


#: First line of a collection that has each feature on a line of its own.
HEAD = '{"type": "FeatureCollection",'


def _rows(feature: DataFrame) -> DataFrame:
    """ord, f (variant) to feature rows; coordinates are read by the geometry's own type, so wrong shapes give nulls."""
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    read = lambda t: F.try_variant_get("f", "$.geometry.coordinates", t)
    parts = (
        F.when(kind == "Point", F.array(F.array(read("array<double>")))).when(kind.isin("LineString", "MultiPoint"), F.array(read("array<array<double>>")))
        .when(kind.isin("MultiLineString", "Polygon"), read("array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(read("array<array<array<array<double>>>>")))
    )
    return feature.select(
        "ord", F.try_variant_get("f", "$.id", "bigint").alias("feature_id"), kind.alias("geom_type"), F.transform(parts, geom.line_of).alias("parts"),
        F.coalesce(F.try_variant_get("f", "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>")).alias("props"),
    )


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of FeatureCollection files, or with lines=True of files with one feature a line, which split over tasks.

    A collection that has each feature on a line of its own, as write_features() lays them out, is split over tasks as
    well; any other is one row of one task. ord orders the features: in a collection that is read whole by position,
    otherwise by files and lines.
    """
    if lines:
        raw = spark.read.text(path).where("length(trim(value)) > 0").select(F.monotonically_increasing_id().alias("ord"), F.try_parse_json(F.regexp_replace("value", "^\x1e|,\\s*$", "")).alias("f"))
        return _rows(raw.where(F.try_variant_get("f", "$.type", "string") == "Feature"))
    head = spark.read.text(path).limit(1).first()
    if head and head.value.strip() == HEAD:
        return read_features(spark, path, lines=True)
    doc = spark.read.option("multiLine", True).schema("features array<variant>").json(path)
    return _rows(doc.select(F.posexplode("features").alias("ord", "f")).withColumn("ord", F.col("ord").cast("long")))


def features_of(collection: Mapping | list) -> list[dict]:
    """Features of a parsed collection, a list of features, or anything with a __geo_interface__."""
    collection = getattr(collection, "__geo_interface__", collection)
    if isinstance(collection, Mapping):
        collection = collection["features"] if collection.get("type") == "FeatureCollection" else [collection]
    return [dict(getattr(f, "__geo_interface__", f)) for f in collection]


def create_features(spark: SparkSession, features: Mapping | list) -> DataFrame:
    """Feature rows of Python objects."""
    rows = [(i, json.dumps(f)) for i, f in enumerate(features_of(features))]
    return _rows(spark.createDataFrame(rows, "ord long, text string").select("ord", F.try_parse_json("text").alias("f")))


def string_props(props: Column) -> Column:
    """map<string,variant> as map<string,string>, nulls left out."""
    texts = F.transform_values(props, lambda _, v: F.try_variant_get(v, "$", "string"))
    return F.map_filter(texts, lambda _, v: v.isNotNull())


def geometry_json(geom_type: Column, parts: Column) -> Column:
    """GeoJSON geometry text of a row."""
    at = lambda p: F.array(p["x"], p["y"])
    nested = F.transform(parts, lambda line: F.transform(line, at))
    coordinates = F.when(geom_type == "Point", F.to_json(nested[0][0])).when(geom_type.isin("LineString", "MultiPoint"), F.to_json(nested[0])).otherwise(F.to_json(nested))
    return F.concat(F.lit('{"type":'), F.to_json(F.array(geom_type)).substr(F.lit(2), F.length(geom_type) + 2), F.lit(',"coordinates":'), coordinates, F.lit("}"))


def feature_json(features: DataFrame) -> DataFrame:
    """ord, value: each feature as one line of GeoJSON. props may be a map of strings or variants."""
    ident = F.when(F.col("feature_id").isNotNull(), F.concat(F.lit('"id":'), F.col("feature_id").cast("string"), F.lit(","))).otherwise("")
    props = F.when(F.size("props") > 0, F.to_json("props")).otherwise("{}")
    return features.select("ord", F.concat(F.lit('{"type":"Feature",'), ident, F.lit('"geometry":'), geometry_json(F.col("geom_type"), F.col("parts")), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def crs_block(url: str) -> dict:
    """The link to a reference system that a collection carries."""
    return {"type": "link", "properties": {"href": url + "ogcwkt/", "type": "ogcwkt"}}


def write_features(features: DataFrame, path: str, srs_url: str | None = None) -> int:
    """One FeatureCollection file on the driver, fed a feature at a time in order of ord; returns how many."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEAD + "\n")
        if srs_url:
            f.write(f'"crs": {json.dumps(crs_block(srs_url))},\n')
        f.write('"features": [\n')
        for row in feature_json(features).orderBy("ord").select("value").toLocalIterator():
            f.write((",\n" if n else "") + row.value)
            n += 1
        f.write("\n]}\n")
    return n


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written by the tasks."""
    feature_json(features).select("value").write.mode("overwrite").text(path)


def network_features(net: Network) -> DataFrame:
    """Segments, then junctions, as features with namespaced keys; the network's own values keep their types."""
    own = maps.network_namespace(net.name)
    segs, jcts = net.segs, net.jcts
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    number = lambda v, kind="bigint": v.cast(kind).cast("variant")

    def props(tags: Column, values: dict[str, Column]) -> Column:
        typed = F.array(*[F.struct(F.lit(own + k).alias("key"), v.alias("value")) for k, v in values.items()])
        pairs = F.filter(typed, lambda e: e["value"].isNotNull())
        return maps.merge(F.transform_values(maps.add_prefix(tags, maps.namespace(net.name)), lambda _, v: v.cast("variant")), F.map_from_entries(pairs))

    name = F.when(F.size("names") > 0, F.array_join(F.array_sort("names"), ";"))
    s = segs.select(
        F.lit(0).alias("kind"), F.col("seg_id").alias("feature_id"), F.lit("LineString").alias("geom_type"), F.array("pts").alias("parts"),
        props(F.col("tags"), {
            "match_id": number(has(segs, "match_id")), "match_rev": number(F.when(has(segs, "match_id").isNotNull(), has(segs, "match_rev"))), "seg_id": number(F.col("seg_id")), "length": number(geom.length(F.col("pts")), "double"),
            "from_bearing": number(geom.from_bearing(F.col("pts")), "double"), "to_bearing": number(geom.to_bearing(F.col("pts")), "double"), "from_jct_id": number(F.col("from_jct")), "to_jct_id": number(F.col("to_jct")), "name": name.cast("variant"),
        }).alias("props"),
    )
    from wayweft.operators.network import jct_segments

    j = jcts.join(jct_segments(segs), "jct_id", "left").select(
        F.lit(1).alias("kind"), F.col("jct_id").alias("feature_id"), F.lit("Point").alias("geom_type"), F.array(F.array("pt")).alias("parts"),
        props(F.col("tags"), {"jct_id": number(F.col("jct_id")), "seg_ids": F.to_variant_object("seg_ids"), **{c: number(has(jcts, c)) for c in ("match_id", "import_src_id", "export_count")}}).alias("props"),
    )
    return s.unionByName(j).withColumn("ord", F.struct("kind", "feature_id")).drop("kind")


def write_network(net: Network, path: str, srs_url: str | None = None) -> int:
    """<path>.pnwk.geojson of a network."""
    return write_features(network_features(net), path if path.endswith(".geojson") else path + ".pnwk.geojson", srs_url)


def read_network(spark: SparkSession, path: str, name: str, units: str = "meters", config: names.CanonConfig = names.DEFAULT) -> Network:
    """A network from its file: points are junctions, lines segments; the network's own keys become columns again and
    the client's keys lose their prefix; names are split at ';'."""
    rows = read_features(spark, path if path.endswith(".geojson") else path + ".pnwk.geojson").withColumn("props", string_props(F.col("props")))
    own, client = maps.network_namespace(name), maps.namespace(name)
    value = lambda k, t="bigint": F.element_at("props", own + k).cast(t)
    tags = F.transform_keys(maps.drop_prefix(F.col("props"), own), lambda k, _: F.when(k.startswith(client), F.substring(k, F.lit(len(client) + 1), F.length(k))).otherwise(k))
    line = rows.where("geom_type = 'LineString'")
    segs = line.select(F.coalesce(value("seg_id"), F.col("feature_id")).alias("seg_id"), value("from_jct_id").alias("from_jct"), value("to_jct_id").alias("to_jct"), F.col("parts")[0].alias("pts"), names.canonical_names(F.coalesce(F.split(value("name", "string"), ";"), F.array().cast("array<string>")), config).alias("names"), tags.alias("tags"))
    jcts = rows.where("geom_type = 'Point'").select(F.coalesce(value("jct_id"), F.col("feature_id")).alias("jct_id"), F.col("parts")[0][0].alias("pt"), tags.alias("tags"))
    return Network(segs, jcts, name, units)


def osm_features(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (LineString, way_id and tags) and nodes (Point, nodeId and tags) as features."""
    from wayweft.operators.osm import with_points

    w = with_points(ways, nodes, ["way_id"]).select(F.lit(0).alias("kind"), F.col("way_id").alias("feature_id"), F.lit("LineString").alias("geom_type"), F.array("pts").alias("parts"), maps.merge(F.create_map(F.lit("way_id"), F.col("way_id").cast("string")), F.col("tags")).alias("props"))
    n = nodes.select(F.lit(1).alias("kind"), F.col("node_id").alias("feature_id"), F.lit("Point").alias("geom_type"), F.array(F.array("pt")).alias("parts"), maps.merge(F.create_map(F.lit("nodeId"), F.col("node_id").cast("string")), F.col("tags")).alias("props"))
    return w.unionByName(n).withColumn("ord", F.struct("kind", "feature_id")).drop("kind")
