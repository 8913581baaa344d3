"""Grid joins, network building, OSM preparation, whole jobs, streams."""

import csv
import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayweft.functions import names
from wayweft.operators import grid, ids, network, osm
from wayweft.operators.network import Network
from wayweft import cli
from wayweft.plans import job
from wayweft.sources import geojson, srs
from wayweft.streaming import names as stream_names

LINES = "seg_id long, from_jct long, to_jct long, pts array<struct<x:double,y:double>>, names array<string>, tags map<string,string>"


def segments(spark, *rows):
    return spark.createDataFrame([(i, f, t, [tuple(map(float, p)) for p in pts], list(n), {}) for i, f, t, pts, n in rows], LINES)


# Grid


def test_grid_joins_equal_brute_force(spark):
    rng = random.Random(1)
    a = [(i, (rng.uniform(-50, 50), rng.uniform(-50, 50))) for i in range(80)] + [(99, None)]
    b = [(i, (rng.uniform(-50, 50), rng.uniform(-50, 50))) for i in range(80)]
    left, right = spark.createDataFrame(a, "id1 long, p1 struct<x:double,y:double>"), spark.createDataFrame(b, "id2 long, p2 struct<x:double,y:double>")
    want = {(i, j) for i, p in a if p for j, q in b if math.dist(p, q) < 7}
    assert {(r.id1, r.id2) for r in grid.radius_join(left, right, 7.0).collect()} == want
    rects = [(k, x, y, x + w, y + w) for k, (x, y, w) in enumerate([(-60.0, -60.0, 40.0), (0.0, 0.0, 0.0), (-1.0, -1.0, 30.0)])]
    got = grid.rect_probe(spark.createDataFrame(rects, "rect_id long, x0 double, y0 double, x1 double, y1 double"), right.select(F.col("id2").alias("id"), F.col("p2").alias("p")), 9.0)
    assert {(r.rect_id, r.id) for r in got.collect()} == {(k, i) for k, x0, y0, x1, y1 in rects for i, (x, y) in b if x0 <= x < x1 and y0 <= y < y1}


def test_bins_vectors(spark):
    pts = spark.createDataFrame([(1, (1.0, 1.0)), (2, (2.0, 3.0)), (3, (1000.0, 1000000.0))], "id2 long, p2 struct<x:double,y:double>")
    n = lambda x, y, r: grid.radius_join(spark.createDataFrame([(0, (x, y))], "id1 long, p1 struct<x:double,y:double>"), pts, r).count()
    assert [n(1.0, 1.0, 0.5), n(1.0, 1.0, 100.0), n(1001.0, 1000001.0, 10.0), n(-1.0, 0.0, 0.1)] == [1, 2, 1, 0]


def test_isolated_seeds(spark):
    j = lambda *p: spark.createDataFrame([(i, (float(x), float(y)), ns) for i, x, y, ns in p], "jct_id long, pt struct<x:double,y:double>, names array<string>")
    one, two = j((1, 0, 0, ["A", "B"]), (2, 500, 0, ["A"])), j((11, 5, 0, ["B", "A"]), (12, 520, 0, ["C"]))
    assert [(r.jct1, r.jct2) for r in grid.isolated_seeds(one, two, 10, 100).collect()] == [(1, 11)]
    assert grid.isolated_seeds(one.union(j((3, 30, 0, []))), two, 10, 100).count() == 0
    common = lambda d: grid.two_names_in_common(F.col("names"), F.col("names_2"))
    assert [(r.jct1, r.jct2) for r in grid.isolated_seeds(one, two, 40, 100, [common]).collect()] == [(1, 11)]
    crowd = j(*[(100 + i, 3000 + i % 7, i // 7, []) for i in range(200)])  # none of them is alone, and the one beside them isn't either
    assert [(r.jct1, r.jct2) for r in grid.isolated_seeds(one.union(crowd).union(j((4, 3080, 0, []), (5, 9000, 0, []))), two.union(j((13, 3081, 0, []), (14, 9001, 0, []))), 10, 100).orderBy("jct1").collect()] == [(1, 11), (5, 14)]
    assert grid.jcts_near_point(two, 0, 0).count() == 1 and grid.jcts_near_point(two, 0, 0, 1500).count() == 2


def test_dense_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.n == r.k + 1 for r in ids.dense_ids(df, ["k"], "n").collect())
    assert sorted(r.n for r in ids.dense_ids(df.limit(3), ["k"], "n", -1, -1).collect()) == [-3, -2, -1]
    assert ids.dense_ids(df.limit(0), ["k"], "n").count() == 0


# Networks

CITY = [
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [10, 0, 5]]}, "properties": {"OBJECTID": 1, "FULLNAME": "I80 E UNIVERSITY RAMP", "CATEGORY": "CONNECTOR"}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[10, 0], [10, 10], [20, 20]]}, "properties": {"OBJECTID": 2, "FULLNAME": "TRAIL", "CATEGORY": "PEDESTRIAN"}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [20, 20]]}, "properties": {"OBJECTID": 3, "FULLNAME": "RAIL", "CATEGORY": "LIGHT RAIL"}},
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {"CATEGORY": "MINOR"}},
    {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[20, 20], [0, 0]], [[5, 5], [5, 5], [6, 6]]]}, "properties": {"FULLNAME": "A ST", "CATEGORY": "MINOR"}},
]


def test_network_from_centerlines(spark):
    rows = geojson.create_features(spark, CITY).withColumn("props", geojson.string_props(F.col("props")))
    net = job.berkeley_network(rows, name="city")
    segs = {r.seg_id: r for r in net.segs.collect()}
    assert {k: (r.from_jct, r.to_jct, len(r.pts)) for k, r in segs.items()} == {1: (1, 2, 2), 2: (2, 3, 3), 3: (3, 1, 2), 4: (4, 5, 3)}
    assert segs[1].names == ["I 80", "I 80 E UNIVERSITY RAMP"] and segs[2].names == [] and segs[3].names == ["A ST"]
    assert network.check(net).count() == 0
    clipped = job.berkeley_network(rows, clip=(5.5, 5.5, 7.0, 7.0))
    assert [r.seg_id for r in clipped.segs.collect()] == [4] and clipped.jcts.count() == 2
    assert job.berkeley_network(rows, props=["OBJECTID"]).segs.where("seg_id = 1").first().tags == {"OBJECTID": "1"}
    assert tuple(network.bbox(net.segs).first()) == (0, 0, 20, 20) and network.from_centerlines(rows.limit(0)).segs.count() == 0


def test_rlis_network(spark):
    rows = geojson.create_features(spark, [{"type": "Feature", "geometry": CITY[0]["geometry"], "properties": {"PREFIX": "NE", "STREETNAME": "I84-I205", "FTYPE": "RAMP"}}]).withColumn("props", geojson.string_props(F.col("props")))
    assert job.rlis_network(rows).segs.first().names == ["I 205", "I 84", "NE I 205", "NE I 84", "NE I84 I 205 RAMP"]


def test_half_edges_and_next(spark):
    star = segments(spark, (1, 0, 1, [(0, 0), (0, 100)], "A"), (2, 0, 2, [(0, 0), (100, 0)], "B"), (3, 3, 0, [(0, -100), (0, 0)], "A"), (4, 5, 5, [(500, 0), (510, 10), (500, 0)], ""))
    half = network.half_edges(star)
    got = {(r.jct, r.seg_id): (r.upstream, round(r.bearing)) for r in half.collect()}
    assert got[0, 1] == (False, 0) and got[1, 1] == (True, 180) and got[0, 3] == (True, 180) and (5, 4) in got and len(got) == 7
    assert network.half_edges(star, loops_twice=True).count() == 8
    after = {(r.seg_id, r.jct): r.next_seg for r in network.next_half_edge(half).collect()}
    assert after[3, 3] == 1 and after[1, 1] == 3 and (1, 0) not in after
    assert {r.jct_id: (r.seg_ids, r.degree) for r in network.jct_segments(star).collect()}[0] == ([1, 2, 3], 3)
    assert {r.jct_id: r.names for r in network.jct_names(star).collect()}[0] == ["A", "B"]


def test_split_segments(spark):
    base = segments(spark, (1, 1, 2, [(0, 0), (1, 0), (1, 1)], "A"), (2, 2, 3, [(1, 1), (5, 1)], "B"))
    cuts = spark.createDataFrame([(1, 0.5, False, -1, -1), (2, 99.0, True, -2, -2)], "seg_id long, d double, from_start boolean, new_jct long, new_seg long")
    got = {r.seg_id: (r.from_jct, r.to_jct, [(p.x, p.y) for p in r.pts], r.names) for r in network.split_segments(base, cuts).collect()}
    assert got == {1: (-1, 2, [(1, 0.5), (1, 1)], ["A"]), -1: (1, -1, [(0, 0), (1, 0), (1, 0.5)], ["A"]), 2: (2, 3, [(1, 1), (5, 1)], ["B"])}


def test_check_finds_faults(spark):
    segs = segments(spark, (1, 1, 2, [(0, 0), (1, 0)], ""), (1, 1, 9, [(0, 0), (1, 0)], ""), (3, 1, 2, [(5, 5), (1, 0)], ""), (4, 1, 1, [(0, 0)], ""))
    jcts = spark.createDataFrame([(1, (0.0, 0.0), {}), (2, (1.0, 0.0), {}), (3, (0.0, 0.0), {})], "jct_id long, pt struct<x:double,y:double>, tags map<string,string>")
    got = {(r.kind, r.id) for r in network.check(Network(segs, jcts)).collect()}
    assert {("short segment", 4), ("repeated segment id", 1), ("to_jct missing", 1), ("from_jct elsewhere", 3), ("junction without segment", 3)} <= got


# OSM


def test_osm_preparation(spark):
    nodes = spark.createDataFrame([(i, (float(i), 0.0), {"k": "v"} if i == 9 else {}) for i in range(1, 12)], "node_id long, pt struct<x:double,y:double>, tags map<string,string>")
    hw = {"highway": "residential", "name": "Main St", "ref": "1;2"}
    ways = spark.createDataFrame([(1, hw, [1, 2, 2, 77, 3, 4]), (2, hw, [3, 5, 6, 5]), (3, {"railway": "rail"}, [7, 8]), (4, hw, [10]), (5, hw, []), (6, hw, [88, 89])], "way_id long, tags map<string,string>, node_ids array<long>")
    data = osm.prepare(ways, nodes)
    assert {r.way_id: r.node_ids for r in data.ways.collect()} == {1: [1, 2, 3, 4], 2: [3, 5, 6, 5]}
    assert sorted(r.node_id for r in data.nodes.collect()) == [1, 2, 3, 4, 5, 6, 9]
    assert {(r.node_id, r.way_id): r.refs for r in osm.node_ref_counts(data.ways).collect()}[5, 2] == 2
    assert [r.node_id for r in osm.intersections(data.ways).collect()] == [3]
    parts = {(r.way_id, r.idx): r.node_ids for r in osm.split_at_junctions(data.ways).collect()}
    assert parts == {(1, 0): [1, 2, 3], (1, 1): [3, 4], (2, 0): [3, 5, 6, 5]}
    segs, jcts = osm.create_path_network(data, seg_props=["name"])
    assert [(r.seg_id, r.from_jct, r.to_jct, [p.x for p in r.pts]) for r in segs.orderBy("seg_id").collect()] == [(1, 1, 3, [1, 2, 3]), (2, 3, 4, [3, 4]), (3, 3, 5, [3, 5, 6, 5])]
    assert segs.first().names == ["1", "2", "MAIN ST"] and segs.first().tags == {"name": "Main St", "way_id": "1"} and jcts.count() == 4
    assert network.check(Network(segs, jcts)).count() == 0
    clipped = osm.prepare(ways, nodes, clip=(0.0, -1.0, 3.5, 1.0))
    assert {r.way_id: r.node_ids for r in clipped.ways.collect()} == {1: [1, 2, 3]}
    empty = osm.create_path_network(osm.prepare(ways.limit(0), nodes))
    assert empty[0].count() == 0 and empty[1].count() == 0


# Whole jobs


def test_names_cross_check(spark, tmp_path):
    """A block of streets in both sources; two names differ, and one pair is only spelt differently."""
    proj4 = "+proj=utm +zone=10 +datum=WGS84 +units=m"
    system = srs.SRS(url="http://example.org/ref/epsg/32610/", auth_name="EPSG", auth_srid=32610, proj4text=proj4)
    proj, x0, y0 = system.resolved().projection(), 560_000.0, 4_190_000.0
    at = {(i, j): (x0 + 120 * i, y0 + 120 * j) for i in range(3) for j in range(3)}
    streets = [((i, j), (i, j + 1), f"{'ABC'[i]} STREET") for i in range(3) for j in range(2)] + [((i, j), (i + 1, j), f"{'XYZ'[j]} AVE") for i in range(2) for j in range(3)]
    features = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [at[a], at[b]]}, "properties": {"FULLNAME": n, "CATEGORY": "MINOR"}} for a, b, n in streets]
    city = str(tmp_path / "city.geojson")
    json.dump({"type": "FeatureCollection", "features": features}, open(city, "w"))
    node = {k: n for n, k in enumerate(at, 1)}
    spelled = {"A STREET": "A St", "B STREET": "Bee Boulevard", "C STREET": "C Street", "X AVE": "X Avenue", "Y AVE": "Why Road & Co", "Z AVE": "Z Av"}
    rng = random.Random(4)
    places = {k: proj.numbers(x + rng.uniform(-2, 2), y + rng.uniform(-2, 2), reverse=True) for k, (x, y) in at.items()}
    elements = [{"type": "node", "id": n, "lon": places[k][0], "lat": places[k][1]} for k, n in node.items()]
    elements += [{"type": "way", "id": 100 + n, "nodes": [node[a], node[b]], "tags": {"highway": "residential", "name": spelled[s], **({"source:name": "survey"} if s[0] == "B" else {})}} for n, (a, b, s) in enumerate(streets)]
    answer = str(tmp_path / "osm.json")
    json.dump({"elements": elements}, open(answer, "w"))
    j = job.ConflationJob(spark, "Test", reference=system, out_dir=str(tmp_path / "out"), city_geojson=city, osm_file=answer)
    assert j.names_cross_check() == 2
    table = list(csv.reader(open(tmp_path / "out" / "name_mismatches.csv")))
    assert table[0][0].startswith("Test name mismatches between city centerline and OSM (generated: ") and table[1] == ["osm", "city", "way", "osmVerified"]
    assert [r[:2] for r in table[2:]] == [["BEE BLVD", "B ST"], ["WHY RD CO", "Y AVE"]] and table[2][3] == "True" and table[3][3] == "False" and table[2][2].startswith("http://www.openstreetmap.org/way/1")
    web = json.load(open(tmp_path / "out" / "name_mismatches.geojson"))["features"]
    assert len(web) == 4 and all(-123 < f["geometry"]["coordinates"][0][0] < -122 for f in web)
    assert j.bbox == (x0 - 1000, y0 - 1000, x0 + 240 + 1000, y0 + 240 + 1000)
    with pytest.raises(ValueError):
        job.ConflationJob(spark, "Test", reference=system, units="feet", out_dir=str(tmp_path / "out"))
    # The command line, and a folder that only the tasks write to.
    assert cli.main(["cross-check", "--project", "Test", "--epsg", "32610", "--city", city, "--osm", answer, "--out", "file://" + str(tmp_path / "far"), "--no-export"], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "far" / "name_mismatches.csv")).count() == 2
    # Other rules of names: a word of the city's own.
    own = job.ConflationJob(spark, "Test", reference=system, out_dir=str(tmp_path / "own"), city_geojson=city, osm_file=answer, export=False, config=names.DEFAULT.with_words({"BEE": "B", "BOULEVARD": "ST"}))
    assert own.names_cross_check() == 1 and not (tmp_path / "own" / "city.pnwk.geojson").exists()


# Streams


def test_stream_equals_table(spark, tmp_path):
    rows = [("A St", "A Street", 90, datetime(2023, 1, 1)), ("A St", "B Road", 90, datetime(2023, 1, 1, 5)), ("A St", "C Road", 10, datetime(2023, 1, 2)), (None, "X", 90, datetime(2023, 1, 3))]
    df = spark.createDataFrame(rows, "a string, b string, score int, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_names.mismatches(stream, "a", "b", "score").writeStream.format("memory").queryName("mism").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("mism").select("a", "b").collect()] == [tuple(r) for r in stream_names.mismatches(df, "a", "b", "score").select("a", "b").collect()] == [("A St", "B Road")]
    q = stream_names.mismatch_counts(stream, "a", "b", "at").writeStream.format("memory").queryName("cnt").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("cnt").collect())) == sorted(map(str, stream_names.mismatch_counts(df, "a", "b", "at").collect()))


def test_names_are_canonical_in_networks(spark):
    assert spark.range(1).select(names.canonical_names(F.array(F.lit("b street"), F.lit("B St"), F.lit(None), F.lit("'"))).alias("x")).first().x == ["B ST"]
