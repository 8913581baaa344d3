"""Files and tables in and out."""

import csv
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayweft.operators import features
from wayweft.operators.network import Network
from wayweft.sources import fetch, geojson, networks, osm_files, pbf, shapefile, srs, tables

FEATURES = [
    {"type": "Feature", "id": 5, "geometry": {"type": "LineString", "coordinates": [[10, 11, 3], [20, 21]]}, "properties": {"OBJECTID": 1, "name": "I80, \"E\"", "x": None}},
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [200, 210]}, "properties": {"OBJECTID": 2, "name": "PILEGÅRDEN"}},
    {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[100, 110], [120, 130]], [[1, 2], [3, 4], [5, 6]]]}, "properties": {"OBJECTID": 3}},
]


@pytest.fixture
def rows(spark):
    return geojson.create_features(spark, {"type": "FeatureCollection", "features": FEATURES})


def test_read_geojson(spark, tmp_path, rows):
    path = str(tmp_path / "f.geojson")
    json.dump({"type": "FeatureCollection", "features": FEATURES}, open(path, "w"))
    for df in (rows, geojson.read_features(spark, path)):
        got = df.orderBy("ord").collect()
        assert [(r.ord, r.feature_id, r.geom_type, len(r.parts)) for r in got] == [(0, 5, "LineString", 1), (1, None, "Point", 1), (2, None, "MultiLineString", 2)]
        assert [(p.x, p.y) for p in got[0].parts[0]] == [(10, 11), (20, 21)] and [(p.x, p.y) for p in got[1].parts[0]] == [(200, 210)]
    lines = str(tmp_path / "lines.txt")
    open(lines, "w").write("\n".join(map(json.dumps, FEATURES)) + "\n\nbroken{\n")
    assert geojson.read_features(spark, lines, lines=True).count() == 3


def test_write_geojson(spark, tmp_path, rows):
    path = str(tmp_path / "out.geojson")
    assert geojson.write_features(rows, path, "http://example.org/ref/epsg/32610/") == 3
    doc = json.load(open(path))
    assert doc["crs"]["properties"]["href"].endswith("/32610/ogcwkt/")
    assert doc["features"][0]["id"] == 5 and doc["features"][0]["properties"]["name"] == 'I80, "E"' and doc["features"][1]["geometry"] == {"type": "Point", "coordinates": [200.0, 210.0]}
    assert doc["features"][2]["geometry"]["coordinates"][1][2] == [5.0, 6.0]
    geojson.write_feature_lines(rows, str(tmp_path / "many"))
    assert geojson.read_features(spark, str(tmp_path / "many"), lines=True).count() == 3
    assert geojson.write_features(rows.limit(0), path) == 0 and json.load(open(path))["features"] == []


def test_filter_features(spark, rows):
    n = lambda **k: features.filter_features(rows, **k).count()
    oid = F.try_variant_get(F.element_at("props", "OBJECTID"), "$", "int")
    assert n(geom_type="Point") == 1 and n(where=oid > 1) == 2 and n(clip=(0, 0, 15, 15)) == 2 and n(clip=(500, 0, 600, 600)) == 0
    got = features.filter_features(rows, where=oid == 1, specs=[("label", "TEXT", "name"), ("none", "TEXT", "absent")]).first()
    assert list(got.props) == ["label"]
    assert tuple(features.bbox(rows).first()) == (1, 2, 200, 210) and tuple(features.skipped_counts(rows).first()) == (1, 3)


def test_schema_inference(spark):
    point = lambda **p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": p}
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"other": 10}}
    rows = geojson.create_features(spark, [point(name="a", addr=12, gpa=3.5), point(fish="f", addr="12b", gpa=4, foo=None), point(num=2**33), line, point(Num=2), point(NUM="many"), point(flag=True)])
    specs = features.infer_specs(rows)
    assert specs == [("NUM", "TEXT", "NUM"), ("Num", "INT", "Num"), ("addr", "TEXT", "addr"), ("fish", "TEXT", "fish"), ("flag", "INT", "flag"), ("gpa", "FLOAT", "gpa"), ("name", "TEXT", "name"), ("num", "BIGINT", "num"), ("geometry", "POINT", "geometry")]
    assert [s[0] for s in features.fix_specs(specs)] == ["NUM", "Num$1", "addr", "fish", "flag", "gpa", "name", "num$2", "geometry"]
    assert features.infer_specs(rows, "LineString") == [("other", "INT", "other"), ("geometry", "LINESTRING", "geometry")]
    assert features.fix_specs([("a",), ("A", "INT"), ("b", "INT", "c"), "d"]) == [("a", "TEXT", "a"), ("A$1", "INT", "A"), ("b", "INT", "c"), ("d", "TEXT", "d")]
    assert features.infer_specs(rows.limit(0)) == []


def test_csv_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 'pointy "dude"', "LIGHT, RAIL STOP"), (2, "HVF VED PILEGÅRDEN", None)], "n int, a string, b string").orderBy("n")
    path = str(tmp_path / "r.csv")
    assert tables.write_report(df, path, ["a", "b"], title="T (generated: now)") == 2
    assert list(csv.reader(open(path, encoding="utf-8", newline=""))) == [["T (generated: now)"], ["a", "b"], ['pointy "dude"', "LIGHT, RAIL STOP"], ["HVF VED PILEGÅRDEN", ""]]
    got = [tuple(r) for r in tables.read_csv(spark, path, 2).collect()]
    assert got[0] == ("T (generated: now)", None) and got[2] == ('pointy "dude"', "LIGHT, RAIL STOP") and got[3][0] == "HVF VED PILEGÅRDEN"
    with pytest.raises(KeyError):
        tables.write_report(df, path, ["absent"])
    tables.write_csv_files(df, str(tmp_path / "many"))
    text = "".join(open(tmp_path / "many" / f, newline="").read() for f in os.listdir(tmp_path / "many") if f.endswith(".csv"))
    assert '"pointy ""dude"""' in text and "\r\n" in text


def test_large_answers_are_split(spark, tmp_path, monkeypatch):
    """A long answer becomes several rows, on one line or many; other shapes stay whole and are read as before."""
    import io

    elements = [{"type": "node", "id": i, "lat": 38.5, "lon": -i / 7, "tags": {"name": "\u00e9 ],}" * (i % 3)}} for i in range(25_000)]
    doc = {"version": 0.6, "elements": elements, "n": 12}
    (tmp_path / "a.json").write_text(json.dumps(doc), encoding="utf-8")
    assert osm_files.answers_of(spark, str(tmp_path / "a.json")).count() > 1
    read = lambda: osm_files.read_json(spark, str(tmp_path / "a.json")).nodes
    assert read().agg(F.count("*"), F.count_distinct("node_id"), F.round(F.sum("pt.x"), 3)).first()[:] == (25_000, 25_000, round(sum(e["lon"] for e in elements), 3))
    (tmp_path / "a.json").write_text(json.dumps(json.dumps(doc)))
    assert read().count() == 25_000
    (tmp_path / "a.json").write_text(json.dumps(doc)[:-1])
    assert read().count() == 0
    monkeypatch.setattr(osm_files, "PART", 7)
    for text in (json.dumps(doc | {"elements": elements[:9]}, indent=i) for i in (None, 1)):
        parts = list(osm_files.split_answer(io.StringIO(text)))
        assert len(parts) == 9 and [e for p in parts for e in json.loads(p)["elements"]] == elements[:9]
    assert list(osm_files.split_answer(io.StringIO(' {"elements": [ ] } '))) == [] == list(osm_files.split_answer(io.StringIO("{}")))
    for text in ('{"elements": [1], "elements": [2]}', '{"elements": 1}', "[1]", '{"elements": [1,]}', '{"elements": [1]} 2', "", '{"a" 1}'):
        with pytest.raises(ValueError):
            list(osm_files.split_answer(io.StringIO(text)))


XML = """<?xml version="1.0"?><osm version="0.6"><bounds minlat="0"/>
<node id="1" lat="38.0" lon="-122.0"><tag k="addr:city" v="X"/></node><node id="2" lat="38.1" lon="-122.1"/>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="1"/><tag k="leisure" v="park"/><tag k="name" v="A &amp; B"/></way><relation id="9"><member type="way" ref="7"/></relation></osm>"""


def test_osm_xml_and_json(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    doc = {"elements": [{"type": "node", "id": 1, "lat": 38.0, "lon": -122.0, "tags": {"addr:city": "X"}}, {"type": "node", "id": 2, "lat": 38.1, "lon": -122.1}, {"type": "way", "id": 7, "nodes": [1, 2, 1], "tags": {"leisure": "park", "name": "A & B"}}, {"type": "relation", "id": 9}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    for data in (osm_files.read_xml(spark, str(tmp_path / "a.osm")), osm_files.read_json(spark, str(tmp_path / "a.json"))):
        assert [tuple(r) for r in data.ways.collect()] == [(7, {"leisure": "park", "name": "A & B"}, [1, 2, 1])]
        assert sorted((r.node_id, r.pt.x, r.pt.y, r.tags) for r in data.nodes.collect()) == [(1, -122.0, 38.0, {"addr:city": "X"}), (2, -122.1, 38.1, {})]
    assert 'way["highway"](37.0,-123.0,38.0,-122.0)' in osm_files.overpass_query((-123.0, 37.0, -122.0, 38.0))


def _varint(v):
    out = b""
    while True:
        out += bytes([v & 127 | (128 if v > 127 else 0)])
        v >>= 7
        if not v:
            return out


def _zig(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def _field(n, v):
    return _varint(n << 3) + _varint(v) if isinstance(v, int) else _varint(n << 3 | 2) + _varint(len(v)) + v


def _pack(vs, signed=False):
    return b"".join(_varint(_zig(v) if signed else v) for v in vs)


def test_pbf(spark, tmp_path):
    texts = b"".join(_field(1, t) for t in (b"", b"highway", b"residential", b"k", b"v"))
    dense = _field(1, _pack([1, 1], True)) + _field(8, _pack([380000000, 1000000], True)) + _field(9, _pack([-1220000000, -1000000], True)) + _field(10, _pack([3, 4, 0, 0]))
    way = _field(1, 7) + _field(2, _pack([1])) + _field(3, _pack([2])) + _field(8, _pack([1, 1, -1], True))
    block = _field(1, texts) + _field(2, _field(2, dense)) + _field(2, _field(3, way))

    def blob(kind, data, packed=True):
        body = (_field(3, zlib.compress(data)) + _field(2, len(data))) if packed else _field(1, data)
        head = _field(1, kind) + _field(3, len(body))
        return struct.pack(">I", len(head)) + head + body

    path = tmp_path / "a.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block) + blob(b"OSMData", block, False))
    assert [k for _, _, k in pbf.blobs(str(path))] == ["OSMHeader", "OSMData", "OSMData"] == [k for _, _, k in pbf.blobs(path.as_uri())]
    data = osm_files.read_pbf(spark, str(path))
    assert [(r.way_id, r.tags, r.node_ids) for r in data.ways.collect()] == [(7, {"highway": "residential"}, [1, 2, 1])] * 2
    nodes = {r.node_id: (round(r.pt.x, 7), round(r.pt.y, 7), r.tags) for r in data.nodes.collect()}
    assert nodes == {1: (-122.0, 38.0, {"k": "v"}), 2: (-122.1, 38.1, {})}


def write_shapefile(path, lines, values):
    records, index, at = b"", b"", 50
    for k, parts in enumerate(lines, 1):
        if parts is None:
            body = struct.pack("<i", 0)
        else:
            flat = [p for part in parts for p in part]
            starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
            body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        records += struct.pack(">2i", k, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    open(path, "wb").write(head(len(records)) + records)
    open(path[:-3] + "shx", "wb").write(head(len(index)) + index)
    fields = [("NAME", "C", 12, 0), ("N", "N", 6, 0), ("F", "N", 8, 2)]
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(values), 32 + 32 * len(fields) + 1, 1 + sum(f[2] for f in fields))
    head += b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    body = b"".join(b" " + n.encode().ljust(12) + (b"" if i is None else str(i).encode()).rjust(6) + f"{x:.2f}".encode().rjust(8) for n, i, x in values)
    open(path[:-3] + "dbf", "wb").write(head + body + b"\x1a")


def test_shapefile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s.shp")
    write_shapefile(path, [[[(0, 0), (1, 1)]], None, [[(5, 5), (6, 6)], [(7, 7), (8, 8)]]], [("Å One", 1, 1.5), ("two", 2, 0), ("three", None, 2.25)])
    for _ in range(2):
        got = shapefile.read_features(spark, path).orderBy("ord").collect()
        assert [(r.ord, r.geom_type, len(r.parts)) for r in got] == [(0, "LineString", 1), (2, "MultiLineString", 2)]
        os.path.exists(path[:-3] + "shx") and os.remove(path[:-3] + "shx")  # works without the index too
    assert shapefile.read_features(spark, path, (4, 4, 10, 10)).count() == 1
    out = str(tmp_path / "s.geojson")
    assert shapefile.to_geojson(spark, path, out) == 2
    assert json.load(open(out))["features"][0]["properties"] == {"NAME": "Å One", "N": 1, "F": 1.5}


def test_tables(spark, rows):
    for t in ("t_geo", "t_rows", "spatial_ref_sys", "n_pnwk_segs", "n_pnwk_jcts"):
        tables.drop_table(spark, t)
    specs = [("id", "BIGINT", "id"), ("a:name", "TEXT", "name"), ("length", "FLOAT", "length"), ("geometry", "POINT", "geometry")]
    tables.create_table(spark, "t_rows", specs)
    tables.write_rows(spark, "t_rows", specs, [{"id": 1, "name": 7, "length": 2}, (2, "b", None, (1.0, 2.0)), {"id": 3}, {"id": 4, "name": "d"}])
    assert tables.num_rows(spark, "t_rows") == 4 and tables.column_names(spark, "t_rows") == ["a:name", "geometry", "id", "length"]
    assert {r.id: r.length for r in tables.select(spark, ["id", "length"], "t_rows", "id < 3").collect()} == {1: 2.0, 2: None}
    assert tables.exec_sql(spark, "SELECT count(*) AS n FROM t_rows WHERE id > :low", {"low": 2}).first().n == 2 and tables.exec_sql(spark, "SELECT ? AS x", [5]).first().x == 5
    tables.add_column(spark, "t_rows", "extra", "INT")
    tables.add_column(spark, "t_rows", "line", "LINESTRING")
    assert "t_rows" in tables.table_names(spark) and dict(spark.table("t_rows").dtypes)["line"].startswith("array<struct")
    assert tables.write_geo(rows, "t_geo", "LineString")[-1] == ("geometry", "LINESTRING", "geometry") and spark.table("t_geo").count() == 1
    assert tables.add_spatial_ref_sys(spark, 832610, "EPSG", 32610, "WKT", "+proj") and not tables.add_spatial_ref_sys(spark, 832610, "EPSG", 32610, "WKT", "+proj") and not tables.add_spatial_ref_sys(spark, 1, None, 1, "a", "b")
    assert tables.num_rows(spark, "spatial_ref_sys") == 1
    segs = spark.createDataFrame([(1, 1, 2, [(0.0, 0.0), (3.0, 4.0)], ["B", "A"], {"k": "v"})], "seg_id long, from_jct long, to_jct long, pts array<struct<x:double,y:double>>, names array<string>, tags map<string,string>")
    jcts = spark.createDataFrame([(1, (0.0, 0.0), {}), (2, (3.0, 4.0), {"j": "t"})], "jct_id long, pt struct<x:double,y:double>, tags map<string,string>")
    tables.write_network(Network(segs, jcts, "n"), "n")
    assert tables.num_rows(spark, "n_pnwk_segs") == 1 and tables.num_rows(spark, "n_pnwk_jcts") == 2
    assert spark.range(1).select(tables.sql_geometry(F.lit("POINT (1 2)"), 4326).alias("x")).first().x == "ST_GeomFromText('POINT (1 2)',4326)"
    assert tables.jdbc_options("postgresql", "d", port=5433)["url"].endswith(":5433/d") and "sqlite" in tables.jdbc_options("sqlite", "x.db")["url"]


def test_network_file(spark, tmp_path):
    segs = spark.createDataFrame([(1, 1, 2, [(0.0, 0.0), (3.0, 4.0)], ["B ST", "A"], {"k": "v"})], "seg_id long, from_jct long, to_jct long, pts array<struct<x:double,y:double>>, names array<string>, tags map<string,string>")
    jcts = spark.createDataFrame([(1, (0.0, 0.0), {}), (2, (3.0, 4.0), {"j": "t"})], "jct_id long, pt struct<x:double,y:double>, tags map<string,string>")
    path = str(tmp_path / "net")
    geojson.write_network(Network(segs, jcts, "osm"), path)
    props = json.load(open(path + ".pnwk.geojson"))["features"][0]["properties"]
    assert props["osm_pnwk$name"] == "A;B ST" and props["osm$k"] == "v" and float(props["osm_pnwk$length"]) == 5 and "osm_pnwk$match_id" not in props
    assert props["osm_pnwk$length"] == 5.0 and props["osm_pnwk$from_jct_id"] == 1 and isinstance(props["osm_pnwk$seg_id"], int) and props["osm_pnwk$from_bearing"] == pytest.approx(36.8698976)
    jct = json.load(open(path + ".pnwk.geojson"))["features"][1]["properties"]
    assert jct["osm_pnwk$seg_ids"] == [1] and jct["osm_pnwk$jct_id"] == 1 and "osm_pnwk$export_count" not in jct
    back = geojson.read_network(spark, path, "osm")
    assert [tuple(r) for r in back.segs.collect()] == [tuple(r) for r in segs.withColumn("names", F.array_sort("names")).collect()]
    assert sorted(map(str, back.jcts.collect())) == sorted(map(str, jcts.collect()))


def test_kept_networks(spark, tmp_path):
    """Tables between steps; the GeoJSON of a network that was not kept is read instead."""
    segs = spark.createDataFrame([(1, 1, 2, [(0.0, 0.0), (3.0, 4.0)], ["A"], {"k": "v"})], "seg_id long, from_jct long, to_jct long, pts array<struct<x:double,y:double>>, names array<string>, tags map<string,string>")
    jcts = spark.createDataFrame([(1, (0.0, 0.0), {}), (2, (3.0, 4.0), {})], "jct_id long, pt struct<x:double,y:double>, tags map<string,string>")
    net, path = Network(segs, jcts, "osm"), str(tmp_path / "n")
    assert networks.save(net, path).segs.collect() == segs.collect() == networks.load(spark, path, "osm").segs.collect()
    networks.export(net, str(tmp_path / "other"))
    assert networks.load(spark, str(tmp_path / "other"), "osm").segs.count() == 1
    networks.export(net, "file://" + str(tmp_path / "many"))
    assert geojson.read_features(spark, str(tmp_path / "many.pnwk.geojson"), lines=True).count() == 3


def test_collection_by_lines(spark, tmp_path, rows):
    """What write_features() lays out is read by many tasks, any other collection whole, with the same features."""
    one, two = str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson")
    geojson.write_features(rows, one, "http://example.org/ref/")
    json.dump(json.load(open(one)), open(two, "w"))
    a, b = (geojson.read_features(spark, p).orderBy("ord").drop("ord") for p in (one, two))
    plain = lambda df: [(r.feature_id, r.geom_type, r.parts, sorted(r.p.items())) for r in df.withColumn("p", geojson.string_props(F.col("props"))).collect()]
    assert plain(a) == plain(b) and len(plain(a)) == 3 and "Generate" not in a._jdf.queryExecution().executedPlan().toString()


def test_connectors(spark):
    class Kept(tables.Jdbc):
        def write(self, df, table):
            held[table] = self.flat(df).collect()

    held = {}
    tables.CONNECTORS["kept"] = lambda spark, **o: Kept(spark, tables.jdbc_options("sqlite", **o))
    to = tables.connect(spark, "kept", database="x.db")
    df = spark.createDataFrame([(1, (1.0, 2.0), [(0.0, 0.0), (3.0, 4.0)], {"a": "b"})], "id int, p struct<x:double,y:double>, l array<struct<x:double,y:double>>, m map<string,string>")
    to.write(df, "t")
    assert tuple(held["t"][0]) == (1, "POINT (1.000000 2.000000)", "LINESTRING (0.000000 0.000000, 3.000000 4.000000)", '{"a":"b"}')
    segs = spark.createDataFrame([(1, 1, 2, [(0.0, 0.0), (3.0, 4.0)], ["A"], {})], "seg_id long, from_jct long, to_jct long, pts array<struct<x:double,y:double>>, names array<string>, tags map<string,string>")
    jcts = spark.createDataFrame([(1, (0.0, 0.0), {}), (2, (3.0, 4.0), {})], "jct_id long, pt struct<x:double,y:double>, tags map<string,string>")
    tables.write_osm_tables(df, df, Network(segs, jcts, "n"), "n", to)
    assert {k: len(v) for k, v in held.items()} == {"t": 1, "n_ways": 1, "n_nodes": 1, "n_pnwk_segs": 1, "n_pnwk_jcts": 2}
    with pytest.raises(ValueError):
        tables.connect(spark, "no such")


@pytest.mark.parametrize("code", [32610, 32755, 26910, 2913, 2227, 4326])
def test_wkt_of_known_systems(code):
    """From the number to WKT and back to proj4: the same places."""
    text = srs.epsg_to_wkt(code)
    own, back = srs.parse_proj4(srs.epsg_to_proj4(code)), srs.parse_proj4(srs.wkt_to_proj4(text))
    lon, lat = own.lon0 + 1.5, -38.0 if code == 32755 else 41.0
    assert own.numbers(lon, lat) == pytest.approx(back.numbers(lon, lat), abs=1e-6)
    assert srs.SRS(auth_name="EPSG", auth_srid=code).resolved().srtext == text and srs.epsg_to_wkt(1) is None


def test_srs_from_a_site(tmp_path):
    (tmp_path / "proj4").mkdir()
    url = tmp_path.as_uri() + "/"
    (tmp_path / "json").mkdir()
    assert srs.SRS(url=url, units="meters").resolved().projection() is None  # the site does not answer
    site = {"esriwkt/": srs.epsg_to_wkt(32610), "proj4/": "+proj=utm +zone=10 +datum=WGS84 +units=m", "json/": "{'type': 'EPSG', 'properties': {'code': 32610}}"}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(srs.fetch, "get_url", lambda u: (site[u[len(url):]].encode(), {}))
        s = srs.SRS(url=url).resolved()
    assert (s.auth_name, s.auth_srid, s.postgis_srid) == ("EPSG", 32610, 832610) and s.projection().numbers(-123, 0)[0] == pytest.approx(500_000)


def test_srs(tmp_path):
    s = srs.SRS(auth_name="EPSG", auth_srid=32610).resolved()
    assert s.postgis_srid == s.spatialite_srid == 832610 and s.units == "meters" and "+zone=10" in s.proj4text and "auth_srid: 32610" in s.info()
    prj = 'PROJCS["WGS_1984_UTM_Zone_10N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-123.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]],VERTCS["WGS_1984",DATUM["D"],UNIT["Foot",0.3048]]'
    (tmp_path / "a.prj").write_text(prj)
    own = srs.SRS(filename=str(tmp_path / "a.shp")).resolved()
    assert own.projection().numbers(-122, 38) == pytest.approx(s.projection().numbers(-122, 38), abs=1e-3) and own.projection().units == "meters"
    assert srs.SRS().resolved().projection() is None and srs.proj4_from_shapefile(str(tmp_path / "none.shp")) is None


def test_files_and_settings(tmp_path):
    import gzip
    import zipfile

    assert fetch.gunzip(gzip.compress(b"x")) == b"x"
    fetch.create_dirs(str(tmp_path / "a/b/c.txt"))
    z = str(tmp_path / "a/z.zip")
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/e.txt", "hello")
    assert open(fetch.unzip(z)[0]).read() == "hello"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        fetch.unzip(z)
    src = tmp_path / "src.txt"
    src.write_text("data")
    assert fetch.update_file_from_url(str(tmp_path / "dst.txt"), src.as_uri()) and not fetch.update_file_from_url(str(tmp_path / "dst.txt"), src.as_uri())
    (tmp_path / ".wayweft.json").write_text('{"a": 1, "b": 1}')
    (tmp_path / "config.wayweft.json").write_text('{"b": 2}')
    assert fetch.read_settings(folders=[str(tmp_path)]) == {"postgis_enabled": False, "spatialite_enabled": False, "a": 1, "b": 2}
    assert fetch.listing({"b": 1, "a": 2}) == "\n    a: 2\n    b: 1"


def test_json_answers_of_every_encoding(spark):
    way = {"type": "way", "id": 7, "nodes": [1, {"ref": 2, "seq": 10}, None, 3], "tags": [{"k": "name", "v": "A"}, {"k": "name", "v": "B"}, {"k": "oneway", "v": True}]}
    node = {"type": "node", "id": 1, "lon": -170.5, "lat": 43.5, "tags": {"addr": {"city": "X", "no": 5}, "lit": None}}
    once = json.dumps({"elements": [node, way, {"type": "group", "id": 9, "elements": [node]}, 5]})
    texts = [once, json.dumps(once), json.dumps(json.dumps(once)), once[:-1], "[]", "null", None, json.dumps({"osm": {"elements": [node]}})]
    data = osm_files.from_json_answers(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [(r.way_id, r.node_ids, r.tags) for r in data.ways.collect()] == [(7, [1, 2, 3], {"name": "B", "oneway": "true"})] * 3
    assert [(r.node_id, r.pt.x, r.pt.y, r.tags) for r in data.nodes.collect()] == [(1, -170.5, 43.5, {"addr:city": "X", "addr:no": "5"})] * 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_json_elements_of_a_whole_table(spark):
    """Brute force with the json module over every payload: ids, places and refs of nodes and ways."""
    from wayweft.plans.reference_queries import QUERIES

    want = set()
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/osm_raw.parquet").select("payload").collect():
        try:
            answer = json.loads(text or "null")
            while isinstance(answer, str):
                answer = json.loads(answer)
        except ValueError:
            continue
        for e in answer.get("elements") or [] if isinstance(answer, dict) else []:
            refs = [int(n["ref"] if isinstance(n, dict) else n) for n in e.get("nodes") or [] if n is not None] if e["type"] == "way" else []
            if e["type"] in ("node", "way"):
                want.add((e["type"], e["id"], e.get("lon"), e.get("lat"), tuple(refs), bool(e.get("tags"))))
    rows = QUERIES["ref_s6_osm_json_elements"](spark, "/root/testdata/sf0.001").collect()
    assert want and {w[:5] for w in want} == {(r.type, r.id, r.lon, r.lat, tuple(r.node_ids)) for r in rows}
    assert any(r.tags for r in rows if r.type == "way") and any(r.tags for r in rows if r.type == "node")
