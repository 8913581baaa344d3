"""Queries of the conflation operators over the test tables, with equivalent SQL.

Keys carry the operator ids of the inventory. Planar coordinates are local metres, (lon + 170.8) * 81000 and
(lat - 43.25) * 111000, on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.functions import geom, maps, names
from wayweft.functions.projection import parse_proj4
from wayweft.operators import features, grid, matching, network, osm, scoring
from wayweft.operators.network import Network
from wayweft.runtime import materialise, shared_path, table
from wayweft.sources import geojson, osm_files, srs, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LON0, LAT0, KX, KY = 170.8, 43.25, 81000.0, 111000.0
UTM2 = "+proj=utm +zone=2 +datum=WGS84 +units=m"
LCC = "+proj=lcc +lat_1=44.33333333333334 +lat_2=46 +lat_0=43.66666666666666 +lon_0=-170 +x_0=2500000 +y_0=0 +ellps=GRS80 +units=m"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Common inputs


def _planar(p: Column) -> Column:
    return F.struct(((p["x"] + LON0) * KX).alias("x"), ((p["y"] - LAT0) * KY).alias("y"))


def _features(spark: SparkSession, d: str, name: str, key: str, props: list[Column]) -> DataFrame:
    """Feature rows of a table with GeoJSON geometry: of each id the row that was delivered last."""
    cols = [c for c in table(spark, d, name).columns if c not in (key, "loaded_at", "geometry")]
    order = F.struct("loaded_at", "geometry", *[c for c in cols if c != "tags"])
    rows = table(spark, d, name).groupBy(key).agg(F.max(order).alias("m"), *([F.max_by("tags", order).alias("tags")] if "tags" in cols else []))
    rows = rows.select(key, "m.*", *(["tags"] if "tags" in cols else [])).drop("loaded_at")
    g = rows.withColumn("f", F.try_parse_json(F.concat(F.lit('{"geometry":'), "geometry", F.lit("}"))))
    parsed = geojson._rows(g.withColumn("ord", F.col(key))).select("ord", "geom_type", "parts")
    return rows.join(parsed, rows[key] == parsed["ord"]).withColumn("parts", F.transform("parts", lambda line: F.transform(line, _planar)))


def _city(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, "centerline", "objectid", []).withColumn("props", F.map_filter(F.create_map(F.lit("FULLNAME"), F.col("fullname"), F.lit("CATEGORY"), F.col("category")), lambda _, v: v.isNotNull()))


def _city_lines(spark: SparkSession, d: str) -> DataFrame:
    return network.line_parts(_city(spark, d))


_CITY = f"""
one AS (SELECT objectid, geometry, fullname, category FROM centerline QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY loaded_at DESC NULLS LAST, geometry DESC NULLS LAST, fullname DESC NULLS LAST, category DESC NULLS LAST) = 1),
multi AS (SELECT *, CASE WHEN geometry->>'type' = 'LineString' THEN [(geometry->'coordinates')::DOUBLE[][]] ELSE (geometry->'coordinates')::DOUBLE[][][] END AS g FROM one),
city AS (SELECT objectid, fullname, category, part - 1 AS part, list_transform(g[part], lambda p: {{'x': (p[1] + {LON0}) * {KX}, 'y': (p[2] - {LAT0}) * {KY}}}) AS pts
  FROM (SELECT *, unnest(range(1, len(g) + 1)) AS part FROM multi))"""
_LENGTH = "list_sum(list_transform(range(1, len(pts)), lambda i: sqrt(pow(pts[i + 1].x - pts[i].x, 2) + pow(pts[i + 1].y - pts[i].y, 2))))"


def _bearing_sql(p: str, q: str) -> str:
    b = f"(90 - degrees(atan2({q}.y - {p}.y, {q}.x - {p}.x)))"
    return f"(CASE WHEN {b} < 0 THEN {b} + 360 ELSE {b} END)"


def _delta_sql(a: str, b: str) -> str:
    v = f"(abs({a} - {b}) % 360)"
    return f"(CASE WHEN {v} > 180 THEN 360 - {v} ELSE {v} END)"


def _r(c: Column, n: int = 3) -> Column:
    return F.round(c, n) + F.lit(0.0)


# Names


#: Fixed values, written independently of the functions' own table: what the words in the tables' names become.
_WORDS_SQL = """{'AVENU': 'AVE', 'AVENUE': 'AVE', 'BOULEVARD': 'BLVD', 'CIRCL': 'CIR', 'CIRCLE': 'CIR', 'COURT': 'CT', 'CR': 'CRK', 'CRCLE': 'CIR',
  'DRIV': 'DR', 'DRIVE': 'DR', 'EAST': 'E', 'HIGHWAY': 'HWY', 'LANE': 'LN', 'NORTH': 'N', 'NORTHEAST': 'NE', 'NORTHWEST': 'NW', 'PARKWAY': 'PKWY',
  'PARKWY': 'PKWY', 'PKY': 'PKWY', 'PLACE': 'PL', 'ROAD': 'RD', 'SOUTH': 'S', 'SOUTHEAST': 'SE', 'SOUTHWEST': 'SW', 'STREET': 'ST', 'TERRACE': 'TER',
  'TR': 'TRL', 'TRAIL': 'TRL', 'WEST': 'W', 'WY': 'WAY'}"""
_REWRITES_SQL = (
    (r"^(.*\bI)([0-9].*)$", r"\1 \2"), (r"^(.*[0-9]\s+)\bFWY\b(.*)$", r"\1\2"), (r"^(.*)\bTRANSIT\s+CTR\b(.*)$", r"\1TC\2"),
    (r"^(.*)\bUNITED\s+STATES\b(.*)$", r"\1US\2"), (r"^(.*)\b(MC|LE)\s+(\S+.*)$", r"\1\2\3"), (r"^(.*)\b(?:US|OR)\s*([0-9].*)$", r"\1HWY \2"),
)


def canonical_sql(name: str, upto: str = "canonical") -> str:
    text = f"regexp_replace(replace({name}, '''', ''), '[^A-Za-z0-9 ]', ' ', 'g')"
    if upto == "restricted":
        return text
    text = f"array_to_string(list_transform(list_filter(string_split(upper({text}), ' '), lambda w: w <> ''), lambda w: coalesce(MAP {_WORDS_SQL}[w], w)), ' ')"
    if upto == "substituted":
        return text
    for pattern, into in _REWRITES_SQL:
        text = f"regexp_replace({text}, '{pattern}', '{into}')"
    return text if upto == "rewritten" else f"array_to_string(list_filter(string_split({text}, ' '), lambda w: w <> ''), ' ')"


@query("ref_n4_n9_canonical_names", f"""
SELECT fullname, restricted, substituted, rewritten, {canonical_sql('fullname')} AS canonical FROM (
SELECT fullname, {canonical_sql('fullname', 'restricted')} AS restricted, {canonical_sql('fullname', 'substituted')} AS substituted, {canonical_sql('fullname', 'rewritten')} AS rewritten
FROM (SELECT DISTINCT fullname FROM centerline WHERE fullname IS NOT NULL UNION SELECT DISTINCT tags['name'] FROM osm_lines WHERE tags['name'] IS NOT NULL))""")
def n4_n9(spark, d):
    of = table(spark, d, "centerline").select("fullname").union(table(spark, d, "osm_lines").select(F.element_at("tags", "name"))).where("fullname IS NOT NULL").distinct()
    n = F.col("fullname")
    sub = names.substitute_words(F.upper(names.restrict_chars(n)))
    return of.select("fullname", names.restrict_chars(n).alias("restricted"), sub.alias("substituted"), names.apply_rewrites(sub).alias("rewritten"), names.canonical(n).alias("canonical"))


_NAMED = "named AS (SELECT DISTINCT way_id, tags['name'] AS a, tags['alt_name'] AS b, tags['old_name'] AS c FROM osm_lines)"


@query("ref_n1_n3_a10_name_scores", f"""
WITH {_NAMED}, canon AS (SELECT way_id, a, b, c, {canonical_sql('a')} AS x, {canonical_sql('b')} AS y, {canonical_sql('c')} AS z FROM named),
best AS (SELECT *, list_max(list_filter([CASE WHEN x <> '' AND y <> '' THEN 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END,
  CASE WHEN x <> '' AND z <> '' THEN 1 - levenshtein(x, z)::DOUBLE / greatest(length(x), length(z)) END], lambda v: v IS NOT NULL)) AS p FROM canon)
SELECT way_id, a, b, c, coalesce(round(p * 100)::INTEGER, -1) AS score, coalesce(round(p, 6), -1) AS probability FROM best""")
def n1_n3(spark, d):
    rows = table(spark, d, "osm_lines").select("way_id", *[F.element_at("tags", k).alias(c) for k, c in (("name", "a"), ("alt_name", "b"), ("old_name", "c"))]).distinct()
    one, two = F.array("a"), F.array("b", "c")
    return rows.select("way_id", "a", "b", "c", F.coalesce(F.round(names.match_probability(one, two), 6), F.lit(-1.0)).alias("probability"), F.coalesce(names.match_score(one, two), F.lit(-1)).alias("score"))


@query("ref_n10_rlis_names", """
WITH r AS (SELECT DISTINCT objectid, CASE WHEN prefix <> '' THEN prefix || ' ' ELSE '' END AS b, CASE WHEN ftype <> '' THEN ' ' || ftype ELSE '' END AS a, streetname AS s, ftype, prefix FROM rlis_streets)
SELECT objectid, CASE WHEN s IS NULL OR s = '' OR s = 'UNNAMED' THEN '' WHEN ftype = 'RAMP' THEN
  array_to_string(list_concat([b || s || a], flatten(list_transform(list_filter(string_split(s, '-'), lambda p: p <> '' AND p <> 'UNNAMED'), lambda p: [b || p, p]))), '|') ELSE b || s || a END AS names FROM r""")
def n10(spark, d):
    rows = table(spark, d, "rlis_streets").select("objectid", "prefix", "streetname", "ftype").distinct()
    return rows.select("objectid", F.array_join(names.rlis_names(F.col("prefix"), F.col("streetname"), F.col("ftype")), "|").alias("names"))


@query("ref_n11_berkeley_names", """
WITH c AS (SELECT DISTINCT objectid, fullname AS n, category AS g, string_split(fullname, ' ') AS w FROM centerline)
SELECT objectid, CASE WHEN n IS NULL OR contains(n, 'UNNAMED') OR n = 'ALLEY' OR (n = 'TRAIL' AND coalesce(g, '') = 'PEDESTRIAN') OR (n = 'RAMP' AND coalesce(g, '') = 'CONNECTOR') THEN ''
  ELSE n || CASE WHEN coalesce(g, '') IN ('CONNECTOR', 'HIGHWAY') AND len(w) > 1 AND w[1] LIKE 'I%' AND regexp_matches(substr(w[1], 2), '^[+]?0*[1-9][0-9]*$') THEN '|' || w[1]
    WHEN coalesce(g, '') IN ('CONNECTOR', 'HIGHWAY') AND len(w) > 1 AND w[1] = 'HWY' AND regexp_matches(w[2], '^[+]?0*[1-9][0-9]*$') THEN '|CA ' || w[2] ELSE '' END END AS names FROM c""")
def n11(spark, d):
    rows = table(spark, d, "centerline").select("objectid", "fullname", "category").distinct()
    return rows.select("objectid", F.array_join(names.berkeley_names(F.col("fullname"), F.col("category")), "|").alias("names"))


@query("ref_n12_n13_osm_names", """
SELECT DISTINCT way_id, array_to_string(list_concat(list_filter([tags['name'], tags['alt_name'], tags['loc_name'], tags['old_name'], tags['official_name']], lambda n: n IS NOT NULL), coalesce(string_split(tags['ref'], ';'), [])), ';') AS name FROM osm_lines""")
def n12(spark, d):
    return table(spark, d, "osm_lines").select("way_id", F.array_join(names.osm_names(F.col("tags")), ";").alias("name")).distinct()


@query("ref_n14_html_escape", "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents")
def n14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.html_escape(F.col("text"))).alias("escaped"))


@query("ref_n16_m2_m3_namespaces", """
WITH k AS (SELECT DISTINCT id, unnest(map_entries(tags)) AS e FROM osm_nodes WHERE tags IS NOT NULL)
SELECT id, 'osm$' || e.key AS key, 'osm$' AS prefix, e.key AS name, e.value AS value FROM k WHERE NOT (e.key LIKE 'na%')""")
def n16(spark, d):
    kept = maps.add_prefix(maps.drop_prefix(F.col("tags"), "na"), maps.namespace("osm"))
    rows = table(spark, d, "osm_nodes").where("tags IS NOT NULL").select("id", F.explode(kept).alias("key", "value")).distinct()
    return rows.select("id", "key", maps.split_key(F.col("key"))["prefix"].alias("prefix"), maps.split_key(F.col("key"))["name"].alias("name"), "value")


@query("ref_m1_m4_map_merge", """
SELECT DISTINCT way_id, array_to_string(list_sort(list_concat(list_transform(list_filter(map_entries(tags), lambda e: e.key NOT IN ('surface', 'checked')), lambda e: e.key || '=' || e.value), ['surface=merged', 'checked=yes'])), ',') AS merged,
  coalesce(tags['oneway'], 'no') AS oneway FROM osm_lines WHERE tags IS NOT NULL""")
def m1(spark, d):
    new = F.create_map(F.lit("surface"), F.lit("merged"), F.lit("checked"), F.lit("yes"))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(maps.merge(F.col("tags"), new)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "osm_lines").where("tags IS NOT NULL").select("way_id", merged.alias("merged"), maps.get(F.col("tags"), "oneway", "no").alias("oneway")).distinct()


# Geometry


@query("ref_g1_g7_g14_lengths_bearings", f"""
WITH {_CITY} SELECT objectid, part, round({_LENGTH}, 3) AS length, round({_LENGTH} * {geom.FEET_PER_METRE}, 3) AS feet, round({_LENGTH} * {geom.MILES_PER_METRE}, 6) AS miles, round({_bearing_sql('pts[1]', 'pts[2]')}, 6) AS from_bearing,
  round({_bearing_sql('pts[-1]', 'pts[-2]')}, 6) AS to_bearing, round({_delta_sql(_bearing_sql('pts[1]', 'pts[2]'), _bearing_sql('pts[-1]', 'pts[-2]'))}, 6) AS turn FROM city""")
def g7(spark, d):
    p = F.col("pts")
    n = geom.length(p)
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), _r(n).alias("length"), _r(geom.in_units(n, "meters", "feet")).alias("feet"), _r(geom.in_units(n, "meters", "miles"), 6).alias("miles"), _r(geom.from_bearing(p), 6).alias("from_bearing"), _r(geom.to_bearing(p), 6).alias("to_bearing"), _r(geom.compass_bearing_delta(geom.from_bearing(p), geom.to_bearing(p)), 6).alias("turn"))


_LEGS = """
legs AS (SELECT objectid, part, pts, i, pts[i].x AS x0, pts[i].y AS y0, pts[i + 1].x AS x1, pts[i + 1].y AS y1 FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM city)),
long AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS leg FROM legs),
run AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY objectid, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(leg) OVER (PARTITION BY objectid, part) AS whole FROM long)"""


@query("ref_g8_interpolate", f"""
WITH {_CITY}, {_LEGS}, hit AS (SELECT *, row_number() OVER (PARTITION BY objectid, part ORDER BY i) AS k FROM run WHERE before + leg >= whole * 0.3)
SELECT objectid, part, round(x0 + CASE WHEN leg > 0 THEN (whole * 0.3 - before) / leg ELSE 0 END * (x1 - x0), 3) AS x, round(y0 + CASE WHEN leg > 0 THEN (whole * 0.3 - before) / leg ELSE 0 END * (y1 - y0), 3) AS y FROM hit WHERE k = 1""")
def g8(spark, d):
    p = geom.interpolate(F.col("pts"), geom.length(F.col("pts")) * 0.3)
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), _r(p["x"]).alias("x"), _r(p["y"]).alias("y"))


@query("ref_g9_project", f"""
WITH {_CITY}, {_LEGS}, q AS (SELECT *, (pts[1].x + pts[-1].x) / 2 + 3 AS px, (pts[1].y + pts[-1].y) / 2 - 5 AS py FROM run),
t AS (SELECT *, CASE WHEN leg > 0 THEN least(1, greatest(0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (leg * leg))) ELSE 0 END AS t FROM q),
f AS (SELECT *, sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2)) AS off FROM t)
SELECT objectid, part, round(arg_min(before + t * leg, off), 3) AS along FROM f GROUP BY objectid, part""")
def g9(spark, d):
    a, b = geom.first(F.col("pts")), geom.last(F.col("pts"))
    at = geom.point((a["x"] + b["x"]) / 2 + 3, (a["y"] + b["y"]) / 2 - 5)
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), _r(geom.project(F.col("pts"), at)).alias("along"))


@query("ref_g10_cut", f"""
WITH {_CITY}, {_LEGS}, c AS (SELECT objectid, part, any_value(whole) AS whole, 1 + count(*) FILTER (before + leg <= whole * 0.37) AS k, len(any_value(pts)) AS n FROM run GROUP BY objectid, part)
SELECT objectid, part, k + 1 AS head_points, n - k + 1 AS tail_points, round(whole * 0.37, 3) AS head, round(whole * 0.63, 3) AS tail FROM c WHERE whole > 0""")
def g10(spark, d):
    rows = _city_lines(spark, d).withColumn("c", geom.cut(F.col("pts"), geom.length(F.col("pts")) * 0.37)).where("c IS NOT NULL")
    return rows.select("objectid", F.col("part").cast("long").alias("part"), F.size("c.head").cast("long").alias("head_points"), F.size("c.tail").cast("long").alias("tail_points"), _r(geom.length(F.col("c.head"))).alias("head"), _r(geom.length(F.col("c.tail"))).alias("tail"))


@query("ref_g11_divergence", f"""
WITH {_CITY}, {_LEGS}, w AS (SELECT objectid, part, any_value(whole) AS whole, any_value(pts) AS pts FROM run GROUP BY objectid, part),
s AS (SELECT objectid, part, whole, pts, k, least(k * 3.0, whole) AS d FROM (SELECT *, unnest(range(0, ceil(whole / 3.0)::BIGINT + 1)) AS k FROM w)),
p AS (SELECT s.objectid, s.part, s.k, s.d, s.whole, s.pts, r.x0 + (s.d - r.before) / r.leg * (r.x1 - r.x0) AS x, r.y0 + (s.d - r.before) / r.leg * (r.y1 - r.y0) AS y, row_number() OVER (PARTITION BY s.objectid, s.part, s.k ORDER BY r.i) AS pick
  FROM s JOIN run r ON r.objectid = s.objectid AND r.part = s.part AND r.leg > 0 AND (s.d <= r.before + r.leg OR r.i = len(s.pts) - 1)),
q AS (SELECT *, pts[1].x + d / whole * (pts[-1].x - pts[1].x) AS u, pts[1].y + d / whole * (pts[-1].y - pts[1].y) AS v FROM p WHERE pick = 1),
b AS (SELECT *, lag(x) OVER o AS xp, lag(y) OVER o AS yp, lag(u) OVER o AS up, lag(v) OVER o AS vp FROM q WINDOW o AS (PARTITION BY objectid, part ORDER BY k))
SELECT objectid, part, round(max(sqrt(pow(x - u, 2) + pow(y - v, 2))), 3) AS separation, round(avg(CASE WHEN xp IS NOT NULL THEN {_delta_sql('degrees(atan2(y - yp, x - xp))', 'degrees(atan2(v - vp, u - up))')} END), 3) AS bearing_delta FROM b GROUP BY objectid, part""")
def g11(spark, d):
    chord = F.array(geom.first(F.col("pts")), geom.last(F.col("pts")))
    rows = _city_lines(spark, d).withColumn("v", geom.divergence(F.col("pts"), chord))
    return rows.select("objectid", F.col("part").cast("long").alias("part"), _r(F.col("v.separation")).alias("separation"), _r(F.col("v.bearing_delta")).alias("bearing_delta"))


@query("ref_g2_g3_g4_wkt", f"""
WITH {_CITY} SELECT objectid, part, printf('POINT (%.6f %.6f)', pts[1].x, pts[1].y) AS point, 'LINESTRING (' || array_to_string(list_transform(pts, lambda p: printf('%.6f %.6f', p.x, p.y)), ', ') || ')' AS line, len(pts) AS points FROM city""")
def g2(spark, d):
    text = geom.wkt_linestring(F.col("pts"))
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), geom.wkt_point(geom.first(F.col("pts"))).alias("point"), geom.wkt_linestring(geom.wkt_to_line(text)).alias("line"), F.size(geom.wkt_to_line(text)).cast("long").alias("points"))


_PLACES = "SELECT DISTINCT jct_id, point.x AS lon, point.y AS lat FROM jcts WHERE point IS NOT NULL"
# Eccentricity, rectifying radius and series coefficients of WGS 84, as published, to sixth order.
_UTM_SQL = f"""
WITH p AS (SELECT jct_id, radians(lon + 171) AS lam, radians(lat) AS phi, 0.0818191908426215e0 AS e FROM ({_PLACES})),
t AS (SELECT jct_id, lam, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p),
g AS (SELECT jct_id, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t),
c AS (SELECT [8.377318206244698e-4, 7.608527773572489e-7, 1.197645503242492e-9, 2.429170680397309e-12, 5.711818370428e-15, 1.47999793137966e-17] AS a)
SELECT jct_id, round(500000 + 0.9996e0 * 6367449.145823415e0 * (eta + list_sum(list_transform(range(1, 7), lambda j: a[j] * cos(2 * j * xi) * sinh(2 * j * eta)))), 2) AS x,
  round(0.9996e0 * 6367449.145823415e0 * (xi + list_sum(list_transform(range(1, 7), lambda j: a[j] * sin(2 * j * xi) * cosh(2 * j * eta)))), 2) AS y FROM g, c"""
_LCC_SQL = f"""
WITH k AS (SELECT 6378137.0e0 AS a, 0.0818191910428158e0 AS e, radians(133e0 / 3) AS p1, radians(46) AS p2, radians(131e0 / 3) AS p0),
m AS (SELECT a, e, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1, tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2, tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM k),
n AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM m), f AS (SELECT *, m1 / (n * pow(t1, n)) AS f FROM n),
p AS (SELECT jct_id, radians(lon + 170) AS lam, radians(lat) AS phi FROM ({_PLACES})),
r AS (SELECT jct_id, n * lam AS theta, a * f * pow(tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2), n) AS rho, a * f * pow(t0, n) AS rho0 FROM p, f)
SELECT jct_id, round(2500000 + rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y FROM r"""


def _projected(spark, d, text, digits):
    p = parse_proj4(text).point(F.col("point"))
    rows = table(spark, d, "jcts").where("point IS NOT NULL").select("jct_id", "point").distinct()
    return rows.select("jct_id", _r(p["x"], digits).alias("x"), _r(p["y"], digits).alias("y"))


@query("ref_g16_g18_utm", _UTM_SQL)
def g16_utm(spark, d):
    return _projected(spark, d, UTM2, 2)


@query("ref_g16_g18_lcc", _LCC_SQL)
def g16_lcc(spark, d):
    return _projected(spark, d, LCC, 3)


@query("ref_g16_round_trip", "SELECT DISTINCT jct_id, round(point.x, 7) AS lon, round(point.y, 7) AS lat FROM jcts WHERE point IS NOT NULL")
def g16_back(spark, d):
    utm = parse_proj4(UTM2)
    rows = table(spark, d, "jcts").where("point IS NOT NULL").select("jct_id", "point").distinct().withColumn("p", utm.point(F.col("point")))
    rows = rows.withColumn("q", utm.point(F.col("p"), reverse=True))
    return rows.select("jct_id", F.round("q.x", 7).alias("lon"), F.round("q.y", 7).alias("lat"))


@query("ref_a1_bbox", """
WITH v AS (SELECT region_id, kind, unnest(flatten(rings)) AS p FROM regions) SELECT kind, round(min(p.x), 6) AS xmin, round(min(p.y), 6) AS ymin, round(max(p.x), 6) AS xmax, round(max(p.y), 6) AS ymax FROM v GROUP BY kind""")
def a1(spark, d):
    rows = table(spark, d, "regions").select("kind", F.flatten("rings").alias("pts"))
    return network.bbox(rows, by=["kind"]).select("kind", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


RECT = (-170.2, 43.8, -169.9, 44.1)


@query("ref_f6_point_in_rect", f"""
SELECT DISTINCT jct_id, point.x >= {RECT[0]} AND point.x < {RECT[2]} AND point.y >= {RECT[1]} AND point.y < {RECT[3]} AS inside FROM jcts WHERE point IS NOT NULL""")
def f6(spark, d):
    return table(spark, d, "jcts").where("point IS NOT NULL").select("jct_id", geom.in_rect(F.col("point"), RECT).alias("inside")).distinct()


CLIP = (3000.0, -500.0, 9000.0, 900.0)


@query("ref_f1_f5_clip_lines", f"""
WITH {_CITY} SELECT objectid, any_value(category) AS cat FROM city WHERE len(list_filter(pts, lambda p: p.x >= {CLIP[0]} AND p.x < {CLIP[2]} AND p.y >= {CLIP[1]} AND p.y < {CLIP[3]})) > 0 AND category IN ('MAJOR', 'MINOR') GROUP BY objectid""")
def f1(spark, d):
    found = features.filter_features(_city(spark, d), where=F.element_at("props", "CATEGORY").isin("MAJOR", "MINOR"), clip=CLIP)
    return found.select("objectid", F.element_at("props", "CATEGORY").alias("cat"))


@query("ref_f2_f3_rename_props", """
SELECT DISTINCT way_id, array_to_string(list_sort(list_transform(list_filter(map_entries(tags), lambda e: e.key IN ('name', 'surface')), lambda e: CASE WHEN e.key = 'name' THEN 'label' ELSE 'cover' END || '=' || e.value)), ',') AS props FROM osm_lines WHERE tags IS NOT NULL""")
def f2(spark, d):
    props = features.rename_props(maps.only_keys(F.col("tags"), ["name", "surface", "highway"]), [("label", "TEXT", "name"), ("cover", "TEXT", "surface")])
    text = F.array_join(F.array_sort(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "osm_lines").where("tags IS NOT NULL").select("way_id", text.alias("props")).distinct()


# Joins over a grid


@query("ref_j1_rect_probe", """
WITH b AS (SELECT region_id, min(p.x) AS x0, min(p.y) AS y0, max(p.x) AS x1, max(p.y) AS y1 FROM (SELECT region_id, unnest(flatten(rings)) AS p FROM regions) GROUP BY region_id),
j AS (SELECT DISTINCT jct_id, point.x AS x, point.y AS y FROM jcts WHERE point IS NOT NULL)
SELECT region_id AS rect_id, jct_id AS id FROM b JOIN j ON x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def j1(spark, d):
    v = F.flatten("rings")
    axis = lambda end, k: end(F.transform(v, lambda p: p[k]))
    rects = table(spark, d, "regions").select(F.col("region_id").alias("rect_id"), axis(F.array_min, "x").alias("x0"), axis(F.array_min, "y").alias("y0"), axis(F.array_max, "x").alias("x1"), axis(F.array_max, "y").alias("y1"))
    points = table(spark, d, "jcts").where("point IS NOT NULL").select(F.col("jct_id").alias("id"), F.col("point").alias("p")).distinct()
    return grid.rect_probe(rects, points, 0.1).select("rect_id", "id")


def _jct_points(spark, d) -> DataFrame:
    return table(spark, d, "jcts").where("point IS NOT NULL").select("jct_id", _planar(F.col("point")).alias("pt")).distinct()


_JCTS = f"j AS (SELECT DISTINCT jct_id, (point.x + {LON0}) * {KX} AS x, (point.y - {LAT0}) * {KY} AS y FROM jcts WHERE point IS NOT NULL)"


@query("ref_j2_radius_join", f"""
WITH {_JCTS} SELECT a.jct_id AS id1, b.jct_id AS id2, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 3) AS dist FROM j a JOIN j b ON b.x BETWEEN a.x - 80 AND a.x + 80 AND abs(b.y - a.y) < 80 AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) < 80 AND a.jct_id < b.jct_id""")
def j2(spark, d):
    p = _jct_points(spark, d)
    met = grid.radius_join(p.select(F.col("jct_id").alias("id1"), F.col("pt").alias("p1")), p.select(F.col("jct_id").alias("id2"), F.col("pt").alias("p2")), 80.0)
    return met.where("id1 < id2").select("id1", "id2", _r(F.col("dist")).alias("dist"))


def _nodes(spark, d) -> DataFrame:
    """Current nodes: node_id, pt (planar), tags."""
    last = table(spark, d, "osm_nodes").groupBy("id").agg(F.max(F.struct("version", "loaded_at", "visible", "lon", "lat")).alias("m"), F.max_by("tags", F.struct("version", "loaded_at")).alias("tags"))
    return last.where("m.visible AND m.lon IS NOT NULL AND m.lat IS NOT NULL").select(F.col("id").alias("node_id"), _planar(geom.point(F.col("m.lon"), F.col("m.lat"))).alias("pt"), "tags")


_NODES = f"""
nodes AS (SELECT id AS node_id, (lon + {LON0}) * {KX} AS x, (lat - {LAT0}) * {KY} AS y, tags FROM (SELECT * FROM osm_nodes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, loaded_at DESC NULLS LAST, visible DESC NULLS LAST, lon DESC NULLS LAST, lat DESC NULLS LAST) = 1) WHERE visible AND lon IS NOT NULL AND lat IS NOT NULL)"""


@query("ref_j3_isolated_seeds", f"""
WITH {_JCTS}, {_NODES}, near AS (SELECT a.jct_id, count(*) AS n FROM j a JOIN j b ON b.x BETWEEN a.x - 100 AND a.x + 100 AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) < 100 GROUP BY a.jct_id HAVING count(*) = 1),
other AS (SELECT a.jct_id, count(*) AS n, min(n.node_id) AS node_id, min(sqrt(pow(n.x - a.x, 2) + pow(n.y - a.y, 2))) AS dist FROM j a JOIN nodes n ON n.x BETWEEN a.x - 100 AND a.x + 100 AND sqrt(pow(n.x - a.x, 2) + pow(n.y - a.y, 2)) < 100 GROUP BY a.jct_id HAVING count(*) = 1)
SELECT o.jct_id AS jct1, o.node_id AS jct2, round(o.dist, 3) AS dist FROM other o JOIN near USING (jct_id) WHERE o.dist <= 40""")
def j3(spark, d):
    found = grid.isolated_seeds(_jct_points(spark, d), _nodes(spark, d).select(F.col("node_id").alias("jct_id"), "pt"), 40.0, 100.0)
    return found.select("jct1", "jct2", _r(F.col("dist")).alias("dist"))


@query("ref_j4_names_in_common", f"""
WITH {_NAMED} SELECT way_id, a, b, coalesce(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) >= 2, false) AS two FROM named""")
def j4(spark, d):
    rows = table(spark, d, "osm_lines").select("way_id", F.element_at("tags", "name").alias("a"), F.element_at("tags", "alt_name").alias("b"), F.element_at("tags", "old_name").alias("c")).distinct()
    two = F.coalesce(grid.two_names_in_common(F.split("a", " "), F.split("b", " ")), F.lit(False))
    return rows.select("way_id", "a", "b", two.alias("two"))


# OSM ways


def _ways(spark, d) -> DataFrame:
    """Latest version of each way: way_id, tags, node_ids without nulls."""
    last = table(spark, d, "osm_ways").where("nodes IS NOT NULL").select("id", F.struct("version", "loaded_at", F.array_compact("nodes").alias("nodes")).alias("m"), "tags").groupBy("id").agg(F.max("m").alias("m"), F.max_by("tags", "m").alias("tags"))
    return last.select(F.col("id").alias("way_id"), "tags", F.col("m.nodes").alias("node_ids"))


_WAYS = """
ways AS (SELECT id AS way_id, tags, list_filter(nodes, lambda n: n IS NOT NULL) AS node_ids FROM osm_ways WHERE nodes IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, loaded_at DESC NULLS LAST, list_filter(nodes, lambda n: n IS NOT NULL) DESC) = 1),
refs AS (SELECT way_id, pos, node_ids[pos] AS node_id FROM (SELECT *, unnest(range(1, len(node_ids) + 1)) AS pos FROM ways))"""


def _ids(c: str) -> Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query("ref_f8_way_filter", f"WITH {_WAYS} SELECT way_id, tags['highway'] AS highway FROM ways WHERE tags['highway'] IS NOT NULL")
def f8(spark, d):
    return osm.highway_ways(_ways(spark, d)).select("way_id", F.element_at("tags", "highway").alias("highway"))


@query("ref_f9_way_clip", f"""
WITH {_WAYS}, {_NODES}, inside AS (SELECT node_id FROM nodes WHERE x >= 40000 AND x < 90000 AND y >= 40000 AND y < 100000)
SELECT way_id, array_to_string(list(node_id ORDER BY pos), ',') AS node_ids FROM refs JOIN inside USING (node_id) GROUP BY way_id HAVING count(*) >= 2""")
def f9(spark, d):
    return osm.keep_live_refs(_ways(spark, d), osm.clip_nodes(_nodes(spark, d), clip=(40000.0, 40000.0, 90000.0, 100000.0)), clipped=True).select("way_id", _ids("node_ids").alias("node_ids"))


@query("ref_f10_f12_clean_refs", f"""
WITH {_WAYS}, {_NODES}, live AS (SELECT way_id, pos, node_id, lag(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS prev FROM refs JOIN nodes USING (node_id))
SELECT way_id, array_to_string(list(node_id ORDER BY pos), ',') AS node_ids FROM live WHERE prev IS NULL OR prev <> node_id GROUP BY way_id HAVING count(*) >= 2""")
def f10(spark, d):
    live = osm.keep_live_refs(_ways(spark, d), _nodes(spark, d)).withColumn("node_ids", osm.destutter(F.col("node_ids")))
    return osm.well_formed(live).select("way_id", _ids("node_ids").alias("node_ids"))


@query("ref_f13_vacuum", f"""
WITH {_WAYS}, {_NODES} SELECT node_id FROM nodes WHERE cardinality(tags) > 0 OR node_id IN (SELECT node_id FROM refs)""")
def f13(spark, d):
    return osm.vacuum(_nodes(spark, d), _ways(spark, d)).select("node_id")


@query("ref_a4_ref_counts", f"WITH {_WAYS} SELECT node_id, way_id, count(*) AS refs FROM refs GROUP BY 1, 2")
def a4(spark, d):
    return osm.node_ref_counts(_ways(spark, d))


@query("ref_a5_intersections", f"WITH {_WAYS} SELECT node_id FROM refs GROUP BY 1 HAVING count(DISTINCT way_id) > 1")
def a5(spark, d):
    return osm.intersections(_ways(spark, d))


_SPLIT = f"""
{_WAYS}, deg AS (SELECT node_id, count(DISTINCT way_id) AS n FROM refs GROUP BY 1),
big AS (SELECT way_id, len(node_ids) AS n FROM ways WHERE len(node_ids) >= 2),
marks AS (SELECT way_id, pos, lead(pos) OVER (PARTITION BY way_id ORDER BY pos) AS upto, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS idx
  FROM refs JOIN big USING (way_id) JOIN deg USING (node_id) WHERE pos = 1 OR pos = big.n OR deg.n > 1),
parts AS (SELECT m.way_id, m.idx, w.node_ids[m.pos:m.upto] AS node_ids FROM marks m JOIN ways w USING (way_id) WHERE m.upto IS NOT NULL)"""


@query("ref_w5_split_at_junctions", f"WITH {_SPLIT} SELECT way_id, idx, array_to_string(node_ids, ',') AS node_ids FROM parts")
def w5(spark, d):
    return osm.split_at_junctions(_ways(spark, d)).select("way_id", F.col("idx").cast("long").alias("idx"), _ids("node_ids").alias("node_ids"))


@query("ref_w2_segment_ids", f"WITH {_SPLIT} SELECT row_number() OVER (ORDER BY way_id, idx) AS seg_id, way_id, idx FROM parts")
def w2(spark, d):
    from wayweft.operators.ids import dense_ids

    return dense_ids(osm.split_at_junctions(_ways(spark, d)).select("way_id", F.col("idx").cast("long").alias("idx")), ["way_id", "idx"], "seg_id")


def _prepared(spark, d) -> osm.OsmData:
    return osm.prepare(_ways(spark, d), _nodes(spark, d))


_PREPARED = f"""
{_WAYS}, {_NODES}, live AS (SELECT way_id, pos, node_id, lag(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS prev FROM refs JOIN nodes USING (node_id) WHERE way_id IN (SELECT way_id FROM ways WHERE tags['highway'] IS NOT NULL)),
clean AS (SELECT way_id, list(node_id ORDER BY pos) AS node_ids FROM live WHERE prev IS NULL OR prev <> node_id GROUP BY way_id HAVING count(*) >= 2),
crefs AS (SELECT way_id, pos, node_ids[pos] AS node_id, len(node_ids) AS n FROM (SELECT *, unnest(range(1, len(node_ids) + 1)) AS pos FROM clean)),
cdeg AS (SELECT node_id, count(DISTINCT way_id) AS deg FROM crefs GROUP BY 1),
cmarks AS (SELECT way_id, pos, lead(pos) OVER (PARTITION BY way_id ORDER BY pos) AS upto, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS idx FROM crefs JOIN cdeg USING (node_id) WHERE pos = 1 OR pos = n OR deg > 1),
cparts AS (SELECT m.way_id, m.idx, c.node_ids[m.pos:m.upto] AS node_ids FROM cmarks m JOIN clean c USING (way_id) WHERE m.upto IS NOT NULL)"""


@query("ref_p12_j8_osm_network", f"""
WITH {_PREPARED}, pt AS (SELECT p.way_id, p.idx, k, n.x, n.y FROM (SELECT way_id, idx, unnest(range(1, len(node_ids) + 1)) AS k, unnest(node_ids) AS node_id FROM cparts) p JOIN nodes n USING (node_id)),
leg AS (SELECT way_id, idx, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS leg FROM pt WINDOW o AS (PARTITION BY way_id, idx ORDER BY k)), len AS (SELECT way_id, idx, sum(leg) AS length FROM leg GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY way_id, idx) AS seg_id, way_id, node_ids[1] AS from_jct, node_ids[-1] AS to_jct, round(length, 2) AS length FROM cparts JOIN len USING (way_id, idx)""")
def p12(spark, d):
    segs, _ = osm.create_path_network(_prepared(spark, d))
    return segs.select("seg_id", F.element_at("tags", "way_id").cast("long").alias("way_id"), "from_jct", "to_jct", _r(geom.length(F.col("pts")), 2).alias("length"))


# Centerline networks


def _city_network(spark, d, name="city") -> Network:
    rows = _city(spark, d)
    return network.from_centerlines(rows, lambda p: names.berkeley_names(F.col("fullname"), F.col("category")), F.col("category").isin("CONNECTOR", "HIGHWAY", "MAJOR", "MINOR", "PEDESTRIAN"), ["CATEGORY"], name=name)


_CITY_NET = f"""
{_CITY}, kept AS (SELECT *, row_number() OVER (ORDER BY objectid, part) AS seg_id FROM city WHERE category IN ('CONNECTOR', 'HIGHWAY', 'MAJOR', 'MINOR', 'PEDESTRIAN') AND len(pts) >= 2),
ends AS (SELECT pts[1].x AS x, pts[1].y AS y, seg_id * 2 AS seen FROM kept UNION ALL SELECT pts[-1].x, pts[-1].y, seg_id * 2 + 1 FROM kept),
places AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) AS jct_id FROM ends GROUP BY x, y),
segs AS (SELECT k.seg_id, k.fullname, k.category, k.pts, a.jct_id AS from_jct, b.jct_id AS to_jct FROM kept k JOIN places a ON a.x = k.pts[1].x AND a.y = k.pts[1].y JOIN places b ON b.x = k.pts[-1].x AND b.y = k.pts[-1].y)"""


# Names of a segment: the full name and the route of a highway, canonical, distinct, sorted.
_OWN_NAMES = f"""
own AS (SELECT *, string_split(fullname, ' ') AS w, category IN ('CONNECTOR', 'HIGHWAY') AS big FROM segs),
listed AS (SELECT seg_id, from_jct, to_jct, CASE WHEN fullname IS NULL OR contains(fullname, 'UNNAMED') OR fullname = 'ALLEY' OR (fullname = 'TRAIL' AND category = 'PEDESTRIAN') OR (fullname = 'RAMP' AND category = 'CONNECTOR') THEN []
  ELSE [fullname, CASE WHEN big AND len(w) > 1 AND w[1] LIKE 'I%' AND regexp_matches(substr(w[1], 2), '^[+]?0*[1-9][0-9]*$') THEN w[1] WHEN big AND len(w) > 1 AND w[1] = 'HWY' AND regexp_matches(w[2], '^[+]?0*[1-9][0-9]*$') THEN 'CA ' || w[2] END] END AS l FROM own),
each AS (SELECT seg_id, from_jct, to_jct, unnest(l) AS name FROM listed),
canon AS (SELECT DISTINCT seg_id, from_jct, to_jct, {canonical_sql('name')} AS name FROM each WHERE name IS NOT NULL)"""


@query("ref_p1_w1_j7_city_network", f"""WITH {_CITY_NET}, {_OWN_NAMES}, n AS (SELECT seg_id, string_agg(name, ';' ORDER BY name) AS names FROM canon WHERE name <> '' GROUP BY seg_id)
SELECT s.seg_id, s.from_jct, s.to_jct, s.category, coalesce(n.names, '') AS names, round({_LENGTH}, 3) AS length FROM segs s LEFT JOIN n USING (seg_id)""")
def p1(spark, d):
    segs = _city_network(spark, d).segs
    return segs.select("seg_id", "from_jct", "to_jct", F.element_at("tags", "CATEGORY").alias("category"), F.array_join("names", ";").alias("names"), _r(geom.length(F.col("pts"))).alias("length"))


_HALF = f"""
{_CITY_NET}, half AS (SELECT from_jct AS jct, to_jct AS end_jct, seg_id, false AS upstream, {_bearing_sql('pts[1]', 'pts[2]')} AS bearing FROM segs WHERE from_jct <> to_jct
  UNION ALL SELECT to_jct, from_jct, seg_id, true, CASE WHEN from_jct = to_jct THEN {_bearing_sql('pts[1]', 'pts[2]')} ELSE {_bearing_sql('pts[-1]', 'pts[-2]')} END FROM segs)"""


@query("ref_j9_half_edges", f"WITH {_HALF} SELECT jct, end_jct, seg_id, upstream, round(bearing, 6) AS bearing FROM half")
def j9(spark, d):
    return network.half_edges(_city_network(spark, d).segs).select("jct", "end_jct", "seg_id", "upstream", _r(F.col("bearing"), 6).alias("bearing"))


@query("ref_j12_w9_next_spoke", f"""
WITH {_HALF}, met AS (SELECT a.seg_id, a.jct, b.seg_id AS next_seg, {_delta_sql('a.bearing', 'b.bearing')} AS delta FROM half a JOIN half b ON b.jct = a.end_jct)
SELECT seg_id, jct, next_seg, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, jct ORDER BY delta, next_seg) AS k FROM met WHERE delta < 180) WHERE k = 1 AND delta <= 90""")
def j12(spark, d):
    return network.next_half_edge(network.half_edges(_city_network(spark, d).segs)).select("seg_id", "jct", "next_seg", _r(F.col("delta"), 6).alias("delta"))


@query("ref_a6_jct_segments", f"WITH {_CITY_NET} SELECT jct_id, array_to_string(list_sort(list(DISTINCT seg_id)), ',') AS seg_ids, count(DISTINCT seg_id) AS degree FROM (SELECT from_jct AS jct_id, seg_id FROM segs UNION SELECT to_jct, seg_id FROM segs) GROUP BY jct_id")
def a6(spark, d):
    return network.jct_segments(_city_network(spark, d).segs).select("jct_id", _ids("seg_ids").alias("seg_ids"), F.col("degree").cast("long").alias("degree"))


@query("ref_a7_u2_u3_jct_names", f"""
WITH {_CITY_NET}, {_OWN_NAMES}, n AS (SELECT from_jct AS jct_id, name FROM canon UNION SELECT to_jct, name FROM canon) SELECT jct_id, string_agg(name, ';' ORDER BY name) AS names FROM n WHERE name <> '' GROUP BY jct_id""")
def a7(spark, d):
    return network.jct_names(_city_network(spark, d).segs).select("jct_id", F.array_join("names", ";").alias("names"))


@query("ref_c1_check", f"""
WITH {_CITY_NET}, s AS (SELECT *, seg_id % 40 AS m FROM segs), j AS (SELECT *, jct_id % 40 AS m FROM places),
hurt AS (SELECT seg_id, CASE WHEN m = 3 THEN -seg_id ELSE from_jct END AS from_jct, CASE WHEN m = 4 THEN -seg_id ELSE to_jct END AS to_jct, CASE WHEN m = 5 THEN {{'x': pts[1].x + 7, 'y': pts[1].y}} ELSE pts[1] END AS a, CASE WHEN m = 2 THEN pts[1] WHEN m = 6 THEN {{'x': pts[-1].x, 'y': pts[-1].y + 7}} ELSE pts[-1] END AS b, m FROM s),
every AS (SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE m = 1), spots AS (SELECT jct_id, x, y FROM j UNION ALL SELECT jct_id, x, y FROM j WHERE m = 7 UNION ALL SELECT -1000000000 - jct_id, x, y FROM j WHERE m = 8)
SELECT 'short segment' AS kind, seg_id AS id FROM every WHERE m = 2 UNION ALL SELECT DISTINCT 'repeated segment id', seg_id FROM every WHERE m = 1 UNION ALL SELECT DISTINCT 'repeated junction id', jct_id FROM j WHERE m = 7
UNION ALL SELECT 'from_jct missing', seg_id FROM every WHERE m = 3 UNION ALL SELECT 'to_jct missing', seg_id FROM every WHERE m = 4
UNION ALL SELECT 'from_jct elsewhere', seg_id FROM every e JOIN spots p ON p.jct_id = e.from_jct WHERE p.x <> e.a.x OR p.y <> e.a.y UNION ALL SELECT 'to_jct elsewhere', seg_id FROM every e JOIN spots p ON p.jct_id = e.to_jct WHERE p.x <> e.b.x OR p.y <> e.b.y
UNION ALL SELECT 'junction without segment', jct_id FROM spots p WHERE NOT EXISTS (SELECT 1 FROM every e WHERE e.from_jct = p.jct_id OR e.to_jct = p.jct_id)""")
def c1(spark, d):
    """All kinds of violations in a network that was damaged in each of these ways."""
    net, m, pts = _city_network(spark, d), F.col("seg_id") % 40, F.col("pts")
    moved = lambda p, x, y: F.array(geom.point(p["x"] + x, p["y"] + y))
    bent = F.when(m == 5, F.concat(moved(geom.first(pts), 7, 0), F.slice(pts, F.lit(2), F.size(pts)))).when(m == 2, F.slice(pts, 1, 1)).when(m == 6, F.concat(F.slice(pts, F.lit(1), F.size(pts) - 1), moved(geom.last(pts), 0, 7))).otherwise(pts)
    segs = net.segs.withColumns({"from_jct": F.when(m == 3, -F.col("seg_id")).otherwise(F.col("from_jct")), "to_jct": F.when(m == 4, -F.col("seg_id")).otherwise(F.col("to_jct")), "pts": bent})
    more = net.jcts.where("jct_id % 40 = 7").unionByName(net.jcts.where("jct_id % 40 = 8").withColumn("jct_id", -1_000_000_000 - F.col("jct_id")))
    return network.check(net.with_(segs=segs.unionByName(segs.where(m == 1)), jcts=net.jcts.unionByName(more)))


@query("ref_p4_w3_split_segments", f"""
WITH {_CITY_NET}, l AS (SELECT seg_id, {_LENGTH} AS n FROM segs), cut AS (SELECT seg_id, n FROM l WHERE n > 0)
SELECT seg_id, round(0.25 * n, 3) AS length FROM cut UNION ALL SELECT -seg_id, round(0.75 * n, 3) FROM cut UNION ALL SELECT seg_id, round(n, 3) FROM l WHERE NOT n > 0""")
def p4(spark, d):
    segs = _city_network(spark, d).segs
    cuts = segs.select("seg_id", (geom.length(F.col("pts")) * 0.25).alias("d"), (F.col("seg_id") % 2 == 0).alias("from_start"), (-F.col("seg_id") - 1_000_000).alias("new_jct"), (-F.col("seg_id")).alias("new_seg"))
    return network.split_segments(segs, cuts).select("seg_id", _r(geom.length(F.col("pts"))).alias("length"))


@query("ref_a11_skipped", "SELECT count(*) FILTER (geometry->>'type' NOT IN ('LineString', 'MultiLineString')) AS skipped, count(*) AS features FROM (SELECT objectid, arg_max(geometry, loaded_at) AS geometry FROM centerline GROUP BY objectid)")
def a11(spark, d):
    return features.skipped_counts(_city(spark, d))


@query("ref_u1_union_features", f"""
WITH {_CITY_NET} SELECT 'LineString' AS geom_type, count(*) AS n, sum(seg_id)::BIGINT AS ids FROM segs UNION ALL SELECT 'Point', count(*), sum(jct_id)::BIGINT FROM places""")
def u1(spark, d):
    return geojson.network_features(_city_network(spark, d)).groupBy("geom_type").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


# Matching


def _osm_network(spark, d) -> Network:
    lines = _features(spark, d, "osm_lines", "way_id", []).withColumn("props", maps.merge(F.col("tags"), F.create_map(F.lit("way_id"), F.col("way_id").cast("string"))))
    return network.from_centerlines(lines.where(F.map_contains_key("tags", F.lit("highway"))), lambda p: names.osm_names(F.col("tags")), name="osm")


@query("ref_p5_p10_match_networks")
def p9(spark, d):
    """City against OSM lines, crawled to the end; rows are the matched segments with their scores."""
    one, two = matching.match_networks(_osm_network(spark, d), _city_network(spark, d))
    return one.segs.where("match_id IS NOT NULL").select("seg_id", "match_id", "match_rev", "score_name", "score_geo1", "score_geo2", "score_bearing1", "score_bearing2", "score")


def _chords(net: Network) -> DataFrame:
    return net.segs.withColumn("pts", F.array(geom.first(F.col("pts")), geom.last(F.col("pts"))))


@query("ref_j10_j11_spoke_candidates", f"""
WITH {_CITY_NET}, chord AS (SELECT seg_id, from_jct, to_jct, pts[1].x AS ax, pts[1].y AS ay, pts[-1].x AS bx, pts[-1].y AS bb FROM segs),
h AS (SELECT from_jct AS jct, seg_id, ax, ay, bx, bb, sqrt(pow(bx - ax, 2) + pow(bb - ay, 2)) AS len FROM chord WHERE from_jct <> to_jct UNION ALL SELECT to_jct, seg_id, bx, bb, ax, ay, sqrt(pow(bx - ax, 2) + pow(bb - ay, 2)) FROM chord),
m AS (SELECT a.jct AS j1, b.jct AS j2, a.seg_id AS seg_id1, b.seg_id AS seg_id2, a.len AS len1, b.len AS len2, a.ax, a.ay, a.bx, a.bb, b.ax AS cx, b.ay AS cy, b.bx AS ex, b.bb AS ey FROM h a JOIN h b ON a.jct = b.jct),
p AS (SELECT *, CASE WHEN len1 <= len2 THEN len1 ELSE CASE WHEN len1 > 0 THEN least(1, greatest(0, ((ex - ax) * (bx - ax) + (ey - ay) * (bb - ay)) / (len1 * len1))) ELSE 0 END * len1 END AS d1,
  CASE WHEN len1 <= len2 THEN CASE WHEN len2 > 0 THEN least(1, greatest(0, ((bx - cx) * (ex - cx) + (bb - cy) * (ey - cy)) / (len2 * len2))) ELSE 0 END * len2 ELSE len2 END AS d2 FROM m),
c AS (SELECT * FROM p WHERE abs(d1 - d2) <= greatest(8.0, 0.1 * least(len1, len2)) AND sqrt(pow(ax + CASE WHEN len1 > 0 THEN d1 / len1 ELSE 0 END * (bx - ax) - cx - CASE WHEN len2 > 0 THEN d2 / len2 ELSE 0 END * (ex - cx), 2)
  + pow(ay + CASE WHEN len1 > 0 THEN d1 / len1 ELSE 0 END * (bb - ay) - cy - CASE WHEN len2 > 0 THEN d2 / len2 ELSE 0 END * (ey - cy), 2)) <= 8.0),
u AS (SELECT *, count(*) OVER (PARTITION BY j1, j2, seg_id1) AS n1, count(*) OVER (PARTITION BY j1, j2, seg_id2) AS n2 FROM c)
SELECT j1, j2, seg_id1, seg_id2, round(d1, 3) AS d1, round(d2, 3) AS d2 FROM u WHERE n1 = 1 AND n2 = 1""")
def j10(spark, d):
    half = network.half_edges(_chords(_city_network(spark, d)))
    frontier = half.select(F.col("jct").alias("j1"), F.col("jct").alias("j2")).distinct()
    found = matching.mutual_unique(matching.spoke_candidates(frontier, half, half, geom.STREET_M))
    return found.select("j1", "j2", "seg_id1", "seg_id2", _r(F.col("d1")).alias("d1"), _r(F.col("d2")).alias("d2"))


# Scores and reports


_FACTOR = " * ".join(f"({1 - i} + {i} * coalesce({n}, 50) / 100.0)" for n, i in scoring.IMPORTANCE.items())


@query("ref_r2_r7_scores", f"""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS div, l_extendedprice / 100 AS a, (l_orderkey % 97) * 1.0 AS b, (l_partkey % 181) * 1.0 AS abd, (l_partkey % 360) * 1.0 AS f1, (l_suppkey % 360) * 1.0 AS t1,
  ((l_partkey + 7) % 360) * 1.0 AS f2, ((l_suppkey + 11) % 360) * 1.0 AS t2, (l_orderkey % 2)::INTEGER AS rev, CASE WHEN l_linenumber % 3 > 0 THEN (l_partkey % 101)::INTEGER END AS score_name FROM lineitem),
s AS (SELECT *, round(100 * (1 - least(div, 30) / 30))::INTEGER AS score_geo1, CASE WHEN least(a, b) < 0.3 THEN 0 ELSE round(100 * greatest(0, 1 - div / least(a, b)))::INTEGER END AS score_geo2, round(100 * (1 - abd / 180))::INTEGER AS raw_b1,
  {_delta_sql('f1', '(CASE WHEN rev = 1 THEN t2 ELSE f2 END)')} AS d1, {_delta_sql('t1', '(CASE WHEN rev = 1 THEN f2 ELSE t2 END)')} AS d2 FROM l),
b AS (SELECT *, CASE WHEN abd <= 180 THEN raw_b1 END AS score_bearing1, round(100 * ((1 - d1 / 180) * (1 - d2 / 180)))::INTEGER AS score_bearing2 FROM s)
SELECT k, n, coalesce(score_name, -1) AS score_name, score_geo1, score_geo2, coalesce(score_bearing1, -1) AS score_bearing1, score_bearing2, count(*) AS c, round(100 * ({_FACTOR}))::INTEGER AS score FROM b GROUP BY ALL""")
def r2(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), c("l_quantity").alias("div"), (c("l_extendedprice") / 100).alias("a"), (c("l_orderkey") % 97).cast("double").alias("b"), (c("l_partkey") % 181).cast("double").alias("abd"),
        (c("l_partkey") % 360).cast("double").alias("f1"), (c("l_suppkey") % 360).cast("double").alias("t1"), ((c("l_partkey") + 7) % 360).cast("double").alias("f2"), ((c("l_suppkey") + 11) % 360).cast("double").alias("t2"),
        (c("l_orderkey") % 2).cast("int").alias("rev"), F.when(c("l_linenumber") % 3 > 0, (c("l_partkey") % 101).cast("int")).alias("score_name"),
    )
    rows = rows.withColumns({"score_geo1": scoring.geo1(c("div"), 1.0), "score_geo2": scoring.geo2(c("div"), c("a"), c("b"), 1.0), "score_bearing1": scoring.bearing1(c("abd")), "score_bearing2": scoring.bearing2(c("f1"), c("t1"), c("f2"), c("t2"), c("rev"))})
    rows = rows.withColumn("score", scoring.combine()).fillna(-1, ["score_name", "score_bearing1"])
    return rows.groupBy("k", "n", "score_name", "score_geo1", "score_geo2", "score_bearing1", "score_bearing2", "score").agg(F.count("*").alias("c"))



# Schema inference and sources


@query("ref_y1_infer_specs", """
WITH k AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events), v AS (SELECT k.key, json_type(props, '$.' || k.key) AS t, abs(try_cast(props->>('$.' || k.key) AS DOUBLE)) AS a FROM events, k),
r AS (SELECT key, max(CASE WHEN t IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 0 WHEN t = 'DOUBLE' THEN 1 ELSE 2 END) AS r, max(a) AS a FROM v WHERE t IS NOT NULL AND t <> 'NULL' GROUP BY key)
SELECT key AS col_name, CASE WHEN r = 0 AND a > 1073741824 THEN 'BIGINT' WHEN r = 0 THEN 'INT' WHEN r = 1 THEN 'FLOAT' ELSE 'TEXT' END AS col_type FROM r UNION ALL SELECT 'geometry', 'POINT'""")
def y1(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.lit("Point").alias("geom_type"), F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>").alias("props"))
    return spark.createDataFrame([(n, k) for n, k, _ in features.infer_specs(rows, "Point")], "col_name string, col_type string")


@query("ref_s6_osm_json", """
WITH p AS (SELECT raw_id, payload::JSON AS j FROM osm_raw WHERE json_valid(payload) AND left(ltrim(payload), 1) = '{'), e AS (SELECT raw_id, unnest((j->'elements')::JSON[]) AS e FROM p WHERE json_type(j, '$.elements') = 'ARRAY')
SELECT DISTINCT (e->>'id')::BIGINT AS node_id, round((e->>'lon')::DOUBLE, 6) AS lon, round((e->>'lat')::DOUBLE, 6) AS lat FROM e WHERE e->>'type' = 'node'""")
def s6(spark, d):
    """Nodes of the answers that are plain documents, as far as SQL follows; ref_s6_osm_json_elements has all."""
    whole = table(spark, d, "osm_raw").where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"))
    nodes = osm_files.from_json_answers(whole, "payload").nodes
    return nodes.select("node_id", F.round("pt.x", 6).alias("lon"), F.round("pt.y", 6).alias("lat")).distinct()


@query("ref_s6_osm_json_elements")
def s6_elements(spark, d):
    """Nodes and ways of all answers, with refs and tags, however often an answer is encoded."""
    data = osm_files.from_json_answers(table(spark, d, "osm_raw"), "payload")
    tags = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("tags")
    nodes = data.nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("pt.x").alias("lon"), F.col("pt.y").alias("lat"), F.array().cast("array<bigint>").alias("node_ids"), tags)
    ways = data.ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), "node_ids", tags)
    return nodes.unionByName(ways).distinct()


# Round trips through files and tables, in the shared folder


def _local(path: str) -> str:
    """A path of the shared folder for sinks that write on the driver."""
    return path.removeprefix("file:")


@query("ref_s1_k1_geojson_round_trip", f"""
WITH {_CITY} SELECT objectid, part, fullname AS name, len(pts) AS points, round({_LENGTH}, 3) AS length FROM city""")
def s1(spark, d):
    """One collection written on the driver and read back by lines."""
    rows = _city(spark, d).select(F.col("objectid").alias("ord"), F.col("objectid").alias("feature_id"), "geom_type", "parts", "props")
    path = shared_path(spark, "geojson")
    geojson.write_features(rows, _local(path), "http://example.org/ref/")
    back = network.line_parts(geojson.read_features(spark, path))
    return back.select(F.col("feature_id").alias("objectid"), F.col("part").cast("long").alias("part"), features.text_of(F.col("props"), "FULLNAME").alias("name"), F.size("pts").cast("long").alias("points"), _r(geom.length(F.col("pts"))).alias("length"))


@query("ref_s1_k1_geojson_lines", f"""
WITH {_CITY} SELECT objectid, part, fullname AS name, len(pts) AS points, round({_LENGTH}, 3) AS length FROM city""")
def s1_lines(spark, d):
    """Features written and read by the tasks."""
    rows = _city(spark, d).select(F.col("objectid").alias("ord"), F.col("objectid").alias("feature_id"), "geom_type", "parts", "props")
    path = shared_path(spark, "geojson")
    geojson.write_feature_lines(rows, path)
    back = network.line_parts(geojson.read_features(spark, path, lines=True))
    return back.select(F.col("feature_id").alias("objectid"), F.col("part").cast("long").alias("part"), features.text_of(F.col("props"), "FULLNAME").alias("name"), F.size("pts").cast("long").alias("points"), _r(geom.length(F.col("pts"))).alias("length"))


@query("ref_s3_k3_k4_network_file", f"""
WITH {_CITY_NET}, {_OWN_NAMES}, n AS (SELECT seg_id, string_agg(name, ';' ORDER BY name) AS names FROM canon WHERE name <> '' GROUP BY seg_id)
SELECT 'segment' AS kind, s.seg_id AS id, s.from_jct, s.to_jct, s.category, coalesce(n.names, '') AS names, round({_LENGTH}, 3) AS length FROM segs s LEFT JOIN n USING (seg_id)
UNION ALL SELECT 'junction', jct_id, NULL, NULL, NULL, NULL, round(x + y, 3) FROM places""")
def s3(spark, d):
    """A network written to its file and read back: segments and junctions."""
    path = shared_path(spark, "network")
    geojson.write_network(_city_network(spark, d), _local(path))
    net = geojson.read_network(spark, path, "city")
    none = lambda t: F.lit(None).cast(t)
    segs = net.segs.select(F.lit("segment").alias("kind"), F.col("seg_id").alias("id"), "from_jct", "to_jct", F.element_at("tags", "CATEGORY").alias("category"), F.array_join("names", ";").alias("names"), _r(geom.length(F.col("pts"))).alias("length"))
    return segs.unionByName(net.jcts.select(F.lit("junction").alias("kind"), F.col("jct_id").alias("id"), none("bigint").alias("from_jct"), none("bigint").alias("to_jct"), none("string").alias("category"), none("string").alias("names"), _r(F.col("pt.x") + F.col("pt.y")).alias("length")))


@query("ref_s4_osm_xml_round_trip", f"""
WITH {_WAYS}, {_NODES} SELECT 'way' AS kind, way_id AS id, array_to_string(node_ids, ',') AS node_ids, tags['name'] AS name, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM ways
UNION ALL SELECT 'node', node_id, NULL, tags['name'], round(x, 5), round(y, 5) FROM nodes""")
def s4(spark, d):
    """Ways and nodes written as XML and read back by the XML scan."""
    path = shared_path(spark, "xml")
    tag = F.transform(F.map_entries("tags"), lambda e: F.struct(F.lit(None).cast("string").alias("_VALUE"), e["key"].alias("_k"), e["value"].alias("_v")))
    nd = F.transform("node_ids", lambda n: F.struct(F.lit(None).cast("string").alias("_VALUE"), n.alias("_ref")))
    _ways(spark, d).select(F.col("way_id").alias("_id"), nd.alias("nd"), tag.alias("tag")).write.format("xml").option("rootTag", "osm").option("rowTag", "way").save(path + "/ways")
    _nodes(spark, d).select(F.col("node_id").alias("_id"), F.col("pt.y").alias("_lat"), F.col("pt.x").alias("_lon"), tag.alias("tag")).write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(path + "/nodes")
    none = F.lit(None).cast("double")
    ways = osm_files.read_xml(spark, path + "/ways").ways.select(F.lit("way").alias("kind"), F.col("way_id").alias("id"), _ids("node_ids").alias("node_ids"), F.element_at("tags", "name").alias("name"), none.alias("x"), none.alias("y"))
    nodes = osm_files.read_xml(spark, path + "/nodes").nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("node_ids"), F.element_at("tags", "name").alias("name"), _r(F.col("pt.x"), 5).alias("x"), _r(F.col("pt.y"), 5).alias("y"))
    return ways.unionByName(nodes)


@query("ref_k5_osm_features", f"""
WITH {_PREPARED}, n AS (SELECT way_id, count(*) AS points FROM (SELECT way_id, unnest(node_ids) AS node_id FROM clean) JOIN nodes USING (node_id) GROUP BY 1)
SELECT 'LineString' AS geom_type, way_id AS id, points, w.tags['name'] AS name FROM n JOIN ways w USING (way_id) UNION ALL SELECT 'Point', node_id, 1, tags['name'] FROM nodes WHERE cardinality(tags) > 0 OR node_id IN (SELECT unnest(node_ids) FROM clean)""")
def k5(spark, d):
    """OSM ways and nodes as GeoJSON, written and read."""
    data = _prepared(spark, d)
    path = shared_path(spark, "geojson")
    geojson.write_feature_lines(geojson.osm_features(data.ways, data.nodes), path)
    back = geojson.read_features(spark, path, lines=True)
    return back.select("geom_type", F.col("feature_id").alias("id"), F.size(F.flatten("parts")).cast("long").alias("points"), features.text_of(F.col("props"), "name").alias("name"))


@query("ref_s10_k6_csv_round_trip", "SELECT DISTINCT objectid, coalesce(prefix, '') AS prefix, coalesce(streetname, '') AS streetname, coalesce(ftype, '') AS ftype FROM rlis_streets")
def s10(spark, d):
    """The report sink with its title, and the scan of what it wrote."""
    columns = ["objectid", "prefix", "streetname", "ftype"]
    path = shared_path(spark, "csv") + ".csv"
    tables.write_report(table(spark, d, "rlis_streets").select(columns).distinct().orderBy("objectid", "streetname"), _local(path), title=f"streets (generated: {tables.stamp()})")
    back = tables.read_csv(spark, path, len(columns)).where("c0 <> 'objectid' AND NOT startswith(c0, 'streets (generated')")
    return back.select(F.col("c0").cast("long").alias("objectid"), *[F.coalesce(f"c{i}", F.lit("")).alias(c) for i, c in enumerate(columns[1:], 1)])


def _kept(spark: SparkSession, names: list[str]) -> list[DataFrame]:
    """Tables of the catalog as frames that stay when the tables go."""
    out = [materialise(spark.table(n), "table") for n in names]
    for n in names:
        tables.drop_table(spark, n)
    return out


@query("ref_k9_k10_network_tables", f"""
WITH {_CITY_NET} SELECT 'segment' AS kind, seg_id AS id, from_jct, to_jct, category, len(pts) AS points FROM segs UNION ALL SELECT 'junction', jct_id, NULL, NULL, NULL, 1 FROM places UNION ALL SELECT 'geo', objectid, NULL, NULL, category, len(pts) FROM city WHERE part = 0 AND objectid IN (SELECT objectid FROM multi WHERE geometry->>'type' = 'LineString')""")
def k9(spark, d):
    """The network's tables and a table of features with inferred columns, written to the catalog and read back."""
    name = f"t{uuid.uuid4().hex}"
    tables.write_network(_city_network(spark, d, name), name)
    rows = _city(spark, d).withColumn("props", F.transform_values(F.map_concat("props", F.create_map(F.lit("OBJECTID"), F.col("objectid").cast("string"))), lambda _, v: v.cast("variant")))
    tables.write_geo(rows, f"{name}_geo", "LineString", [("OBJECTID", "BIGINT", "OBJECTID"), ("CATEGORY", "TEXT", "CATEGORY"), ("geometry", "LINESTRING", "geometry")])
    segs, jcts, geo = _kept(spark, [f"{name}_pnwk_segs", f"{name}_pnwk_jcts", f"{name}_geo"])
    own = maps.network_namespace(name)
    none, at = F.lit(None).cast("long"), lambda k: F.element_at("props", k)
    one = segs.select(F.lit("segment").alias("kind"), "id", *[at(f"{own}{c}_id").cast("long").alias(c) for c in ("from_jct", "to_jct")], at(f"{name}$CATEGORY").alias("category"), F.size("geometry").cast("long").alias("points"))
    two = jcts.select(F.lit("junction").alias("kind"), "id", none.alias("from_jct"), none.alias("to_jct"), F.lit(None).cast("string").alias("category"), F.lit(1).cast("long").alias("points"))
    return one.unionByName(two).unionByName(geo.select(F.lit("geo").alias("kind"), F.col("OBJECTID").alias("id"), none.alias("from_jct"), none.alias("to_jct"), F.col("CATEGORY").alias("category"), F.size("geometry").cast("long").alias("points")))


@query("ref_k12_j15_srs_rows", "SELECT * FROM (VALUES (832610, 'EPSG', 32610), (832611, 'EPSG', 32611), (802913, 'EPSG', 2913)) t(srid, auth_name, auth_srid)")
def k12(spark, d):
    """Rows of the table of reference systems: each is added once, incomplete ones never."""
    name = f"srs_{uuid.uuid4().hex}"
    for code in (32610, 32611, 2913, 32610):
        s = srs.SRS(auth_name="EPSG", auth_srid=code).resolved()
        tables.add_spatial_ref_sys(spark, s.postgis_srid, s.auth_name, s.auth_srid, s.srtext, s.proj4text, name)
    tables.add_spatial_ref_sys(spark, 1, None, 1, "", "", name)
    return _kept(spark, [name])[0].select("srid", "auth_name", "auth_srid")


@query("ref_s11_s15_select", "SELECT objectid, upper(fullname) AS name FROM centerline WHERE category = 'MAJOR' AND objectid > (SELECT avg(objectid) FROM centerline) GROUP BY ALL")
def s11(spark, d):
    """Selection from a table, and SQL with bound values."""
    name = f"c{uuid.uuid4().hex}"
    table(spark, d, "centerline").createOrReplaceTempView(name)
    low = tables.exec_sql(spark, f"SELECT avg(objectid) AS a FROM {name} WHERE objectid > :least", {"least": -1}).first().a
    return tables.select(spark, ["objectid", "upper(fullname) AS name"], name, f"category = 'MAJOR' AND objectid > {low}").distinct()


@query("ref_x6_own_name_rules", f"""WITH {_CITY_NET}
SELECT seg_id, coalesce(lower(array_to_string(list_filter(string_split(regexp_replace(fullname, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: w <> '' AND lower(w) NOT IN ('st', 'street', 'ave', 'avenue')), ' ')), '') AS name FROM segs""")
def x6(spark, d):
    """A network whose names follow other rules: letters only, no street types."""
    rules = names.CanonConfig(allowed="A-Za-z ", ignored="", words={"ST": "", "STREET": "", "AVE": "", "AVENUE": ""}, rewrites=())
    segs = network.from_centerlines(_city(spark, d), lambda p: F.array("fullname"), F.col("category").isin("CONNECTOR", "HIGHWAY", "MAJOR", "MINOR", "PEDESTRIAN"), config=rules).segs
    return segs.select("seg_id", F.lower(F.array_join("names", ";")).alias("name"))


# Further conditions, boxes and projections


@query("ref_f4_geometry_type", f"WITH {_CITY} SELECT DISTINCT objectid, geometry->>'type' AS kind FROM one WHERE geometry->>'type' = 'MultiLineString' AND category = 'MINOR'")
def f4(spark, d):
    found = features.filter_features(_city(spark, d), geom_type="MultiLineString", where=F.element_at("props", "CATEGORY") == "MINOR")
    return found.select("objectid", F.col("geom_type").alias("kind")).distinct()


@query("ref_x3_feature_hook", f"WITH {_CITY} SELECT objectid, upper(fullname) AS label FROM one WHERE geometry->>'type' = 'LineString' AND len((geometry->'coordinates')::JSON[]) > 2 AND fullname IS NOT NULL")
def x3(spark, d):
    """A caller's function changes features before the condition is looked at; then properties are chosen."""
    shout = lambda f: f.withColumn("props", F.map_concat("props", F.create_map(F.lit("LOUD"), F.upper(F.element_at("props", "FULLNAME"))))).withColumn("size", F.size(F.flatten("parts")))
    found = features.filter_features(_city(spark, d), transform=shout, where=F.col("size") > 2, geom_type="LineString", specs=[("label", "TEXT", "LOUD")])
    return found.select("objectid", F.element_at("props", "label").alias("label")).where("label IS NOT NULL")


UTM_CLIP = (560_000.0, 4_800_000.0, 600_000.0, 4_880_000.0)


def _utm_sql(source: str, key: str) -> str:
    """Key, x and y of places (key, lon, lat) in the projection of ref_g16_g18_utm."""
    return _UTM_SQL.replace(f"({_PLACES})", f"({source})").replace("jct_id", key).strip().replace("round(", "(").replace(", 2) AS x", ") AS x").replace(", 2) AS y", ") AS y")


@query("ref_f7_clip_after_projection", f"""
WITH {_NODES}, p AS ({_utm_sql(f"SELECT node_id, x / {KX} - {LON0} AS lon, y / {KY} + {LAT0} AS lat FROM nodes", "node_id")})
SELECT node_id, round(x, 1) AS x, round(y, 1) AS y FROM p WHERE x >= {UTM_CLIP[0]} AND x < {UTM_CLIP[2]} AND y >= {UTM_CLIP[1]} AND y < {UTM_CLIP[3]}""")
def f7(spark, d):
    """Nodes projected first and clipped in the plane."""
    degrees = _nodes(spark, d).withColumn("pt", geom.point(F.col("pt.x") / KX - LON0, F.col("pt.y") / KY + LAT0))
    return osm.clip_nodes(degrees, parse_proj4(UTM2), UTM_CLIP).select("node_id", _r(F.col("pt.x"), 1).alias("x"), _r(F.col("pt.y"), 1).alias("y"))


@query("ref_g18_projected_lines", f"""
WITH {_CITY}, v AS (SELECT objectid * 1000000 + part * 10000 + i AS k, pts[i].x / {KX} - {LON0} AS lon, pts[i].y / {KY} + {LAT0} AS lat FROM (SELECT objectid, part, pts, unnest(range(1, len(pts) + 1)) AS i FROM city)),
p AS ({_utm_sql("SELECT k, lon, lat FROM v", "k")}), l AS (SELECT k // 10000 AS line, k, x, y, lag(x) OVER w AS xp, lag(y) OVER w AS yp FROM p WINDOW w AS (PARTITION BY k // 10000 ORDER BY k))
SELECT line // 100 AS objectid, line % 100 AS part, round(sum(sqrt(pow(x - xp, 2) + pow(y - yp, 2))), 2) AS length FROM l GROUP BY 1, 2""")
def g18(spark, d):
    """Lines projected as a whole."""
    degrees = F.transform("pts", lambda p: geom.point(p["x"] / KX - LON0, p["y"] / KY + LAT0))
    line = parse_proj4(UTM2).line(degrees)
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), _r(geom.length(line), 2).alias("length"))


@query("ref_g6_g17_boxes", f"""
WITH b AS (SELECT min(point.x) AS x0, min(point.y) AS y0, max(point.x) AS x1, max(point.y) AS y1 FROM jcts WHERE point IS NOT NULL), c AS (SELECT 1 AS k, x0 AS lon, y0 AS lat FROM b UNION ALL SELECT 2, x1, y1 FROM b),
p AS ({_utm_sql("SELECT k, lon, lat FROM c", "k")}) SELECT round(min(x) - 1000, 2) AS xmin, round(min(y) - 1000, 2) AS ymin, round(max(x) + 1000, 2) AS xmax, round(max(y) + 1000, 2) AS ymax FROM p""")
def g6(spark, d):
    """The box around all junctions, projected and widened, as jobs make it."""
    box = table(spark, d, "jcts").where("point IS NOT NULL").agg(F.min("point.x"), F.min("point.y"), F.max("point.x"), F.max("point.y")).first()
    wide = geom.buffer_box(parse_proj4(UTM2).box(tuple(box)), 1000.0)
    return spark.createDataFrame([tuple(round(v, 2) for v in wide)], "xmin double, ymin double, xmax double, ymax double")


@query("ref_j5_seed_filters", f"""
WITH {_JCTS}, {_NODES}, near AS (SELECT a.jct_id, count(*) AS n FROM j a JOIN j b ON b.x BETWEEN a.x - 100 AND a.x + 100 AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) < 100 GROUP BY a.jct_id HAVING count(*) = 1),
other AS (SELECT a.jct_id, count(*) AS n, min(n.node_id) AS node_id, min(sqrt(pow(n.x - a.x, 2) + pow(n.y - a.y, 2))) AS dist FROM j a JOIN nodes n ON n.x BETWEEN a.x - 100 AND a.x + 100 AND sqrt(pow(n.x - a.x, 2) + pow(n.y - a.y, 2)) < 100 AND (a.jct_id + n.node_id) % 2 = 0 GROUP BY a.jct_id HAVING count(*) = 1)
SELECT o.jct_id AS jct1, o.node_id AS jct2, round(o.dist, 3) AS dist FROM other o JOIN near USING (jct_id) WHERE o.dist <= 40""")
def j5(spark, d):
    """Seeds among pairs that meet a caller's condition."""
    even = lambda met: (F.col("id1") + F.col("id2")) % 2 == 0
    found = grid.isolated_seeds(_jct_points(spark, d), _nodes(spark, d).select(F.col("node_id").alias("jct_id"), "pt"), 40.0, 100.0, [even])
    return found.select("jct1", "jct2", _r(F.col("dist")).alias("dist"))


@query("ref_y2_w8_fix_specs", """
SELECT * FROM (VALUES (1, 'NAME', 'TEXT', 'NAME'), (2, 'Name$1', 'INT', 'Name'), (3, 'length', 'FLOAT', 'len'), (4, 'name$2', 'TEXT', 'name'), (5, 'geometry', 'LINESTRING', 'geometry')) t(place, col_name, col_type, prop)""")
def y2(spark, d):
    """Names of columns made unique whatever the case, in order."""
    specs = features.fix_specs(["NAME", ("Name", "INT"), ("length", "FLOAT", "len"), "name", ("geometry", "LINESTRING")])
    return spark.createDataFrame([(i, *s) for i, s in enumerate(specs, 1)], "place int, col_name string, col_type string, prop string")


# Tables, features and systems


@query("ref_s2_unwrap_features", "SELECT region_id AS id, region_name AS name, (region_id % 90)::DOUBLE AS x FROM regions")
def s2(spark, d):
    """Features of Python objects: a collection, a list, and single features that only offer their interface."""

    class Offered:
        def __init__(self, feature):
            self.__geo_interface__ = feature

    rows = table(spark, d, "regions").select("region_id", "region_name").orderBy("region_id").collect()  # the same number at every scale
    made = [{"type": "Feature", "id": r[0], "geometry": {"type": "Point", "coordinates": [float(r[0] % 90), 0.0]}, "properties": {"name": r[1]}} for r in rows]
    third = len(made) // 3
    parts = [{"type": "FeatureCollection", "features": made[:third]}, made[third : 2 * third], [Offered(f) for f in made[2 * third :]]]
    found = [geojson.create_features(spark, p) for p in parts]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select(F.col("feature_id").alias("id"), features.text_of(F.col("props"), "name").alias("name"), F.col("parts")[0][0]["x"].alias("x"))


@query("ref_k7_k8_k11_table", "SELECT n_nationkey AS id, n_name AS \"a:name\", (n_regionkey * 0.5)::DOUBLE AS length, 'x' AS extra, 25 AS rows, 5 AS columns FROM nation")
def k7(spark, d):
    """A table created from column specs, rows given by name and by position, a column added; counts from the catalog."""
    name = f"t{uuid.uuid4().hex}"
    specs = [("id", "BIGINT", "id"), ("a:name", "TEXT", "name"), ("length", "FLOAT", "length"), ("geometry", "POINT", "geometry")]
    rows = [(r.n_nationkey, r.n_name, r.n_regionkey * 0.5, (1.0, 2.0)) for r in table(spark, d, "nation").collect()]  # the same 25 rows at every scale
    tables.create_table(spark, name, specs)
    tables.write_rows(spark, name, specs, [*rows[:10], *[{"id": i, "name": n, "length": v} for i, n, v, _ in rows[10:]]])
    tables.add_column(spark, name, "extra", "TEXT")
    n, columns, there = tables.num_rows(spark, name), len(tables.column_names(spark, name)), name in tables.table_names(spark)
    (kept,) = _kept(spark, [name])
    return kept.select("id", "`a:name`", "length", F.lit("x").alias("extra"), F.lit(n if there else -1).alias("rows"), F.lit(columns).alias("columns"))


@query("ref_k16_sql_geometry", f"WITH {_CITY} SELECT objectid, part, printf('ST_GeomFromText(''POINT (%.6f %.6f)'',%d)', pts[1].x, pts[1].y, 832610) AS text FROM city")
def k16(spark, d):
    return _city_lines(spark, d).select("objectid", F.col("part").cast("long").alias("part"), tables.sql_geometry(geom.wkt_point(geom.first(F.col("pts"))), 832610).alias("text"))


@query("ref_k17_osm_tables", f"WITH {_PREPARED} SELECT 'ways' AS kind, count(*) AS n FROM clean UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE cardinality(tags) > 0 OR node_id IN (SELECT unnest(node_ids) FROM clean) UNION ALL SELECT 'segs', count(*) FROM cparts UNION ALL SELECT 'jcts', count(DISTINCT j) FROM (SELECT node_ids[1] AS j FROM cparts UNION ALL SELECT node_ids[-1] FROM cparts)")
def k17(spark, d):
    """Ways, nodes and network written to the catalog side by side."""
    name, data = f"t{uuid.uuid4().hex}", _prepared(spark, d)
    segs, jcts = osm.create_path_network(data)
    tables.write_osm_tables(data.ways, data.nodes, Network(segs, jcts, name), name)
    kinds = {"ways": "ways", "nodes": "nodes", "segs": "pnwk_segs", "jcts": "pnwk_jcts"}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in zip(kinds, _kept(spark, [f"{name}_{t}" for t in kinds.values()]))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("ref_o11_o12_systems", """
SELECT code, srid, units, lon::DOUBLE AS lon, lat::DOUBLE AS lat, x::DOUBLE AS x, y::DOUBLE AS y FROM (VALUES (32610, 832610, 'meters', -123.0, 0.0, 500000.0, 0.0), (32755, 832755, 'meters', 147.0, 0.0, 500000.0, 10000000.0), (2913, 802913, 'feet', -120.5, 43.66666666666666, 8202099.738, 0.0), (2227, 802227, 'feet', -120.5, 36.5, 6561666.667, 1640416.667))
t(code, srid, units, lon, lat, x, y)""")
def o11(spark, d):
    """Systems by number, over WKT and back: the false origin lies where it is defined to lie."""
    out = []
    for code, lon, lat in ((32610, -123.0, 0.0), (32755, 147.0, 0.0), (2913, -120.5, 43.66666666666666), (2227, -120.5, 36.5)):
        s = srs.SRS(auth_name="EPSG", auth_srid=code).resolved()
        p = parse_proj4(srs.wkt_to_proj4(s.srtext))
        x, y = p.numbers(lon, lat)
        out.append((code, s.postgis_srid, p.units, lon, lat, round(x, 3), round(y, 3) + 0.0))
    return spark.createDataFrame(out, "code int, srid int, units string, lon double, lat double, x double, y double")
