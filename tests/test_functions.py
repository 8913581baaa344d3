"""Vectors for names, geometry, projections, maps and scores."""

import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayweft.functions import geom, maps, names
from wayweft.functions.projection import parse_proj4
from wayweft.operators import scoring
from wayweft.plans import reports


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def pts(*p):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])


def xy(p):
    return pytest.approx((p.x, p.y))


SAME = [
    ("Southeast Sunburst Lane", "SE SUNBURST LN"), ("Northeast Saint George Street", "NE ST GEORGE ST"), ("NE HALSEY ST FRONTAGE RD", "Northeast Halsey Street Frontage Road"), ("I84 FWY", "I 84"), (" 13133", "13133"),
    ("US BANCORP COLUMBIA CENTER TC", "UNITED STATES BANCORP COLUMBIA CENTER TRANSIT CENTER"), ("COEUR DALENE DR", "COEUR D'ALENE DR"), ("BURNSIDE BRG", "BURNSIDE BRIDGE"), ("BLAZER TRL", "BLAZER TRAIL"), ("HWY 30", "US 30"),
    ("MARTIN LUTHER KING  JUNIOR BLVD", "MARTIN LUTHER KING JR BLVD"), ("Mc Gee Street", "McGee Street"), ("Saint Alban's Road", "ST ALBANS RD"), ("Le Roy Avenue", "LeRoy Avenue"),
]


def test_canonical_names(spark):
    df = spark.createDataFrame(SAME, "a string, b string").select(names.canonical(F.col("a")).alias("a"), names.canonical(F.col("b")).alias("b"))
    for r in df.select("a", "b", names.canonical(F.col("a")).alias("again")).collect():
        assert r.a == r.b == r.again
    assert one(spark, x=names.canonical(F.lit(None).cast("string")), y=names.canonical(F.lit("é!"))) == (None, "")


def test_own_canonical_rules(spark):
    danish = names.CanonConfig(allowed="A-Za-z0-9 ÅåÆæØø", words={"VEJ": "V", "GONE": ""}, rewrites=())
    assert one(spark, x=names.canonical(F.lit("Pilegård gone  vej"), danish)).x == "PILEGÅRD V"
    assert one(spark, x=names.canonical(F.lit("Oak Avnue"), names.DEFAULT.with_words({"AVNUE": "AVE"}))).x == "OAK AVE"


def test_match_scores(spark):
    s = lambda a, b: one(spark, x=names.match_score(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).x
    assert s(["A St"], ["B Street"]) == 75
    assert s(["A St", "C Ave"], ["C Avenue"]) == 100
    assert one(spark, x=names.match_score(F.array().cast("array<string>"), F.array(F.lit("A")))).x is None


def test_name_builders(spark):
    b = lambda n, c: one(spark, x=names.berkeley_names(F.lit(n).cast("string"), F.lit(c).cast("string"))).x
    assert b("I80 E UNIVERSITY RAMP", "CONNECTOR") == ["I80 E UNIVERSITY RAMP", "I80"] and b("HWY 13 N", "HIGHWAY") == ["HWY 13 N", "CA 13"]
    assert b("TRAIL", "PEDESTRIAN") == b("RAMP", "CONNECTOR") == b("ALLEY", None) == b("UNNAMED 3", "MINOR") == b(None, "MINOR") == []
    assert b("TRAIL", "MINOR") == ["TRAIL"] and b("I80", "CONNECTOR") == ["I80"] and b("IX ST", "HIGHWAY") == ["IX ST"] and b("A", None) == ["A"]
    r = lambda *a: one(spark, x=names.rlis_names(*[F.lit(v).cast("string") for v in a])).x
    assert r("NE", "HALSEY", "ST") == ["NE HALSEY ST"] and r(None, "X", None) == ["X"] and r("NE", "UNNAMED", "ST") == r("NE", "", "ST") == r("NE", None, "ST") == []
    assert r("NE", "I84-I205", "RAMP") == ["NE I84-I205 RAMP", "NE I84", "I84", "NE I205", "I205"]
    tags = F.create_map(*[F.lit(v) for v in ("name", "A", "old_name", "B", "ref", "1;2")])
    assert one(spark, x=names.osm_names(tags)).x == ["A", "B", "1", "2"]
    assert one(spark, x=names.html_escape(F.lit("<a>&\"b\"&amp;"))).x == '&lt;a&gt;&amp;"b"&amp;amp;'


SQUARE = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]


def test_lengths_and_places(spark):
    n = one(spark, a=geom.length(F.array().cast(geom.LINE)), b=geom.length(pts((0, 0))), c=geom.length(pts((0, 0), (0, 1))), d=geom.length(pts((0, 0), (0, 1), (1, 1), (1, 0))), e=geom.length(F.lit(None).cast(geom.LINE)))
    assert tuple(n) == (0, 0, 1, 3, None)
    r = one(spark, **{f"i{d}": geom.interpolate(pts(*SQUARE), F.lit(float(d))) for d in (5, 20, 39, 99)}, neg=geom.interpolate(pts(*SQUARE), F.lit(-3.0)), p=geom.project(pts(*SQUARE), geom.point(F.lit(1), F.lit(5))), q=geom.project(pts(*SQUARE), geom.point(F.lit(11), F.lit(11))))
    assert [(r[k].x, r[k].y) for k in ("i5", "i20", "i39", "i99", "neg")] == [(0, 5), (10, 10), (1, 0), (0, 0), (0, 0)] and (r.p, r.q) == (5, 20)


def test_cut(spark):
    line = pts((0, 1), (10, 1), (20, 1), (30, 1))
    r = one(spark, a=geom.cut(line, F.lit(5.0)), b=geom.cut(line, F.lit(20.0)), c=geom.cut(line, F.lit(0.0)), d=geom.cut(line, F.lit(30.0)))
    assert [len(r.a.head), len(r.a.tail), len(r.b.head), len(r.b.tail)] == [2, 4, 3, 2] and r.c is None and r.d is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=6), st.floats(0.05, 0.95))
def test_cut_keeps_the_length(spark, points, at):
    n = sum(math.dist(a, b) for a, b in zip(points, points[1:]))
    r = one(spark, c=geom.cut(pts(*points), F.lit(n * at)))
    if n:
        total = lambda ps: sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(ps, ps[1:]))
        assert total(r.c.head) == pytest.approx(n * at) and total(r.c.tail) == pytest.approx(n * (1 - at))
        assert r.c.head[-1] == r.c.tail[0]


def test_bearings(spark):
    p = lambda x, y: geom.point(F.lit(x), F.lit(y))
    r = one(spark, **{k: geom.compass_bearing(p(0, 0), p(*v)) for k, v in {"n": (0, 1), "e": (1, 0), "s": (0, -1), "w": (-1, 0), "none": (0, 0)}.items()})
    assert tuple(r) == (0, 90, 180, 270, 90)
    d = one(spark, **{f"d{i}": geom.compass_bearing_delta(F.lit(a), F.lit(b)) for i, (a, b) in enumerate([(350, 10), (10, 350), (-90, 90), (0, 340)])})
    assert tuple(d) == (20, 20, 180, 20)


def test_divergence(spark):
    a, b = [(0, 10), (100, 15), (200, 10)], [(0, -10), (100, -15), (200, -10)]
    cases = {"ab": (a, b, 3.0), "aa": (a, a, 3.0), "ca": ([(0, 0), (200, 0)], a, 3.0), "cd": ([(0, 0), (200, 0)], [(0, 0), (400, 0)], 3.0), "de": ([(0, 0), (400, 0)], [(0, 0), (20, 20), (40, 0), (400, 0)], 10.0), "zero": ([(0, 0), (0, 0)], [(10, 0), (10, 0)], 3.0)}
    r = one(spark, **{k: geom.divergence(pts(*x), pts(*y), d) for k, (x, y, d) in cases.items()}, none=geom.divergence(pts(*a), F.lit(None).cast(geom.LINE)))
    assert 29 < r.ab.separation <= 30 and r.aa.separation == 0 and 14 < r.ca.separation <= 15 and tuple(r.cd) == (200, 0)
    assert 5.7 < r.de.bearing_delta < 5.8 and tuple(r.zero) == (10, 0) and r.none is None


def plain_divergence(a, b, delta):
    """One pair of lines, one sample after the other."""

    def along(line, d):
        for (x0, y0), (x1, y1) in zip(line, line[1:]):
            leg = math.hypot(x1 - x0, y1 - y0)
            if d <= leg and leg > 0:
                return x0 + (x1 - x0) * d / leg, y0 + (y1 - y0) * d / leg
            d -= leg
        return line[-1]

    length = lambda line: sum(math.dist(p, q) for p, q in zip(line, line[1:]))
    n = max(length(a), length(b))
    at = [k * delta for k in range(math.ceil(n / delta))] + [n] if n else [0.0]
    both = [[along(line, min(d * (length(line) / n if n else 1), length(line))) for d in at] for line in (a, b)]
    apart = max(math.dist(p, q) for p, q in zip(*both))
    bearings = [[math.degrees(math.atan2(q[1] - p[1], q[0] - p[0])) for p, q in zip(s, s[1:])] for s in both]
    turns = [min(t, 360 - t) for t in (abs(u - v) % 360 for u, v in zip(*bearings))]
    return apart, sum(turns) / len(turns) if turns else 0.0


@pytest.mark.parametrize("samples", [50, 1_000_000])
def test_divergence_of_many_lines(spark, monkeypatch, samples):
    """Lines of a batch are sampled together and in portions; nulls, empty lines and single points among them."""
    monkeypatch.setattr(geom, "SAMPLES", samples)
    rng = random.Random(3)
    line = lambda: [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.randint(2, 6))]
    rows = [(i, line(), line()) for i in range(60)] + [(60, None, line()), (61, [], line()), (62, line(), None), (63, [(1.0, 2.0)], [(4.0, 6.0)])]
    df = spark.createDataFrame(rows, "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.id: r.v for r in df.select("id", geom.divergence(F.col("a"), F.col("b"), 3.0).alias("v")).collect()}
    assert got[60] is None and got[61] is None and got[62] is None and tuple(got[63]) == (5.0, 0.0)
    for i, a, b in rows[:60]:
        assert tuple(got[i]) == pytest.approx(plain_divergence(a, b, 3.0), abs=1e-6)


def test_rectangles_and_wkt(spark):
    p = lambda x, y: geom.point(F.lit(x), F.lit(y))
    box = (0.0, 0.0, 10.0, 10.0)
    assert tuple(one(spark, a=geom.in_rect(p(1, 2), box), b=geom.in_rect(p(100, 2), box), c=geom.in_rect(p(0, 0), box), d=geom.in_rect(p(10, 5), box))) == (True, False, True, False)
    assert geom.buffer_box(box, 5) == (-5, -5, 15, 15)
    r = one(spark, a=geom.wkt_to_line(F.lit("LINESTRING(1.1,10.0 2.2, 20.0)")), b=geom.wkt_to_line(F.lit("LINESTRING (1.1 10, 2.2  20.0)")), c=geom.wkt_to_line(F.lit("POINT (1 2)")), d=geom.wkt_linestring(pts((1, 2))), e=geom.wkt_point(p(1, 2)))
    assert [(q.x, q.y) for q in r.b] == [(1.1, 10), (2.2, 20)] and r.c is None and r.d is None and r.e == "POINT (1.000000 2.000000)"


def test_units(spark):
    seg = math.hypot(1000, 1000)
    r = one(spark, feet=geom.in_units(F.lit(seg), "feet", "feet"), m=geom.in_units(F.lit(seg), "feet", "meters"), f2=geom.in_units(F.lit(seg), "meters", "feet"), mi=geom.in_units(F.lit(seg), "meters", "miles"))
    assert [round(r.feet), round(r.m), round(r.f2), round(r.mi, 2)] == [1414, 431, 4640, 0.88]
    with pytest.raises(ValueError):
        maps.scales("miles")


@pytest.mark.parametrize(
    ("text", "lonlat", "planar"),
    [
        ("+proj=utm +zone=10 +datum=WGS84 +units=m", (-123.0, 0.0), (500000.0, 0.0)),
        ("+proj=utm +zone=33 +south +datum=WGS84", (15.0, -0.0), (500000.0, 10000000.0)),
        ("+proj=utm +zone=10 +datum=WGS84 +units=m", (-122.0, 38.0), (587798.418, 4206286.759)),
    ],
)
def test_projections(spark, text, lonlat, planar):
    proj = parse_proj4(text)
    assert proj.numbers(*lonlat) == pytest.approx(planar, abs=0.01)
    there = spark.createDataFrame([lonlat], "x double, y double").withColumn("p", proj.point(F.struct("x", "y")))
    r = there.withColumn("q", proj.point(F.col("p"), reverse=True)).first()
    assert (r.p.x, r.p.y) == pytest.approx(planar, abs=0.01) and (r.q.x, r.q.y) == pytest.approx(lonlat, abs=1e-9)


def test_lambert_example():
    """Worked example of the Texas South Central zone (NAD27), in US survey feet, from the public guidance note on projections."""
    from dataclasses import replace

    feet = 1200 / 3937
    proj = replace(parse_proj4("+proj=lcc +lat_0=27.83333333333333 +lon_0=-99 +lat_1=28.38333333333333 +lat_2=30.28333333333333"), a=6378206.4, inverse_flattening=294.97869821, x0=2000000 * feet, to_metre=feet)
    assert proj.numbers(-96, 28.5) == pytest.approx((2963503.91, 254759.80), abs=0.02)
    assert proj.numbers(2963503.91, 254759.80, reverse=True) == pytest.approx((-96, 28.5), abs=1e-6)
    with pytest.raises(ValueError):
        parse_proj4("+proj=robin")


def test_maps_and_namespaces(spark):
    m = lambda **k: F.create_map(*[F.lit(v) for p in k.items() for v in p])
    none = F.lit(None).cast("map<string,string>")
    r = one(spark, a=maps.merge(m(a="1", b="2"), m(b="3")), b=maps.merge(none, m(b="3")), c=maps.add_prefix(m(a="1"), "x$"), d=maps.drop_prefix(m(xa="1", b="2"), "x"), e=maps.get(m(a="1"), "z", "d"), f=maps.only_keys(m(a="1", b="2"), ["b"]))
    assert tuple(r) == ({"a": "1", "b": "3"}, {"b": "3"}, {"x$a": "1"}, {"b": "2"}, "d", {"b": "2"})
    k = one(spark, **{c: maps.split_key(F.lit(v)) for c, v in {"a": "foo$bar", "b": "bar", "c": "foo$bar$zar"}.items()})
    assert [tuple(v) for v in k] == [("foo$", "bar"), ("", "bar"), ("foo$", "bar$zar")]
    p = one(spark, a=maps.percent(F.lit(5), F.lit(10)), b=maps.percent(F.lit(5), F.lit(0)))
    assert tuple(p) == (50, 0)


def test_scores(spark):
    r = one(spark, **{f"s{i}": scoring.to_score(F.lit(float(v))) for i, v in enumerate((0, 1, 0.25, 0.007, 1.2))})
    assert tuple(r) == (0, 100, 25, 1, None)
    none = F.lit(None).cast("int")
    f = one(spark, a=scoring.to_factor(F.lit(75), 1.0), b=scoring.to_factor(none, 1.0), c=scoring.to_factor(F.lit(0), 0.1), d=scoring.to_factor(F.lit(100), 0.1), e=scoring.to_factor(F.lit(80), 0.1), g=scoring.to_factor(none, 0.8))
    assert tuple(f) == pytest.approx((0.75, 0.5, 0.9, 1.0, 0.98, 0.6))
    b = one(spark, a=scoring.bearing2(F.lit(0), F.lit(180), F.lit(10), F.lit(190), F.lit(0)), b=scoring.bearing2(F.lit(0), F.lit(180), F.lit(190), F.lit(10), F.lit(1)), c=scoring.geo2(F.lit(0.1), F.lit(0.2), F.lit(9.0), 1.0))
    assert b.a == b.b == 89 and b.c == 0


def test_report_predicates(spark):
    none = F.lit(None).cast("int")
    r = one(spark, a=reports.name_mismatch(F.lit(50), F.lit(99)), b=reports.name_mismatch(none, F.lit(0)), c=reports.name_mismatch(F.lit(90), none), d=reports.fixed_name(F.lit(90), F.lit(1), F.lit("")), e=reports.fixed_name(F.lit(90), F.lit(1), F.lit("x")), u=reports.way_url(F.lit(7)))
    assert tuple(r) == (True, False, False, False, True, "http://www.openstreetmap.org/way/7")


def test_distances_are_symmetric(spark):
    rng = random.Random(3)
    a = [(rng.random() * 360, rng.random() * 360) for _ in range(50)]
    df = spark.createDataFrame(a, "a double, b double").select(geom.compass_bearing_delta(F.col("a"), F.col("b")).alias("x"), geom.compass_bearing_delta(F.col("b"), F.col("a")).alias("y"))
    assert all(r.x == r.y and 0 <= r.x <= 180 for r in df.collect())


def test_word_substitutions_of_the_reference(spark):
    """Every entry of the reference's table, kept apart from the package's dictionary, alone and inside a name."""
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "word_substitutions.txt")
    with open(path, encoding="utf-8") as f:
        want = dict(line.split() for line in f)
    df = spark.createDataFrame(list(want), "string").select("value", names.canonical(F.col("value")).alias("alone"), names.canonical(F.concat(F.lit("Old "), F.lower("value"), F.lit(" 7"))).alias("within"))
    assert len(want) == 372
    assert {r.value: (r.alone, r.within) for r in df.collect()} == {k: (v, f"OLD {v} 7") for k, v in want.items()}
