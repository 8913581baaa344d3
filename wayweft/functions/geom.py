"""Planar geometry on ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>> as Column expressions.

Everything but divergence is built from native higher-order functions that pass over a line once, so nothing leaves
the JVM; divergence, whose samples may be far more than the vertices, is one vectorised Arrow function.
A null line gives null everywhere; an empty line or one of a single point has length 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayweft.functions.arrays import cuts, spread
from wayweft.functions.binding import let

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"

#: Conversion factors of the two supported units and of miles.
FEET_PER_METRE, MILES_PER_METRE = 3.28084, 0.000621371
UNITS = {"meters": 1.0, "feet": FEET_PER_METRE}
#: Metres within which places count as equal, as the same street, and as the same block.
STEP_M, STREET_M, BLOCK_M = 0.3, 8.0, 100.0
#: Samples that divergence holds at once.
SAMPLES = 1_000_000


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line_of(coordinates: Column) -> Column:
    """Nested number arrays as a line; further dimensions are dropped."""
    return F.transform(coordinates, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))


def distance(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def _rest(pts: Column) -> Column:
    return F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0)))


def first(pts: Column) -> Column:
    return F.get(pts, F.lit(0))


def last(pts: Column) -> Column:
    return F.get(pts, F.size(pts) - 1)


def length(pts: Column) -> Column:
    legs = F.zip_with(F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0))), _rest(pts), distance)
    return F.when(pts.isNotNull(), F.aggregate(legs, F.lit(0.0), lambda a, b: a + b))


def interpolate(pts: Column, d: Column) -> Column:
    """The point at distance d along the line, d clamped to the line."""
    start = F.struct(first(pts).alias("p"), F.lit(0.0).alias("run"), F.lit(None).cast(POINT).alias("hit"), F.greatest(d.cast("double"), F.lit(0.0)).alias("d"))

    def walk(s: Column, q: Column) -> Column:
        def step(leg: Column) -> Column:
            t = F.when(leg > 0, (s["d"] - s["run"]) / leg).otherwise(0.0)
            p = F.struct((s["p"]["x"] + t * (q["x"] - s["p"]["x"])).alias("x"), (s["p"]["y"] + t * (q["y"] - s["p"]["y"])).alias("y"))
            return F.struct(q.alias("p"), (s["run"] + leg).alias("run"), F.when(s["hit"].isNull() & (s["run"] + leg >= s["d"]), p).otherwise(s["hit"]).alias("hit"), s["d"].alias("d"))

        return let(distance(s["p"], q), step)

    return F.aggregate(_rest(pts), start, walk, lambda s: F.coalesce(s["hit"], s["p"]))


def project(pts: Column, p: Column) -> Column:
    """Distance along the line to its place nearest to p; of several the first."""
    start = F.struct(first(pts).alias("p"), F.lit(0.0).alias("run"), distance(first(pts), p).alias("best"), F.lit(0.0).alias("along"), p["x"].alias("u"), p["y"].alias("v"))

    def walk(s: Column, q: Column) -> Column:
        dx, dy = q["x"] - s["p"]["x"], q["y"] - s["p"]["y"]

        def step(leg: Column) -> Column:
            t = F.when(leg > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((s["u"] - s["p"]["x"]) * dx + (s["v"] - s["p"]["y"]) * dy) / (leg * leg)))).otherwise(0.0)

            def place(t: Column) -> Column:
                ox, oy = s["u"] - s["p"]["x"] - t * dx, s["v"] - s["p"]["y"] - t * dy
                return F.struct(F.sqrt(ox * ox + oy * oy).alias("off"), (s["run"] + t * leg).alias("along"))

            def keep(m: Column) -> Column:
                nearer = m["off"] < s["best"]
                return F.struct(q.alias("p"), (s["run"] + leg).alias("run"), F.when(nearer, m["off"]).otherwise(s["best"]).alias("best"), F.when(nearer, m["along"]).otherwise(s["along"]).alias("along"), s["u"].alias("u"), s["v"].alias("v"))

            return let(let(t, place), keep)

        return let(distance(s["p"], q), step)

    return F.aggregate(_rest(pts), start, walk, lambda s: s["along"])


def cut(pts: Column, d: Column) -> Column:
    """struct(head, tail) of the line cut at distance d; null unless 0 < d < length.

    A vertex at exactly d is used for both parts; otherwise a new point ends the one and starts the other.
    """
    start = F.struct(first(pts).alias("p"), F.lit(0.0).alias("run"), F.lit(1).alias("k"), F.lit(0.0).alias("at"), d.cast("double").alias("d"))

    def walk(s: Column, q: Column) -> Column:
        def step(run: Column) -> Column:
            return F.struct(q.alias("p"), run.alias("run"), (s["k"] + F.when(run <= s["d"], 1).otherwise(0)).alias("k"), F.when(run <= s["d"], run).otherwise(s["at"]).alias("at"), s["d"].alias("d"))

        return let(s["run"] + distance(s["p"], q), step)

    def parts(k: Column) -> Column:
        head, tail = F.slice(pts, F.lit(1), k["k"]), F.slice(pts, k["k"] + 1, F.greatest(F.size(pts) - k["k"], F.lit(0)))

        def joined(new: Column) -> Column:
            return F.struct(F.when(k["at"] == k["d"], head).otherwise(F.array_append(head, new)).alias("head"), F.array_prepend(tail, new).alias("tail"))

        new = F.when(k["at"] == k["d"], F.element_at(pts, k["k"])).otherwise(interpolate(pts, k["d"]))
        return F.when((k["d"] > 0) & (k["d"] < k["run"]), let(new, joined))

    return let(F.aggregate(_rest(pts), start, walk), parts)


def compass_bearing(p: Column, q: Column) -> Column:
    """Degrees clockwise from north, 0 to 360; 90 for equal points."""
    b = 90 - F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))
    return F.when(b < 0, b + 360).otherwise(b)


def compass_bearing_delta(a: Column, b: Column) -> Column:
    """Angle between two bearings, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def from_bearing(pts: Column) -> Column:
    """Bearing on leaving the first point."""
    return compass_bearing(first(pts), F.get(pts, F.lit(1)))


def to_bearing(pts: Column) -> Column:
    """Bearing on leaving the last point backwards."""
    return compass_bearing(last(pts), F.get(pts, F.size(pts) - 2))


def in_rect(p: Column, rect: tuple[float, float, float, float]) -> Column:
    """Half-open: the lower edges belong to the rectangle, the upper ones don't."""
    x0, y0, x1, y1 = rect
    return (p["x"] >= x0) & (p["x"] < x1) & (p["y"] >= y0) & (p["y"] < y1)


def any_in_rect(pts: Column, rect: tuple[float, float, float, float]) -> Column:
    """Whether a vertex is inside; a line that crosses without a vertex inside is not."""
    return F.exists(pts, lambda p: in_rect(p, rect))


def buffer_box(box: tuple[float, float, float, float], by: float) -> tuple[float, float, float, float]:
    return box[0] - by, box[1] - by, box[2] + by, box[3] + by


def wkt_point(p: Column) -> Column:
    return F.format_string("POINT (%.6f %.6f)", p["x"], p["y"])


def wkt_linestring(pts: Column) -> Column:
    """Null for fewer than two points."""
    text = F.array_join(F.transform(pts, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", ")
    return F.when(F.size(pts) >= 2, F.concat(F.lit("LINESTRING ("), text, F.lit(")")))


def wkt_to_line(text: Column) -> Column:
    """Points of a LINESTRING text in any spacing; null for other texts."""
    body = F.regexp_extract(text, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    numbers = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda c: F.split(F.trim(c), r"\s+"))
    return F.when(body != "", F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).try_cast("double").alias("x"), F.get(n, F.lit(1)).try_cast("double").alias("y"))))


def in_units(value: Column, units: str, of: str) -> Column:
    """A length in `units` ('meters' or 'feet') as 'meters', 'feet' or 'miles'."""
    metres = value / UNITS[units]
    return metres if of == "meters" else metres * FEET_PER_METRE if of == "feet" else metres * MILES_PER_METRE


class _Lines:
    """All lines of an array, sampled at once: one run of metres on which the lines follow each other with a gap."""

    def __init__(self, v: pa.Array, rows: np.ndarray):
        flat, offsets = v.values, np.asarray(v.offsets)
        line, k = spread((offsets[1:] - offsets[:-1])[rows])
        at = offsets[rows][line] + k
        self.x, self.y = (flat.field(c).to_numpy(zero_copy_only=False)[at] for c in "xy")
        step = np.r_[0.0, np.hypot(np.diff(self.x), np.diff(self.y))]
        step[k == 0] = 0.0
        upto = np.cumsum(step)
        starts = np.flatnonzero(k == 0)
        local = upto - upto[starts][line]
        self.total = local[np.r_[starts[1:], len(line)] - 1]
        self.base = np.cumsum(self.total + 1) - self.total - 1
        self.run = local + self.base[line]

    def at(self, line: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at distance d along the given lines."""
        g = self.base[line] + np.minimum(d, self.total[line])
        return np.interp(g, self.run, self.x), np.interp(g, self.run, self.y)


def _diverge(one: pa.Array, two: pa.Array, rows: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Separation and mean difference of bearings of the lines in the given rows."""
    a, b = _Lines(one, rows), _Lines(two, rows)
    longer = np.maximum(a.total, b.total)
    count = np.where(longer > 0, np.ceil(longer / delta), 0).astype(np.int64) + 1
    apart, turned = np.zeros(len(rows)), np.zeros(len(rows))
    for part in cuts(count, SAMPLES):
        own, k = spread(count[part])
        line = own + part.start
        d = np.where(k == count[line] - 1, longer[line], k * delta)
        scale = np.maximum(longer[line], 1e-300)
        (px, py), (qx, qy) = a.at(line, d * (a.total[line] / scale)), b.at(line, d * (b.total[line] / scale))
        apart[part] = np.maximum.reduceat(np.hypot(px - qx, py - qy), np.flatnonzero(k == 0))
        inner = np.flatnonzero(k[1:] > 0)
        bearing = [np.degrees(np.arctan2(np.diff(v)[inner], np.diff(u)[inner])) for u, v in ((px, py), (qx, qy))]
        turn = np.abs(bearing[0] - bearing[1]) % 360
        turned[part] = np.bincount(own[1:][inner], np.minimum(turn, 360 - turn), part.stop - part.start) / np.maximum(count[part] - 1, 1)
    return apart, turned


def divergence(a: Column, b: Column, delta: float = 3.0) -> Column:
    """struct(separation, bearing_delta): how far two lines run apart, at most and in direction on average.

    The longer line is sampled every delta and at its end, the other at the same fraction of its length. Null when a
    line is null or empty.
    """
    from pyspark.sql.functions import arrow_udf

    out = T.StructType([T.StructField("separation", T.DoubleType()), T.StructField("bearing_delta", T.DoubleType())])

    @arrow_udf(returnType=out)
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        size = lambda v: np.diff(np.asarray(v.offsets))
        ok = np.asarray(one.is_valid()) & np.asarray(two.is_valid()) & (size(one) > 0) & (size(two) > 0)
        rows = np.flatnonzero(ok)
        values = np.zeros((2, len(one)))
        if len(rows):
            values[:, rows] = _diverge(one, two, rows, delta)
        return pa.StructArray.from_arrays([pa.array(v) for v in values], names=["separation", "bearing_delta"], mask=pa.array(~ok))

    return run(a, b)
