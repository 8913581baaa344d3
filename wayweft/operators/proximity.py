"""Points near other points, and points inside regions.

Pivots drawn from the points split the sphere into Voronoi cells on two levels (top pivots, and pivots below each of
them). A point belongs to the cell of its nearest pivots. Whatever may meet a point of another cell is replicated there:
if q lies in the cell of pivot t and d(p, q) <= r, the triangle inequality gives
d(p, t) <= d(p, q) + d(q, t) <= r + d(q, s) <= 2 r + d(p, s) for the nearest pivot s of p,
and the same holds for the second level. So replication to every cell with d(p, t) <= min + 2 r loses no pair, and
since a pair is reported only in the home cell of one of its points, none comes out twice.
Inside a cell a vantage-point tree over the exact great-circle metric answers all range queries at once, level by level.
Cells that are too full are cut into blocks, and a task gets two blocks of a cell, never all of it. Points at one place
are one place of the tree. A region goes to a cell as the few edges that decide there, not with all its rings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.arrays import cuts, spread
from wayweft.runtime import materialise, ship

#: Radius of the sphere in metres.
EARTH_M = 6_371_008.8
#: Points that one cell should hold, and the most pivots there may be (they travel with the tasks: 24 bytes each). With
#: more points than both allow cells get fuller and are cut into more blocks; both can be given by the caller.
CELL_POINTS = 4_000
MAX_PIVOTS = 131_072
#: Points drawn to estimate how full each cell is, as a multiple of the pivots.
SAMPLE_FACTOR = 8
#: Metres by which pruning is laxer than the bounds, far above the rounding errors of the metric.
SLACK_M = 0.5
_LEAF = 12
#: A cell is cut into blocks of this many times CELL_POINTS; rows that a task hands on at once.
BLOCK_CELLS, FLUSH = 4, 500_000


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    c = np.cos(b)
    return np.stack([c * np.cos(a), c * np.sin(a), np.sin(b)], axis=1)


def arc_m(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Great-circle distance in metres between rows of unit vectors, exact for near points."""
    d = u - v
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("ij,ij->i", d, d)) / 2))


class VantagePointTree:
    """A vantage-point tree over unit vectors, built and searched level by level with whole arrays."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        order = np.arange(n)
        self.levels: list[tuple[np.ndarray, ...]] = []
        lo, hi = np.array([0]), np.array([n])
        while len(lo):
            size = hi - lo
            split = size > _LEAF
            slo, shi = lo[split], hi[split]
            vantage = order[shi - 1]
            if len(slo):  # all points of the split segments, sorted by distance to their vantage point
                count = shi - 1 - slo
                seg = np.repeat(np.arange(len(slo)), count)
                at = np.arange(count.sum()) + np.repeat(slo - np.r_[0, np.cumsum(count)[:-1]], count)
                dist = arc_m(points[order[at]], points[vantage[seg]])
                rank = np.lexsort((dist, seg))
                order[at] = order[at][rank]
                dist = dist[rank]
                start = np.r_[0, np.cumsum(count)[:-1]]
                half = count // 2
                mid = slo + half
                inner_max, outer_min, outer_max = dist[start + half - 1], dist[start + half], dist[start + count - 1]
            else:
                mid, inner_max, outer_min, outer_max = slo, np.zeros(0), np.zeros(0), np.zeros(0)
            child = np.full(len(lo), -1)
            child[split] = np.arange(len(slo)) * 2
            number = np.full(len(lo), -1)
            number[split] = np.arange(len(slo))
            self.levels.append((lo, hi, child, number, vantage, inner_max, outer_min, outer_max))
            if not len(slo):
                break
            lo, hi = np.stack([slo, mid], 1).ravel(), np.stack([mid, shi - 1], 1).ravel()
        self.order = order

    def within(self, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query number, point number) arrays of all pairs at most radius[query] metres apart."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        if not len(self.points):
            return
        for lo, hi, child, number, vantage, inner_max, outer_min, outer_max in self.levels:
            leaf = child[node] < 0
            if leaf.any():
                lq, ln = q[leaf], node[leaf]
                count = hi[ln] - lo[ln]
                for cut in range(0, len(lq), 200_000):  # bounds the memory of the expansion
                    part = slice(cut, cut + 200_000)
                    n = count[part]
                    qq = np.repeat(lq[part], n)
                    at = np.arange(n.sum()) + np.repeat(lo[ln[part]] - np.r_[0, np.cumsum(n)[:-1]], n)
                    p = self.order[at]
                    near = arc_m(queries[qq], self.points[p]) <= radius[qq]
                    yield qq[near], p[near]
            q, node = q[~leaf], node[~leaf]
            if not len(q):
                return
            k = number[node]
            d = arc_m(queries[q], self.points[vantage[k]])
            near = d <= radius[q]
            yield q[near], vantage[k][near]
            slack = radius[q] + SLACK_M
            inner, outer = d <= inner_max[k] + slack, (d >= outer_min[k] - slack) & (d <= outer_max[k] + slack)
            c = child[node]
            q, node = np.r_[q[inner], q[outer]], np.r_[c[inner], c[outer] + 1]


class Pivots:
    """Two levels of pivots; cell (i, j) holds the points nearest to top pivot i and, below it, to pivot j."""

    def __init__(self, sample: np.ndarray, pivots: int):
        distinct = np.unique(sample[:pivots].round(12), axis=0)
        tops = max(1, round(np.sqrt(len(distinct))))
        rng = np.random.default_rng(7)
        distinct = distinct[rng.permutation(len(distinct))] if len(distinct) else np.array([[1.0, 0.0, 0.0]])
        self.top = distinct[:tops]
        home = np.argmax(distinct @ self.top.T, axis=1)
        self.below = [distinct[home == i] if (home == i).any() else self.top[i : i + 1] for i in range(len(self.top))]
        self.first = np.r_[0, np.cumsum([len(b) for b in self.below])]
        self.cells = int(self.first[-1])

    def homes(self, x: np.ndarray) -> np.ndarray:
        return next(self._walk(x, None))[1]

    def replicas(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) of every cell in which something within reach/2 of the row may live, its home included."""
        return self._walk(x, reach)

    @staticmethod
    def _limit(cos: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The least cosine that a pivot may have to lie at most `reach` metres farther than the nearest."""
        angle = np.arccos(np.clip(cos.max(axis=1), -1, 1)) + (reach + SLACK_M) / EARTH_M
        return np.cos(np.minimum(angle, np.pi)) - 1e-15

    def _walk(self, x, reach):
        cos = x @ self.top.T
        if reach is None:
            top = np.argmax(cos, axis=1)
            cell = np.empty(len(x), np.int64)
            for i in np.unique(top):
                rows = np.flatnonzero(top == i)
                cell[rows] = self.first[i] + np.argmax(x[rows] @ self.below[i].T, axis=1)
            yield np.arange(len(x)), cell
            return
        row, top = np.nonzero(cos >= self._limit(cos, reach)[:, None])
        by_top = np.argsort(top, kind="stable")
        bounds = np.searchsorted(top[by_top], np.arange(len(self.top) + 1))
        for i in range(len(self.top)):
            rows = row[by_top[bounds[i] : bounds[i + 1]]]
            if len(rows):
                sub = x[rows] @ self.below[i].T
                r, j = np.nonzero(sub >= self._limit(sub, reach[rows])[:, None])
                yield rows[r], self.first[i] + j


def _pivots(points: DataFrame, cell_points: int | None, max_pivots: int | None) -> tuple[Pivots, np.ndarray, int]:
    """Pivots drawn from (id, lon, lat) by a hash of the row, the blocks of each cell, and the number of points."""
    ship(points.sparkSession)
    size = cell_points or CELL_POINTS
    n = points.count()
    wanted = int(min(max_pivots or MAX_PIVOTS, max(1, n // size)))
    draw = wanted * SAMPLE_FACTOR
    h = F.pmod(F.xxhash64(F.lit(11), "id", "lon", "lat"), F.lit(1 << 40))
    drawn = points.where(h <= int(min(1.0, 1.5 * draw / max(n, 1)) * (1 << 40))).select(h.alias("h"), "lon", "lat").orderBy("h").limit(draw)
    rows = drawn.toArrow()  # at most max_pivots * SAMPLE_FACTOR rows of 24 bytes
    sample = unit_vectors(rows["lon"].to_numpy(), rows["lat"].to_numpy())
    pivots = Pivots(sample, wanted)
    full = np.bincount(pivots.homes(sample), minlength=pivots.cells) * (n / max(len(sample), 1)) if len(sample) else np.zeros(pivots.cells)
    return pivots, np.maximum(1, np.ceil(full / (BLOCK_CELLS * size))).astype(np.int64), n


def _tasks(df: DataFrame, n: int, cell_points: int | None) -> int:
    """Partitions for a join whose work is in Python, not in the bytes it reads."""
    return int(max(df.sparkSession.sparkContext.defaultParallelism * 2, n // (20 * (cell_points or CELL_POINTS))))


def _block(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of a cell in which an id is, evenly whatever the ids are."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) % blocks.astype(np.uint64)).astype(np.int64)


def _gathered(portions: Iterator[tuple[np.ndarray, np.ndarray]], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays joined to portions of about `most` (FLUSH), so that small ones cost no batch each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in portions:
        held.append((a, b))
        size += len(a)
        if size >= (most or FLUSH):
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, size = [], 0
    if size:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


class _Places:
    """Ids grouped by distinct place."""

    def __init__(self, ids: np.ndarray, lon: np.ndarray, lat: np.ndarray):
        places, of = np.unique(lon + 1j * lat, return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.ids, self.count = ids[order], np.bincount(of, minlength=len(places))
        self.first = np.cumsum(self.count) - self.count
        self.units = unit_vectors(places.real, places.imag)

    def members(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, id) of every id at place[i]."""
        row, at = spread(self.count[place])
        return row, self.ids[self.first[place[row]] + at]


def _close(asking: _Places, tree: VantagePointTree, there: _Places, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Id pairs a < b, a from asking and b from there, in portions of bounded size."""
    for q, p in tree.within(asking.units, np.full(len(asking.units), float(radius_m))):
        for part in cuts(asking.count[q], FLUSH):
            i, a = asking.members(q[part])
            place = p[part][i]
            for some in cuts(there.count[place], FLUSH):
                j, b = there.members(place[some])
                first = a[some][j]
                keep = first < b
                if keep.any():
                    yield first[keep], b[keep]


def _place(lon: Column, lat: Column) -> Column:
    """Both coordinates are there and are numbers (x - x is not a number for NaN and the infinities)."""
    ok = lambda c: c.isNotNull() & (c.cast("double") - c.cast("double") == 0) & ~F.isnan(c.cast("double"))
    return ok(lon) & ok(lat)


_NEAR_CELL = pa.schema([("cell", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("second", pa.bool_()), ("home", pa.bool_()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64())])
_PAIRS = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64())])


def near_pairs(points: DataFrame, radius_m: float, cell_points: int | None = None, max_pivots: int | None = None) -> DataFrame:
    """a_id < b_id of all pairs of points (id, lon, lat) at most radius_m metres apart by great circle.

    Points with equal places are pairs like others. Rows with a null id or a coordinate that is null or no finite
    number have no place; of an id in several places a pair comes out once for each pair of places; an empty table
    gives an empty result. Only the three columns are read.
    """
    rows = materialise(points.where(_place(F.col("lon"), F.col("lat")) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), "points")
    pivots, blocks, n = _pivots(rows, cell_points, max_pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lon, lat = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = unit_vectors(lon, lat)
            home = pivots.homes(x)
            for row, cell in pivots.replicas(x, np.full(len(x), 2 * radius_m)):
                for part in cuts(blocks[cell], FLUSH):
                    again, other = spread(blocks[cell[part]])  # a block meets every block of its cell
                    r, c = row[part][again], cell[part][again]
                    own = _block(ids[r], blocks[c])
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (c, np.minimum(own, other), np.maximum(own, other), own > other, home[r] == c, ids[r], lon[r], lat[r])], schema=_NEAR_CELL)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, lon, lat, home, second = (t[c].to_numpy() for c in ("id", "lon", "lat", "home", "second"))
        pick = lambda rows: _Places(ids[rows], lon[rows], lat[rows])
        for asking, there in (((~second, ~second),) if t["i"][0] == t["j"][0] else ((~second, second), (second, ~second))):
            if (home & asking).any() and there.any():
                held = pick(there)
                for a, b in _gathered(_close(pick(home & asking), VantagePointTree(held.units), held, radius_m)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_PAIRS)

    cells = rows.mapInArrow(assign, "cell bigint, i bigint, j bigint, second boolean, home boolean, id bigint, lon double, lat double")
    return cells.repartition(_tasks(rows, n, cell_points), "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(join, "a_id bigint, b_id bigint")


def _edges(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of rings given as x, y, ... with NaN, NaN after each ring; unclosed rings are closed."""
    xy = flat.reshape(-1, 2)
    parts = np.split(xy, np.flatnonzero(np.isnan(xy[:, 0])))
    rings = [r[~np.isnan(r[:, 0])] for r in parts]
    a = np.concatenate([r for r in rings if len(r)] or [np.zeros((0, 2))])
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings if len(r)] or [np.zeros((0, 2))])
    return a[:, 0], a[:, 1], b[:, 0], b[:, 1]


def inside(x: np.ndarray, y: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Even-odd rule over all edges, straight in the plane of x and y."""
    x0, y0, x1, y1 = edges
    flat = y0 != y1
    x0, y0, x1, y1 = x0[flat], y0[flat], x1[flat], y1[flat]
    odd = np.zeros(len(x), bool)
    step = max(1, 2_000_000 // max(1, len(x)))
    for s in range(0, len(x0), step):
        e = slice(s, s + step)
        spans = (y0[e] > y[:, None]) != (y1[e] > y[:, None])
        left = x[:, None] < (x1[e] - x0[e]) * (y[:, None] - y0[e]) / (y1[e] - y0[e]) + x0[e]
        odd ^= (np.count_nonzero(spans & left, axis=1) % 2).astype(bool)
    return odd


def clip_edges(edges: tuple[np.ndarray, ...], box: tuple[float, float, float, float]) -> tuple[np.ndarray, ...]:
    """Edges that decide the even-odd rule for all points of a box (x0, y0, x1, y1) as the given ones do.

    A ray to the right crosses no edge left of the box and none above or below it. Of the edges right of the box only
    the parity at each height counts: the heights at which it changes are the ends that do not pair up, and upright
    edges between them stand for all. edges are ordered by _by_height().
    """
    x0, y0, x1, y1, upto = edges
    left, bottom, right, top = box
    near = slice(np.searchsorted(upto, bottom, "right"), np.searchsorted(np.minimum(y0, y1), top, "right"))
    x0, y0, x1, y1 = x0[near], y0[near], x1[near], y1[near]
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    on = (high > bottom) & (low <= top) & (np.maximum(x0, x1) >= left)
    beyond = on & (np.minimum(x0, x1) > right)
    here = on & ~beyond
    beyond_top = np.nextafter(top, np.inf)
    ends, n = np.unique(np.r_[np.maximum(low[beyond], bottom), np.minimum(high[beyond], beyond_top)], return_counts=True)
    ends = ends[n % 2 == 1]  # an even number: every edge has two
    far = np.full(len(ends) // 2, np.nextafter(right, np.inf) + 1.0)
    return np.r_[x0[here], far], np.r_[y0[here], ends[0::2]], np.r_[x1[here], far], np.r_[y1[here], ends[1::2]]


def _by_height(edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Edges that are not level by their lower end, and up to which height those so far reach."""
    x0, y0, x1, y1 = edges
    order = np.argsort(np.minimum(y0, y1), kind="stable")
    order = order[y0[order] != y1[order]]
    return x0[order], y0[order], x1[order], y1[order], np.maximum.accumulate(np.maximum(y0, y1)[order]) if len(order) else np.zeros(0)


_CELL_ROW = pa.schema([("cell", pa.int64()), ("salt", pa.int64()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("reach", pa.float64()), ("edges", pa.list_(pa.float64()))])
_CELL_DDL = "cell bigint, salt bigint, id bigint, lon double, lat double, reach double, edges array<double>"
_INSIDE = pa.schema([("region_id", pa.int64()), ("id", pa.int64())])


def points_in_regions(points: DataFrame, regions: DataFrame, cell_points: int | None = None, max_pivots: int | None = None) -> DataFrame:
    """region_id, id of points (id, lon, lat) inside regions (region_id, rings array<array<struct<x,y>>>).

    Even-odd rule over all rings, whose edges are straight in the lon/lat plane; either winding; unclosed rings are
    closed. A region goes to every cell that its bounding circle may reach, by the triangle inequality, cut down to the
    edges that decide for the box around that cell's points; the tree gives the points in the circle, the rule decides.
    A point on an edge may fall on either side. Rows with a null id or
    without place, null vertices and regions without rings give nothing; repeated rows count once.
    """
    rows = materialise(points.where(_place(F.col("lon"), F.col("lat")) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct(), "places")
    pivots, _, n = _pivots(rows, cell_points, max_pivots)
    good = lambda p: p.isNotNull() & _place(p["x"], p["y"])
    ring = lambda r: F.concat(F.flatten(F.transform(F.filter(r, good), lambda p: F.array(p["x"], p["y"]))), F.array(F.lit(float("nan")), F.lit(float("nan"))))
    vertices = F.filter(F.flatten(F.filter("rings", lambda r: r.isNotNull())), good)
    shape = regions.where(F.col("region_id").isNotNull() & (F.size(vertices) > 0)).select(
        F.col("region_id").cast("long").alias("region_id"),
        F.flatten(F.transform(F.filter("rings", lambda r: r.isNotNull()), ring)).alias("flat"),
        *[f(F.transform(vertices, axis)).alias(f"{c}_{end}") for c, axis in (("x", lambda p: p["x"]), ("y", lambda p: p["y"])) for end, f in (("min", F.array_min), ("max", F.array_max))],
    )
    # From the middle of the box along a parallel, then along a meridian: no point of the box is farther.
    widest = F.when((F.col("y_min") <= 0) & (F.col("y_max") >= 0), 1.0).otherwise(F.greatest(F.abs(F.cos(F.radians("y_min"))), F.abs(F.cos(F.radians("y_max")))))
    widest = F.when((F.col("y_min") < -90) | (F.col("y_max") > 90), 1.0).otherwise(widest)
    reach = (F.radians(F.col("y_max") - F.col("y_min")) + F.radians(F.col("x_max") - F.col("x_min")) * widest) / 2 * EARTH_M + SLACK_M
    shape = shape.select("region_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("lon"), ((F.col("y_min") + F.col("y_max")) / 2).alias("lat"), reach.alias("reach"), "flat")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon, lat = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            cell = pivots.homes(unit_vectors(lon, lat)) if len(lon) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "id", "lon", "lat"])

    # Written, so that the boxes and the join see one assignment, even of points between two pivots.
    placed = materialise(rows.mapInArrow(home, "cell bigint, id bigint, lon double, lat double"), "placed")
    boxes = placed.groupBy("cell").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count("*").alias("n"))
    held = boxes.toArrow()  # at most a row of 48 bytes for each pivot
    box = np.full((pivots.cells, 4), np.nan)
    box[held["cell"].to_numpy()] = np.stack([held[c].to_numpy() for c in ("x0", "y0", "x1", "y1")], 1)
    salts = np.ones(pivots.cells, np.int64)
    salts[held["cell"].to_numpy()] = np.maximum(1, -(-held["n"].to_numpy() // (BLOCK_CELLS * (cell_points or CELL_POINTS))))

    def assign_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_block(ids, salts[cell])), *b.columns[1:], pa.nulls(len(ids), pa.float64()), pa.nulls(len(ids), pa.list_(pa.float64()))], schema=_CELL_ROW)

    def assign_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            cell, ids, lon, lat, reach, edges = zip(*rows)
            again, salt = spread(salts[np.array(cell)])
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(e) for e in edges])].astype(np.int32)), pa.array(np.concatenate(edges)))
            take = lambda v, kind: pa.array(np.array(v, kind)[again])
            return pa.RecordBatch.from_arrays([take(cell, np.int64), pa.array(salt), take(ids, np.int64), take(lon, float), take(lat, float), take(reach, float), flat.take(pa.array(again))], schema=_CELL_ROW)

        for b in batches:
            ids, lon, lat, reach = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for k in range(len(ids)):
                flat = np.asarray(b.column(4)[k].values)
                edges = _by_height(_edges(flat))
                if not len(edges[0]):
                    continue
                x0, x1 = np.nanmin(flat[0::2]), np.nanmax(flat[0::2])
                y0, y1 = np.nanmin(flat[1::2]), np.nanmax(flat[1::2])
                for _, cells in pivots.replicas(unit_vectors(lon[k : k + 1], lat[k : k + 1]), 2 * reach[k : k + 1]):
                    at = box[cells]
                    meet = (at[:, 0] <= x1) & (at[:, 2] >= x0) & (at[:, 1] <= y1) & (at[:, 3] >= y0)  # never for cells without points
                    for cell in cells[meet]:
                        own = clip_edges(edges, tuple(box[cell]))
                        if len(own[0]):
                            rows.append((cell, ids[k], lon[k], lat[k], reach[k], np.stack(own, 1).ravel()))
                            size += 4 * len(own[0]) * salts[cell]
                            if size > FLUSH:
                                yield out()
                                rows, size = [], 0
        if rows:
            yield out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        p, r = t.filter(t["reach"].is_null()), t.filter(t["reach"].is_valid())
        if not p.num_rows or not r.num_rows:
            return
        ids, lon, lat = (p[c].to_numpy() for c in ("id", "lon", "lat"))
        region, pieces = r["id"].to_numpy(), r["edges"].combine_chunks()
        tree = VantagePointTree(unit_vectors(lon, lat))
        hits = tree.within(unit_vectors(r["lon"].to_numpy(), r["lat"].to_numpy()), r["reach"].to_numpy())

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, at in _gathered(hits):
                order = np.argsort(q, kind="stable")
                q, at = q[order], at[order]
                which, start = np.unique(q, return_index=True)
                for k, s, e in zip(which, start, np.r_[start[1:], len(q)]):
                    own = at[s:e]
                    own = own[inside(lon[own], lat[own], tuple(np.asarray(pieces[int(k)].values).reshape(-1, 4).T))]
                    yield np.full(len(own), region[k]), ids[own]

        for a, b in _gathered(found()):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_INSIDE)

    cells = placed.mapInArrow(assign_points, _CELL_DDL).unionByName(shape.mapInArrow(assign_regions, _CELL_DDL))
    return cells.repartition(_tasks(rows, n, cell_points), "cell", "salt").groupBy("cell", "salt").applyInArrow(join, "region_id bigint, id bigint").distinct()


def current_nodes(nodes: DataFrame) -> DataFrame:
    """id, lon, lat of the nodes whose highest version is visible and has a place on the map.

    A null version is the lowest; rows of one id and version that differ are decided by loaded_at, then visible, lon
    and lat, the greatest winning; a null `visible` is no deletion. (0, 0) is a placeholder.
    """
    row = F.struct("version", "loaded_at", F.coalesce("visible", F.lit(True)).alias("visible"), "lon", "lat")
    last = nodes.where("id IS NOT NULL").groupBy("id").agg(F.max(row).alias("m"))
    return last.where("m.visible AND m.lon BETWEEN -180 AND 180 AND m.lat BETWEEN -90 AND 90 AND NOT (m.lon = 0 AND m.lat = 0)").select("id", "m.lon", "m.lat")


def near_nodes(nodes: DataFrame, radius_m: float = 10.0) -> DataFrame:
    """kind 'near', a_id, b_id of current nodes at most radius_m apart."""
    return near_pairs(current_nodes(nodes), radius_m).select(F.lit("near").alias("kind"), "a_id", "b_id")


def junction_regions(jcts: DataFrame, regions: DataFrame) -> DataFrame:
    """kind 'in', region_id as a_id and jct_id as b_id of junctions inside regions."""
    points = jcts.select(F.col("jct_id").alias("id"), F.col("point.x").alias("lon"), F.col("point.y").alias("lat"))
    return points_in_regions(points, regions).select(F.lit("in").alias("kind"), F.col("region_id").alias("a_id"), F.col("id").alias("b_id"))
