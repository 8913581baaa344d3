"""Matching street stretches of two sources that share no key.

1. Lines are cut into stations (evenly spaced points) on one side and short pieces on the other; both are keyed by grid
   cell, so a pair becomes a candidate only where a station projects into a piece that runs in the same direction.
   Lines too short to be hit by stations of others get stations of their own. Columns of the grid go around the globe.
2. Each candidate pair gets log-odds from noisy attributes: how much of the shorter line is covered, distance, names,
   side-road flag and road class.
3. Pairs that claim the same part of a line exclude each other: a one-to-one factor for each part of each line, a line
   having four parts, or one if lines are to be matched one to one. Loopy belief propagation exchanges messages between
   pairs and factors through joins until they settle, and the marginal probability of each pair is its confidence.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayweft.functions import names as N
from wayweft.functions.arrays import cuts, spread
from wayweft.functions.binding import let
from wayweft.operators.skew import HOT_SHARE, SALTS, salted_join
from wayweft.runtime import discard, hot_keys, materialise, shared_path, ship, small_or_shuffled

#: Metres: how far apart lines may run, spacing of stations, longest piece, overhang at the ends of a piece.
REACH_M, STATION_M, PIECE_M, OVERHANG_M = 25.0, 8.0, 60.0, 1.5
#: Lines shorter than this get stations of their own, since those of others may miss them.
SHORT_M = 2 * STATION_M
#: Stations or cells that one result batch holds.
FLUSH = 500_000
#: Most degrees between the directions of two lines (sense does not matter).
TURN_DEG = 30.0
#: Grid rows in degrees of latitude, about 64 m; columns are as wide as their row's rows are high.
ROW_DEG = 0.000576
_M_PER_DEG = 111_195.08
#: Parts of a line that are claimed separately, and the share at either end of a part that a claim may leave out, so
#: that neighbours which overlap a little do not exclude each other.
PARTS, SPARE = 4, 0.15
#: A pair is a match from this probability on.
MATCH = 0.5
#: Belief propagation: damping at first, change of a message (before damping) under which it has settled, and the rounds
#: after which messages that have not settled are an error.
DAMPING, SETTLED, ROUNDS = 0.1, 0.01, 400
#: After each so many rounds what has settled leaves, and what stays is damped more: its undamped share is halved, down to a least one.
STRETCH, LEAST_SHARE = 10, 0.1

#: Log-odds of the attributes, from the reading that fits first.
PRIOR = -1.0
COVER_ODDS = ((0.85, 3.0), (0.65, 1.5), (0.45, -1.0), (0.0, -6.0))
DISTANCE_ODDS = ((3.0, 2.5), (6.0, 2.0), (9.0, 1.2), (12.0, 0.2), (15.0, -1.2), (20.0, -2.8), (math.inf, -4.5))
NAME_ODDS = ((0.93, 2.5), (0.75, 1.5), (0.55, -0.5), (0.0, -1.5))
SIDE_ROAD_ODDS, NO_STREET_ODDS, SAME_CLASS_ODDS, OTHER_CLASS_ODDS, WALK_ODDS = -5.0, -9.0, 0.5, -0.5, -1.5
#: A side-road flag that differs says less where the rest of the name differs too: the whole name may be outdated.
RENAMED_SIDE_ODDS = -0.7
#: Which road class of one source corresponds to which of the other.
CLASSES = {"HIGHWAY": "primary", "MAJOR": "secondary", "MINOR": "residential", "CONNECTOR": "primary_link", "PEDESTRIAN": "footway"}
SIDE_ROAD = "FRONTAGE"
DIRECTIONS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")


def _raw_parts(text: str | None) -> list[np.ndarray]:
    """Parts of a line as (n, 2) arrays with n > 1, as they stand in the text."""
    try:
        o = json.loads(text) if text else None
        kind, c = (o.get("type"), o.get("coordinates")) if isinstance(o, dict) else (None, None)
    except (ValueError, RecursionError):
        return []
    parts = [c] if kind == "LineString" else c if kind == "MultiLineString" else []
    plain = "e" not in text.rpartition("]")[0].partition("[")[2] if parts else False  # neither true, false nor null
    out = []
    for part in parts if isinstance(parts, list) else []:
        xy = None
        if plain and text.count('"') == 6 and isinstance(part, list) and len(part) > 1:
            try:
                xy = np.array(part, float)
            except (ValueError, TypeError):  # positions of several lengths
                xy = None
        if xy is None or xy.ndim != 2 or xy.shape[1] < 2 or not np.isfinite(xy[:, :2]).all():
            at = [p[:2] for p in part if isinstance(p, list) and len(p) > 1 and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in p[:2])] if isinstance(part, list) else []
            xy = np.array(at, float)
        if len(xy) > 1:
            out.append(xy[:, :2])
    return out


def _righted(xy: np.ndarray) -> np.ndarray:
    """Positions in the wrong order, which can be seen where the second number can be no latitude but the first can."""
    swapped = (np.abs(xy[:, 1]) > 90) & (np.abs(xy[:, 0]) <= 90)
    return np.where(swapped[:, None], xy[:, ::-1], xy) if swapped.any() else xy


def _on_earth(xy: np.ndarray) -> np.ndarray:
    return (np.abs(xy[:, 1]) <= 90) & (np.abs(xy[:, 0]) <= 360)


def parse_lines(text: str | None) -> list[np.ndarray]:
    """Parts of a GeoJSON LineString or MultiLineString as (lon, lat) arrays; [] for anything else.

    Further dimensions are dropped, positions without two finite numbers are left out, a part needs two positions,
    and where the second number can be no latitude but the first can, the two are swapped.
    """
    return [xy for xy in map(_righted, _raw_parts(text)) if _on_earth(xy).all()]


def _row(lat):
    return np.floor(np.asarray(lat) / ROW_DEG).astype(np.int64)


def _columns(row):
    """Columns of a row: as many as fit around the globe."""
    return np.maximum(1, np.floor(360 / ROW_DEG * np.maximum(np.cos(np.radians((row + 0.5) * ROW_DEG)), 1e-3))).astype(np.int64)


def _cell(row, column):
    return row * 4_000_003 + column


@dataclass
class _Legs:
    """Legs of all lines of a batch, in order: ends, metric length, line, metres of the line before it; total by line."""

    a: np.ndarray
    b: np.ndarray
    length: np.ndarray
    line: np.ndarray
    before: np.ndarray
    total: np.ndarray


def _legs(texts: list[str | None]) -> _Legs:
    parts, of = [], []
    for i, text in enumerate(texts):
        own = _raw_parts(text)
        parts += own
        of += [i] * len(own)
    if not parts:
        none = np.zeros(0)
        return _Legs(np.zeros((0, 2)), np.zeros((0, 2)), none, none.astype(np.int64), none, np.zeros(len(texts)))
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    xy = _righted(np.concatenate(parts))
    first = np.cumsum(n) - n
    good = np.logical_and.reduceat(_on_earth(xy), first)
    row, k = spread(np.where(good, n - 1, 0))
    at = first[row] + k
    a, d, line = xy[at], xy[at + 1] - xy[at], np.array(of)[row]
    d[:, 0] = (d[:, 0] + 180) % 360 - 180  # the shorter way around
    length = np.hypot(d[:, 0] * np.cos(np.radians(a[:, 1] + d[:, 1] / 2)), d[:, 1]) * _M_PER_DEG
    upto = np.cumsum(length) - length
    start = np.searchsorted(line, np.arange(len(texts)))
    before = upto - upto[np.minimum(start, max(len(upto) - 1, 0))][line] if len(line) else upto
    return _Legs(a, a + d, length, line, before, np.bincount(line, length, len(texts)))


def _stations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stations of every line, at least two for each part and STATION_M apart at most."""
    for batch in batches:
        ids, legs = batch.column(0).to_numpy(zero_copy_only=False), _legs(batch.column(1).to_pylist())
        count = np.where(legs.total > 0, np.maximum(2 * PARTS, np.ceil(legs.total / STATION_M)), 0).astype(np.int64)
        upto, start = np.cumsum(legs.length), np.searchsorted(legs.line, np.arange(len(ids) + 1))
        for some in cuts(count, FLUSH):
            line, k = spread(count[some])
            line += some.start
            if not len(line):
                continue
            at = (k + 0.5) * legs.total[line] / count[line] + (upto - legs.length)[start[line]]
            leg = np.clip(np.searchsorted(upto, at), start[line], start[line + 1] - 1)
            t = (at - upto[leg] + legs.length[leg]) / np.maximum(legs.length[leg], 1e-12)
            d = legs.b[leg] - legs.a[leg]
            p = legs.a[leg] + d * np.clip(t, 0, 1)[:, None]
            east, north = d[:, 0] * np.cos(np.radians(p[:, 1])), d[:, 1]
            size = np.maximum(np.hypot(east, north), 1e-300)
            row = _row(p[:, 1])
            columns = _columns(row)
            column = np.floor(p[:, 0] % 360 * columns / 360).astype(np.int64) % columns
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[line], k, legs.total[line], (p[:, 0] + 180) % 360 - 180, p[:, 1], east / size, north / size, _cell(row, column))], names=_STATION_NAMES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of every line, once for each cell in which a station may be within reach."""
    reach = (REACH_M + OVERHANG_M) / _M_PER_DEG
    for batch in batches:
        ids, legs = batch.column(0).to_numpy(zero_copy_only=False), _legs(batch.column(1).to_pylist())
        count = np.where(legs.length > 0, np.maximum(1, np.ceil(legs.length / PIECE_M)), 0).astype(np.int64)
        for some in cuts(count, FLUSH // 8):
            leg, k = spread(count[some])
            leg += some.start
            n, d = count[leg], legs.b[leg] - legs.a[leg]
            s, e = legs.a[leg] + d * (k / n)[:, None], legs.a[leg] + d * ((k + 1) / n)[:, None]
            low_row, high_row = _row(np.minimum(s[:, 1], e[:, 1]) - reach), _row(np.maximum(s[:, 1], e[:, 1]) + reach)
            piece, r = spread(high_row - low_row + 1)
            row = low_row[piece] + r
            columns = _columns(row)
            wide = reach / np.maximum(np.cos(np.radians((row + 0.5) * ROW_DEG)), 1e-3) * 1.01
            low = np.floor((np.minimum(s[:, 0], e[:, 0])[piece] - wide) * columns / 360).astype(np.int64)
            high = np.floor((np.maximum(s[:, 0], e[:, 0])[piece] + wide) * columns / 360).astype(np.int64)
            at, c = spread(np.minimum(high - low + 1, columns))
            cell = _cell(row[at], (low[at] + c) % columns[at])
            piece = piece[at]
            line = legs.line[leg[piece]]
            for part in range(0, len(piece), FLUSH):
                p, o = piece[part : part + FLUSH], line[part : part + FLUSH]
                size = legs.length[leg[p]] / n[p]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[o], legs.total[o], legs.before[leg[p]] + size * k[p], size, (s[p, 0] + 180) % 360 - 180, s[p, 1], e[p, 0] - s[p, 0], e[p, 1] - s[p, 1], cell[part : part + FLUSH])], names=_PIECE_NAMES)


_STATION_DDL = "c_id bigint, station bigint, c_len double, lon double, lat double, east double, north double, cell bigint"
_PIECE_DDL = "o_id bigint, o_len double, from_m double, piece_m double, lon0 double, lat0 double, d_lon double, d_lat double, cell bigint"
_STATION_NAMES, _PIECE_NAMES = ([f.split()[0] for f in ddl.split(", ")] for ddl in (_STATION_DDL, _PIECE_DDL))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (c_id, geometry), right (o_id, geometry) -> c_id, o_id, cover, apart_m, c_parts, o_parts.

    cover: covered share of the shorter line; apart_m: mean distance across; c_parts, o_parts: numbers of the parts of
    either line that the pair claims. Stations are set on left, but for short lines of right on these. Cells that hold
    a large share of all stations are spread over several tasks.
    """
    ship(left.sparkSession)
    pieces = materialise(right.mapInArrow(_pieces, _PIECE_DDL), "pieces")
    met = _met(left, pieces.where(F.col("o_len") >= SHORT_M))
    short = pieces.where(F.col("o_len") < SHORT_M).select("o_id").distinct()
    if not short.isEmpty():
        turned = _met(right.join(small_or_shuffled(short), "o_id", "left_semi").select(F.col("o_id").alias("c_id"), "geometry"), materialise(left.select(F.col("c_id").alias("o_id"), "geometry").mapInArrow(_pieces, _PIECE_DDL), "pieces"))
        met = met.unionByName(turned.select(F.col("o_id").alias("c_id"), F.col("c_id").alias("o_id"), "cover", "apart_m", F.col("o_parts").alias("c_parts"), F.col("c_parts").alias("o_parts")))
    return met


def _met(left: DataFrame, pieces: DataFrame) -> DataFrame:
    """candidate_pairs() of stations on left (c_id, geometry) with pieces of the other lines."""
    stations = materialise(left.mapInArrow(_stations, _STATION_DDL), "stations")
    met = salted_join(stations, pieces, "cell")
    across = F.cos(F.radians("lat")) * _M_PER_DEG
    east = F.col("lon") - F.col("lon0")
    east = F.when(east > 180, east - 360).when(east < -180, east + 360).otherwise(east)  # the shorter way around
    ex, ey = F.col("d_lon") * across, F.col("d_lat") * _M_PER_DEG
    px, py = east * across, (F.col("lat") - F.col("lat0")) * _M_PER_DEG
    met = met.withColumns({"ex": ex, "ey": ey, "px": px, "py": py})
    met = met.withColumn("size", F.greatest(F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")), F.lit(1e-9)))
    met = met.withColumns({"along": (F.col("px") * F.col("ex") + F.col("py") * F.col("ey")) / F.col("size"), "off": F.abs(F.col("px") * F.col("ey") - F.col("py") * F.col("ex")) / F.col("size"), "turn": F.abs(F.col("east") * F.col("ex") + F.col("north") * F.col("ey")) / F.col("size")})
    met = met.where((F.col("off") <= REACH_M) & (F.col("along") >= -OVERHANG_M) & (F.col("along") <= F.col("size") + OVERHANG_M) & (F.col("turn") >= math.cos(math.radians(TURN_DEG))))
    place = F.col("from_m") + F.least(F.greatest("along", F.lit(0.0)), "piece_m")
    each = met.groupBy("c_id", "o_id", "station").agg(F.min("off").alias("off"), F.min("c_len").alias("c_len"), F.min("o_len").alias("o_len"), F.min_by(place, "off").alias("place"))
    n = F.greatest(F.lit(2 * PARTS), F.ceil(F.col("c_len") / STATION_M))
    each = each.withColumn("spacing", F.col("c_len") / n)
    stands = (F.col("station") + 0.5) * F.col("spacing")
    pairs = each.groupBy("c_id", "o_id").agg(
        F.sum("spacing").alias("covered"), F.avg("off").alias("apart_m"), F.min("c_len").alias("c_len"), F.min("o_len").alias("o_len"),
        F.min(stands).alias("c_low"), F.max(stands).alias("c_high"), F.min("place").alias("o_low"), F.max("place").alias("o_high"), F.min("spacing").alias("spacing"),
    )

    def claims(side: str) -> Column:
        part, edge = F.col(f"{side}_len") / PARTS, F.col("spacing") / 4
        whole = [(F.col(f"{side}_low") - edge <= (k + SPARE) * part) & (F.col(f"{side}_high") + edge >= (k + 1 - SPARE) * part) for k in range(PARTS)]
        return F.array_compact(F.array(*[F.when(w, k) for k, w in enumerate(whole)]))

    return pairs.select("c_id", "o_id", F.least(F.lit(1.0), F.col("covered") / F.least("c_len", "o_len")).alias("cover"), "apart_m", claims("c").alias("c_parts"), claims("o").alias("o_parts"))


def _step(value: Column, table: tuple, upward: bool) -> Column:
    out = F.lit(table[-1][1])
    for limit, odds in reversed(table[:-1]):
        out = F.when(value <= limit if upward else value >= limit, odds).otherwise(out)
    return out


def _name_parts(name: Column) -> Column:
    """struct(core, side): the canonical name without leading direction and side-road words, and whether it had such."""
    flag = lambda w: F.levenshtein(w, F.lit(SIDE_ROAD)) <= 2

    def shorten(words: Column) -> Column:
        side = F.exists(words, flag)
        own = F.filter(words, lambda w: ~flag(w))
        road = lambda o: F.when(side & (F.element_at(o, -1) == "RD"), F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0)))).otherwise(o)
        core = lambda o: F.when((F.size(o) > 1) & F.get(o, F.lit(0)).isin(*DIRECTIONS), F.slice(o, 2, F.greatest(F.size(o), F.lit(1)))).otherwise(o)
        return F.struct(F.array_join(let(let(own, road), core), " ").alias("core"), side.alias("side"))

    return let(F.split(N.canonical(name), " "), shorten)


def _described(names: Column) -> Column:
    return F.filter(F.transform(F.filter(names, lambda n: n.isNotNull()), _name_parts), lambda p: p["core"] != "")


def attribute_odds(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds `odds`, the log-odds of each pair from its own attributes. left (c_id, names, class), right (o_id, names, class)."""
    l = left.select("c_id", _described(F.col("names")).alias("c_names"), F.col("class").alias("c_class"))
    r = right.select("o_id", _described(F.col("names")).alias("o_names"), F.col("class").alias("o_class"))
    both = salted_join(salted_join(materialise(pairs, "pairs"), l, "c_id"), r, "o_id")
    alike = F.array_max(F.flatten(F.transform("c_names", lambda a: F.transform("o_names", lambda b: F.struct((1 - N.levenshtein_ratio(a["core"], b["core"])).alias("s"), (a["side"] == b["side"]).alias("same_side"))))))
    both = both.withColumn("alike", alike)
    expected = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])[F.upper(F.trim("c_class"))]
    name = F.when(F.col("alike").isNull(), 0.0).otherwise(_step(F.col("alike.s"), NAME_ODDS, False) + F.when(F.col("alike.same_side"), 0.0).when(F.col("alike.s") >= NAME_ODDS[2][0], SIDE_ROAD_ODDS).otherwise(RENAMED_SIDE_ODDS))
    walk = F.when(expected.isNotNull() & ((expected == CLASSES["PEDESTRIAN"]) != (F.col("o_class") == CLASSES["PEDESTRIAN"])), WALK_ODDS).otherwise(0.0)
    road = F.when(F.col("o_class").isNull(), NO_STREET_ODDS).when(expected.isNull(), 0.0).when(F.col("o_class") == expected, SAME_CLASS_ODDS).otherwise(OTHER_CLASS_ODDS)
    odds = F.lit(PRIOR) + _step(F.col("cover"), COVER_ODDS, False) + _step(F.col("apart_m"), DISTANCE_ODDS, True) + name + walk + road
    return both.select("c_id", "o_id", "cover", "apart_m", "c_parts", "o_parts", odds.alias("odds"))


def propagate(pairs: DataFrame) -> DataFrame:
    """Adds `confidence`, the marginal probability of each pair (c_id, o_id, c_parts, o_parts, odds).

    A factor lets at most one of the pairs that claim a part be true. With L the odds message of a pair to a factor,
    the factor answers -log(1 + sum of exp(L) of its other pairs); a pair's belief is its own odds plus all answers.
    Parts of a line that the same pairs claim are one factor, else their exclusion would count several times.
    Sums go through groupBy with partial aggregation, so a factor of any size is never one task's list. Pairs that
    share no part with another one are settled at once. Every round is written to the shared folder.

    With little damping, components with overlapping factors swing. Rounds go on until no message changes by SETTLED;
    components that have settled leave the loop, and those that stay are damped more and more. A component is known by
    its least factor, which travels along with the messages; it is whole once no message of that name saw another
    name around it. If messages still change after ROUNDS rounds, this fails rather than return them.
    """
    pairs = materialise(pairs, "odds")
    claims = pairs.select("c_id", "o_id", "odds", F.explode(F.concat(F.transform("c_parts", lambda k: F.struct(F.lit(0).alias("side"), F.col("c_id").alias("line"), k.alias("part"))), F.transform("o_parts", lambda k: F.struct(F.lit(1).alias("side"), F.col("o_id").alias("line"), k.alias("part"))))).alias("f"))
    claims = claims.select("c_id", "o_id", "odds", F.col("f.side").alias("side"), F.col("f.line").alias("line"), F.col("f.part").alias("part"))
    claimed = claims.groupBy("side", "line", "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c_id", "o_id")).alias("set")).where("n > 1")
    shared = claimed.groupBy("side", "line", "n", "set").agg(F.min("part").alias("part"))
    shared = materialise(shared.select("side", "line", "part", "n", F.xxhash64("side", "line", "part").alias("factor")), "factors")
    hot = materialise(hot_keys(shared, ["factor"], "n", HOT_SHARE).withColumn("hot", F.lit(True)), "hot-factors")
    any_hot = not hot.isEmpty()
    claims = claims.join(shared.select("side", "line", "part", "factor"), ["side", "line", "part"]).join(F.broadcast(hot), "factor", "left")
    claims = claims.select("factor", F.when(F.col("hot"), F.pmod(F.xxhash64("c_id", "o_id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.coalesce("hot", F.lit(False)).alias("hot"), "c_id", "o_id", "odds")
    state = materialise(claims.withColumns({"answer": F.lit(0.0), "group": F.col("factor")}), "messages")
    kept, settled = ("c_id", "o_id", "answer"), shared_path(pairs.sparkSession, "settled")
    of_pair = Window.partitionBy("c_id", "o_id")  # a pair makes at most two claims for each part of a line
    for n in range(1, ROUNDS + 1):
        share = max(LEAST_SHARE, (1 - DAMPING) / 2 ** ((n - 1) // STRETCH))
        asked = state.withColumns({"all": F.sum("answer").over(of_pair), "low": F.min("group").over(of_pair), "high": F.max("group").over(of_pair)})
        asked = asked.withColumn("ask", F.exp(F.least(F.greatest(F.col("odds") + F.col("all") - F.col("answer"), F.lit(-30.0)), F.lit(30.0))))
        asked = asked.repartition("factor", "salt")  # serves the sums and the join
        summed = asked.groupBy("factor", "salt").agg(F.sum("ask").alias("sum"), F.min("low").alias("least"), F.max("high").alias("most"), F.first("hot").alias("is_hot"))
        if any_hot:
            salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            summed = summed.groupBy("factor", "is_hot").agg(F.sum("sum").alias("sum"), F.min("least").alias("least"), F.max("most").alias("most")).withColumn("salt", F.explode(salts))
        fresh = -F.log1p(F.greatest(F.col("sum") - F.col("ask"), F.lit(0.0)))
        moved = asked.join(summed, ["factor", "salt"]).withColumn("by", fresh - F.col("answer"))
        after = moved.select("factor", "salt", "hot", "c_id", "o_id", "odds", (F.col("answer") + F.lit(share) * F.col("by")).alias("answer"), F.col("least").alias("group"), F.col("group").alias("was"), F.abs("by").alias("change"), (F.col("least") < F.col("most")).alias("open"))
        after = materialise(after, "messages")
        discard(state)
        state = after
        change = after.agg(F.max("change")).first()[0]
        if change is None or change < SETTLED:
            break
        if n % STRETCH == 0:
            still = after.groupBy("was").agg(F.max("change").alias("most"), F.max("open").alias("any")).withColumn("still", F.col("any") | (F.col("most") >= SETTLED)).select("was", "still")
            after = materialise(salted_join(after, still, "was"), "messages")
            discard(state)
            after.where(~F.col("still")).select(*kept).write.mode("append").parquet(settled)
            state = materialise(after.where("still").drop("still"), "messages")
            discard(after)
    else:
        raise RuntimeError(f"belief propagation: messages of {state.select('c_id', 'o_id').distinct().count()} pairs have not settled after {ROUNDS} rounds")
    state.select(*kept).write.mode("append").parquet(settled)
    state = pairs.sparkSession.read.schema(state.select(*kept).schema).parquet(settled)
    belief = state.groupBy("c_id", "o_id").agg(F.sum("answer").alias("all"))
    total = F.col("odds") + F.coalesce("all", F.lit(0.0))
    return pairs.join(belief, ["c_id", "o_id"], "left").withColumn("confidence", 1 / (1 + F.exp(-total))).drop("all", "odds", "c_parts", "o_parts")


def _one_of_each(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """lines (key, geometry, names, class) without exact copies, and which key stands for which: rep, key; None if there are no copies."""
    marked = materialise(lines.where("geometry IS NOT NULL").select(key, F.md5(F.to_json(F.struct("geometry", "names", "class"))).alias("same")), "marks")
    copies = materialise(marked.groupBy("same").agg(F.min(key).alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    if copies.isEmpty():
        return lines, None
    members = materialise(salted_join(marked, copies, "same").select("rep", key), "members")
    return lines.join(small_or_shuffled(members.where(F.col("rep") != F.col(key)).select(key)), key, "left_anti"), members


def _for_all_copies(scored: DataFrame, key: str, members: DataFrame | None) -> DataFrame:
    """The result of a line for all its exact copies."""
    if members is None:
        return scored
    scored = materialise(scored, "scored")
    reps = small_or_shuffled(members.select(F.col("rep").alias(key)).distinct())
    again = salted_join(members.select(F.col("rep"), F.col(key).alias("_own")), scored.withColumnRenamed(key, "rep"), "rep").withColumnRenamed("_own", key)
    return scored.join(reps, key, "left_anti").unionByName(again.select(*scored.columns))


def match_streets(centerline: DataFrame, osm_lines: DataFrame, one_to_one: bool = False) -> DataFrame:
    """objectid, way_id, cover, apart_m, confidence of all candidate pairs.

    one_to_one: a line has one counterpart at most. Else only pairs that claim the same part of a line exclude each
    other, so that a street which is cut in two on one side has both as counterparts.
    Of several rows of an id the last delivered counts. Lines without id, without geometry or with broken geometry
    match nothing; missing and empty names and classes are no evidence either way; lines without `highway` are no
    streets; lines that are equal in geometry, names and class are one line under several ids, each of which gets its
    result; empty tables give an empty result.
    """
    c = centerline.where("objectid IS NOT NULL").groupBy("objectid").agg(F.max(F.struct("loaded_at", "geometry", "fullname", "category")).alias("m"))
    c = materialise(c.select(F.col("objectid").alias("c_id"), "m.geometry", F.array("m.fullname").alias("names"), F.col("m.category").alias("class")), "left")
    tag = lambda k: F.element_at("tags", k)
    o = osm_lines.where("way_id IS NOT NULL").select("way_id", "loaded_at", "geometry", F.array_compact(F.array(*[tag(k) for k in N.OSM_NAME_TAGS])).alias("names"), tag("highway").alias("class"))
    o = o.groupBy("way_id").agg(F.max(F.struct("loaded_at", "geometry", "names", "class")).alias("m"))
    o = materialise(o.select(F.col("way_id").alias("o_id"), "m.geometry", "m.names", "m.class"), "right")
    (c, c_members), (o, o_members) = _one_of_each(c, "c_id"), _one_of_each(o, "o_id")
    pairs = candidate_pairs(c.select("c_id", "geometry"), o.select("o_id", "geometry"))
    if one_to_one:
        pairs = pairs.withColumns({"c_parts": F.array(F.lit(0)), "o_parts": F.array(F.lit(0))})
    scored = propagate(attribute_odds(pairs, c, o))
    scored = _for_all_copies(_for_all_copies(scored, "c_id", c_members), "o_id", o_members)
    return scored.select(F.col("c_id").alias("objectid"), F.col("o_id").alias("way_id"), "cover", "apart_m", "confidence")
