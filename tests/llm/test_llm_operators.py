"""Tests of the operators for training data: exact round trips, brute force, and fixtures with a known answer."""

import json
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayweft.llm import bpe, entity_match, mixing, repetition

VOCABULARY = os.environ.get("WAYWEFT_VOCABULARY", bpe.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


# Tokenizer


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.splitext(VOCABULARY)[0] + ".json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def ids(text):
    return np.frombuffer(bpe.encode_text(text, bpe.load(VOCABULARY)), "<i4").tolist()


ODD = ["", " ", "\n\n x", "<|endoftext|>", "a" * 3000, "ab" * 999, " " * 500 + "x", "0" * 777, "don't 'RE we'll", "é漢字ｶﾅ🙂‍👩", "՘a₏1", "﻿​\x00", "aaab" * 200, "=" * 300, "\t\r\n 　.", "x" + "́" * 50]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_public_tokenizer(reference, text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(reference, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids
    assert bpe.load(VOCABULARY).encode.__self__.decode(ids(text)) == text.encode()


@needs_vocabulary
@settings(max_examples=100, deadline=None)
@given(st.text("etaoin", min_size=1, max_size=400))
def test_ids_of_long_pieces(reference, text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=25), st.binary(max_size=30))
def test_backtracking_equals_merging(pairs, data):
    """Any vocabulary grown by merges, against merging in rank order."""
    alphabet = b"abcd"
    tokens = [bytes([c]) for c in alphabet]
    for a, b in pairs:
        new = tokens[a % len(tokens)] + tokens[b % len(tokens)]
        if new not in tokens and merge(new, tokens) == [tokens[a % len(tokens)], tokens[b % len(tokens)]]:
            tokens.append(new)
    piece = bytes(alphabet[c % 4] for c in data)
    got = [tokens[i] for i in bpe.Backtracking(tokens).encode_piece(piece)]
    assert got == merge(piece, tokens)


def merge(piece, tokens):
    rank = {t: i for i, t in enumerate(tokens)}
    parts = [bytes([c]) for c in piece]
    while True:
        best = min(((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@needs_vocabulary
def test_corpus_round_trip(spark):
    rows = [(1, "A b\n\nc", "x"), (2, "", "x"), (3, None, "x"), (None, "z", "x"), (2, "", "x"), (5, "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("_k0", F.lit(1))
    enc = bpe.encode_corpus(df, ["doc_id"], "text", VOCABULARY)
    assert dict(enc.dtypes)["ids"] == "array<int>" and enc.columns == ["doc_id", "ids"]
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got[2] == [] and got[3] is None and len(got[5]) >= 200_000
    back = {r.doc_id: r.text for r in bpe.decode_corpus(enc, ["doc_id"], "ids", VOCABULARY).collect()}
    assert back == {r[0]: r[1] for r in rows}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"], "text", VOCABULARY).collect()}
    assert counts == {k: len(v or []) for k, v in got.items()}
    assert enc.limit(0).count() == 0 and bpe.encode_corpus(df.limit(0), ["doc_id"], "text", VOCABULARY).count() == 0


@needs_vocabulary
def test_the_vocabulary_travels_with_the_job(spark, tmp_path):
    """Workers read the copy that came with the job, wherever the driver had it."""
    import shutil

    own = str(tmp_path / "own.tiktoken")
    shutil.copy(VOCABULARY, own)
    enc = bpe.encode_corpus(spark.createDataFrame([(1, "A b")], "doc_id long, text string"), ["doc_id"], "text", own)
    assert enc.first().ids == ids("A b")
    os.remove(own)
    assert enc.first().ids == ids("A b")


@needs_vocabulary
def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bpe.encode_corpus(df, ["doc_id"], "text", VOCABULARY).first().ids == ids("a�b")


# Mixing


def test_water_fill():
    plan = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 100, "b": 1000, "c": 10, "d": 50}, {"a": 2, "b": 1, "c": 3, "d": 1}, 800)
    assert plan["a"].planned == 200 and plan["c"].planned == 30 and plan["b"].planned == pytest.approx(570) and plan["d"].planned == 0
    assert sum(s.planned for s in mixing.water_fill({"a": 1.0}, {"a": 10}, {"a": 2}, 1000).values()) == 20
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"b": 10}, {"a": 1, "b": 1})["b"].planned == 10


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.integers(0, 1000), st.integers(0, 5)), min_size=1), st.floats(1, 10_000))
def test_water_fill_properties(sources, total):
    w, n, c = ({k: v[i] for k, v in sources.items()} for i in range(3))
    plan = mixing.water_fill(w, n, c, total)
    room = sum(n[k] * c[k] for k in sources if w[k] > 0)
    assert sum(p.planned for p in plan.values()) == pytest.approx(min(total, room), rel=1e-6, abs=1e-6)
    free = [p for p in plan.values() if p.planned and p.planned < p.size * p.cap * (1 - 1e-9)]
    assert all(a.planned * b.weight == pytest.approx(b.planned * a.weight, rel=1e-6) for a in free for b in free)
    assert all(p.planned <= p.size * p.cap * (1 + 1e-9) for p in plan.values())


def test_mix_of_sources(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice("aaaab") if i % 50 else None, rng.randint(0, 40)) for i in range(3000)] + [(9000, "c", None), (9001, "z", 5), (1, "a", 7), (1, "a", 7)]
    sized = spark.createDataFrame(docs, "id long, source string, n_tokens long").withColumn("copies", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("c", 0.1, 4), ("d", None, None), (None, 0.1, 1)], "source string, weight double, max_repeat int")
    mix = mixing.mix_sources(sized, targets)
    rows, shares = mix.records.collect(), {r.source: r for r in mix.shares.collect()}
    assert set(shares) == {"a", "b", "c", "d", None, "z"} and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    for s in "ab":
        assert abs(shares[s].mixed_tokens - shares[s].planned_tokens) <= 20.5
        assert shares[s].mixed_tokens == sum(r.n_tokens for r in rows if r.source == s)
    assert {r.source for r in rows} == {"a", "b"} and max(r["copy"] for r in rows if r.source == "b") <= 3
    whole = int(shares["b"].epochs)
    have = {r.id for r in rows if r.source == "b" and r["copy"] <= whole}
    assert whole == 0 or have == {d[0] for d in docs if d[1] == "b" and d[2]}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(sized, targets).records.collect()))  # seeded
    assert mixing.mix_sources(sized.limit(0), targets).records.count() == 0
    assert mixing.mix_sources(sized, targets.limit(0)).records.count() == 0


def test_water_fill_with_the_least_weights():
    assert mixing.water_fill({"a": 5e-324}, {"a": 1}, {"a": 2}, 1.5)["a"].planned == 1.5
    plan = mixing.water_fill({"a": 5e-324, "b": 1e-323}, {"a": 9, "b": 9}, {"a": 9, "b": 9}, 3.0)
    assert (plan["a"].planned, plan["b"].planned) == pytest.approx((1.0, 2.0))


@pytest.mark.parametrize("total", [30, 4, 1000, 2699])
def test_mix_of_equal_records(spark, monkeypatch, total):
    """One record is the whole source: as many of its repetitions are taken as the total holds."""
    monkeypatch.setattr(mixing, "BLOCK", 100)
    sized = spark.createDataFrame([(None, "a", 3)] * 900 if total > 900 else [(7, "a", 3)] * 900, "id long, source string, n_tokens long")
    mix = mixing.mix_sources(sized, spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeat int"), total=total)
    want = min(900, round(total / 3))
    assert mix.records.count() == want and mix.shares.first().mixed_tokens == 3 * want and mix.shares.first().actual_share == 1


# Repetition


def brute(text):
    units, _ = repetition.units_of(text)
    weight = [1 if len(u) == 1 and repetition._unspaced.match(u) else 2 for u in units]
    seen, covered = set(), [False] * len(units)
    for i in range(len(units)):
        total, end = 0, i
        while end < len(units) and total < repetition.LEAST_WEIGHT:
            total += weight[end]
            end += 1
        if total < repetition.LEAST_WEIGHT:
            break
        gram = tuple(units[i:end])
        if gram in seen:
            covered[i:end] = [True] * (end - i)
        seen.add(gram)
    n = sum(map(len, units))
    return sum(len(u) for u, c in zip(units, covered) if c) / n if n else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "漢", "字", "ไ", "д", "1", ".", "Don't"]), max_size=60).map(" ".join), min_size=1, max_size=6))
def test_shares_equal_brute_force(texts):
    assert [r[1] for r in repetition.measure_texts(texts)] == pytest.approx([brute(t) for t in texts])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 5, 300))
    unit = rng.integers(0, 3, 300)
    rank = repetition.suffix_ranks(unit, doc)[-1]
    suffix = lambda i: (doc[i], *unit[i : np.searchsorted(doc, doc[i], "right")].tolist())
    assert sorted(range(300), key=suffix) == np.argsort(rank).tolist()


def test_blocks_do_not_matter(monkeypatch):
    texts = ["one two three four five six " * n for n in range(9)] + ["x " * 50]
    whole = repetition.measure_texts(texts)
    monkeypatch.setattr(repetition, "BLOCK_UNITS", 7)
    assert repetition.measure_texts(texts) == whole
    assert whole[2][2] == len("onetwothreefourfivesix")


def test_repetitive_documents(spark):
    phrase = "The same, old Story is told here again 12! "
    rows = [(1, phrase * 10), (2, phrase), (3, None), (4, ""), (5, "12 34 !!"), (6, "".join(chr(0x4E00 + i) for i in range(300))), (7, "漢字仮名交文体裁一二三四" * 9), (8, "spam " * 300_000), (1, phrase * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("x")).withColumn("_text", F.lit(0))
    assert sorted(r.doc_id for r in repetition.repetitive(df, ["doc_id"], "text").collect()) == [1, 7, 8]
    got = {r.doc_id: r for r in repetition.repetition(df, ["doc_id"], "text").collect()}
    assert got[3].share is None and got[4].share == 0 and got[5].n_letters == 0 and got[2].share == 0 and got[1].share == pytest.approx(0.9)
    assert repetition.repetitive(df.limit(0), ["doc_id"], "text").count() == 0
    assert [r.doc_id for r in repetition.repetitive(df, ["doc_id"], "text", share_limit=2.0, longest_limit=1_000_000).collect()] == [8]
    over = {(r.doc_id, r.over_share, r.over_longest) for r in repetition.over_limits(df, ["doc_id"], "text", longest_limit=10_000).collect()}
    assert over == {(1, True, False), (7, True, False), (8, True, True)}
    once = "a quite long sentence without any repeated part in it " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    long = spark.createDataFrame([(1, once + " the end " + once[: len(once) // 4])], "doc_id long, text string")
    assert [(r.over_share, r.over_longest) for r in repetition.over_limits(long, ["doc_id"], "text", longest_limit=200).collect()] == [(False, True)]


# Entity matching

LON, LAT = -170.0, 43.0


def line(points, kind="LineString"):
    at = lambda x, y: [round(LON + x / 81_300, 7), round(LAT + y / 111_195, 7)]
    return json.dumps({"type": kind, "coordinates": [at(*p) for p in points]})


def match(spark, city, osm):
    c = spark.createDataFrame([(i, n, k, g, None) for i, n, k, g in city], "objectid long, fullname string, category string, geometry string, loaded_at timestamp").withColumn("odds", F.lit("x"))
    o = spark.createDataFrame([(i, t, g, None) for i, t, g in osm], "way_id long, tags map<string,string>, geometry string, loaded_at timestamp").withColumn("cell", F.lit("x"))
    return {(r.objectid, r.way_id): r.confidence for r in entity_match.match_streets(c, o).collect()}


def test_streets_with_known_answer(spark):
    road = lambda n: {"highway": "residential", **({"name": n} if n else {})}
    city = [
        (1, "N OAK ST", "MINOR", line([(0, 0), (100, 0)])), (1, "N OAK ST", "MINOR", line([(0, 0), (100, 0)])),
        (2, "OAK STREET FRONTAGE RD", "MINOR", line([(0, 18), (100, 18)])), (3, None, "MINOR", line([(300, 0), (300, 120)])),
        (4, "ELM AVE", "MAJOR", line([(500, 0), (600, 0)])), (5, "", None, line([(100, 0), (200, 0)])), (6, "X", "MINOR", None), (7, "X", "MINOR", "{"), (8, "X", "MINOR", '{"type": "Point", "coordinates": [1, 2]}'), (None, "X", "MINOR", line([(0, 0), (100, 0)])),
    ]
    osm = [
        (11, road("Nroth Oak Street"), line([(102, 4), (1, 5)])), (12, road("Oak Street Frontage Road"), line([(0, 20), (100, 21)])), (13, road(None), line([(303, 2), (304, 119)])),
        (14, road("Elm Avenue"), line([(500, 3), (548, 3)])), (15, road("Elm Avenue"), line([(548, 3), (600, 3)])), (16, {"railway": "rail"}, line([(0, 1), (100, 1)])), (17, road("Cross Rd"), line([(50, -60), (50, 60)])),
        (18, None, line([(0, 1), (100, 1)])), (19, road("Oak St"), line([(103, 1), (199, 1)])),
    ]
    got = match(spark, city, osm)
    assert {k for k, v in got.items() if v >= entity_match.MATCH} == {(1, 11), (2, 12), (3, 13), (4, 14), (4, 15), (5, 19)}
    assert all(0 <= v <= 1 for v in got.values())
    assert match(spark, [], osm) == {} and match(spark, city, []) == {}


def test_one_to_one_factors_choose(spark):
    """Two unnamed parallel lines and one unnamed street: the nearer one takes it."""
    osm = [(1, {"highway": "residential"}, line([(0, 4), (100, 4)])), (2, {"highway": "residential"}, line([(0, -10), (100, -10)]))]
    got = match(spark, [(9, None, "MINOR", line([(0, 0), (100, 0)]))], osm)
    assert got[9, 1] > 0.7 and got[9, 2] < 0.3


def geo(points):
    return json.dumps({"type": "LineString", "coordinates": points})


def test_streets_across_the_180th_meridian(spark):
    deg = 1 / 111_195
    road = {"highway": "residential", "name": "Date Line"}
    city = [(1, "DATE LINE", "MINOR", geo([[179.99995, 0.0], [179.99995, 100 * deg]])), (2, "DATE LINE", "MINOR", geo([[179.9999, 0.01], [180.0001, 0.01]])), (3, "DATE LINE", "MINOR", geo([[-180.0, 0.02], [-180.0, 0.021]]))]
    osm = [(11, road, geo([[-179.99997, 0.0], [-179.99997, 100 * deg]])), (12, road, geo([[179.9999, 0.01 + 2 * deg], [-179.9999, 0.01 + 2 * deg]])), (13, road, geo([[180.0, 0.021], [180.0, 0.02]]))]
    got = match(spark, city, osm)
    assert {k for k, v in got.items() if v >= entity_match.MATCH} == {(1, 11), (2, 12), (3, 13)}


def test_short_lines_are_candidates(spark):
    """Lines that fall between the stations of others, on either side."""
    road = {"highway": "residential", "name": "Elm Avenue"}
    osm = [(i, road, line([(x, 2), (x + 3, 2)])) for i, x in enumerate(range(0, 200, 3))]
    got = match(spark, [(1, "ELM AVE", "MINOR", line([(0, 0), (201, 0)]))], osm)
    assert {k for k, v in got.items() if v >= entity_match.MATCH} == {(1, i) for i in range(len(osm))}
    got = match(spark, [(i, "ELM AVE", "MINOR", g) for i, _, g in osm], [(1, road, line([(0, 0), (201, 0)]))])
    assert {k for k, v in got.items() if v >= entity_match.MATCH} == {(i, 1) for i in range(len(osm))}


def test_exact_copies_share_their_result(spark):
    """Copies under several ids do not compete with each other, and every one gets every counterpart."""
    road = {"highway": "residential", "name": "Oak Street"}
    city = [(i, "OAK ST", "MINOR", line([(0, 0), (100, 0)])) for i in (1, 2, 3)] + [(4, "ELM ST", "MINOR", line([(0, 50), (100, 50)]))]
    osm = [(i, road, line([(1, 2), (99, 2)])) for i in range(10, 40)] + [(50, {"highway": "residential", "name": "Elm St"}, line([(0, 52), (100, 52)]))]
    got = match(spark, city, osm)
    assert {k for k, v in got.items() if v >= entity_match.MATCH} == {(c, o) for c in (1, 2, 3) for o in range(10, 40)} | {(4, 50)}


def test_one_to_one_leaves_one_counterpart(spark):
    road = {"highway": "residential", "name": "Elm Avenue"}
    c = spark.createDataFrame([(4, "ELM AVE", "MINOR", line([(500, 0), (600, 0)]), None)], "objectid long, fullname string, category string, geometry string, loaded_at timestamp")
    o = spark.createDataFrame([(14, road, line([(500, 3), (548, 3)]), None), (15, road, line([(548, 3), (600, 3)]), None)], "way_id long, tags map<string,string>, geometry string, loaded_at timestamp")
    loose = [r.confidence for r in entity_match.match_streets(c, o).collect()]
    strict = [r.confidence for r in entity_match.match_streets(c, o, one_to_one=True).collect()]
    assert min(loose) > 0.9 and len(strict) == 2 and sum(strict) <= 1.02


@pytest.mark.parametrize("where", [(-170.0, 43.0), (180.0, 0.0), (10.0, 89.0)])
def test_candidates_equal_brute_force(spark, where):
    """Every pair of which a station of one line lies beside the other line: the grid loses none."""
    rng, (lon, lat) = random.Random(4), where
    kx = 111_195.08 * math.cos(math.radians(lat))
    place = lambda x, y: [(lon + x / kx + 180) % 360 - 180, lat + y / 111_195.08]

    def lines(first, n):
        out = {}
        for i in range(n):
            x, y, turn, size = rng.uniform(-150, 150), rng.uniform(-150, 150), rng.uniform(0, 2 * math.pi), rng.uniform(20, 150)
            out[first + i] = [place(x + t * size * math.cos(turn + 0.1 * t), y + t * size * math.sin(turn + 0.1 * t)) for t in (0, 0.3, 0.7, 1)]
        return out

    left, right = lines(0, 60), lines(1000, 60)
    table = lambda rows, key: spark.createDataFrame([(i, geo(p)) for i, p in rows.items()], f"{key} long, geometry string")
    got = {(r.c_id, r.o_id) for r in entity_match.candidate_pairs(table(left, "c_id"), table(right, "o_id")).collect()}
    whole = pa_batch(left)
    want, doubt = set(), set()
    for b in entity_match._stations(iter([whole])):
        for s in b.to_pylist():
            across = math.cos(math.radians(s["lat"])) * 111_195.08
            for o, pts in right.items():
                for p, q in zip(pts, pts[1:]):
                    wrap = lambda d: (d + 180) % 360 - 180
                    ex, ey, px, py = wrap(q[0] - p[0]) * across, (q[1] - p[1]) * 111_195.08, wrap(s["lon"] - p[0]) * across, (s["lat"] - p[1]) * 111_195.08
                    size = math.hypot(ex, ey)
                    along, off, turn = (px * ex + py * ey) / size, abs(px * ey - py * ex) / size, abs(s["east"] * ex + s["north"] * ey) / size
                    for out, slack in ((want, -0.01), (doubt, 0.01)):
                        if off <= entity_match.REACH_M + slack and -entity_match.OVERHANG_M - slack <= along <= size + entity_match.OVERHANG_M + slack and turn >= math.cos(math.radians(entity_match.TURN_DEG + slack)):
                            out.add((s["c_id"], o))
    assert len(want) > 50 and want <= got and len(got - doubt) <= len(want) // 50  # long legs are cut, so a bend of the grid may add a pair at the rim


def pa_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array([geo(p) for p in rows.values()])], names=["id", "geometry"])


def test_belief_propagation_is_exact_on_trees(spark):
    """A chain of pairs that compete two by two: marginals by enumeration."""
    odds = [0.5, 1.5, -0.3, 0.8]
    rows = [(1, 101, 1.0, 1.0, [0], [0], odds[0]), (1, 102, 1.0, 1.0, [0], [0], odds[1]), (2, 102, 1.0, 1.0, [0], [0], odds[2]), (2, 103, 1.0, 1.0, [0], [0], odds[3])]
    df = spark.createDataFrame(rows, "c_id long, o_id long, cover double, apart_m double, c_parts array<int>, o_parts array<int>, odds double")
    got = {(r.c_id, r.o_id): r.confidence for r in entity_match.propagate(df).collect()}
    states = [s for s in np.ndindex(2, 2, 2, 2) if s[0] + s[1] < 2 and s[1] + s[2] < 2 and s[2] + s[3] < 2]
    weight = np.array([np.exp(sum(u for u, x in zip(odds, s) if x)) for s in states])
    want = [(weight * [s[k] for s in states]).sum() / weight.sum() for k in range(4)]
    assert [got[r[0], r[1]] for r in rows] == pytest.approx(want, abs=0.02)


def fixed_point(rows):
    """Confidences where one factor of each distinct set of claimants has come to rest: plain loops, heavy damping."""
    factors = {}
    for side, line, parts in ((0, 0, 4), (1, 1, 5)):
        for key in {(r[line], k) for r in rows for k in r[parts]}:
            who = tuple(i for i, r in enumerate(rows) if r[line] == key[0] and key[1] in r[parts])
            if len(who) > 1:
                factors[side, key[0], who] = dict.fromkeys(who, 0.0)
    for _ in range(1500):
        total = [r[6] + sum(f[i] for f in factors.values() if i in f) for i, r in enumerate(rows)]
        fresh = [{i: -math.log1p(sum(math.exp(total[j] - f[j]) for j in f if j != i)) for i in f} for f in factors.values()]
        moved = max(abs(new[i] - f[i]) for f, new in zip(factors.values(), fresh) for i in f)
        for f, new in zip(factors.values(), fresh):
            f.update({i: 0.9 * f[i] + 0.1 * new[i] for i in f})
    assert moved < 1e-6
    return [1 / (1 + math.exp(-r[6] - sum(f[i] for f in factors.values() if i in f))) for i, r in enumerate(rows)]


CLAIMS = "c_id long, o_id long, cover double, apart_m double, c_parts array<int>, o_parts array<int>, odds double"
ALL = [0, 1, 2, 3]


def swinging(first=0, odds=7.0):
    """Two parallel lines against one whole and two half lines, all equally likely."""
    pieces = ((1, ALL), (2, [0, 1]), (3, [2, 3]))
    return [(first + c, first + o, 1.0, 1.0, parts, ALL, odds) for c in (1, 2) for o, parts in pieces]


def test_messages_that_swing_come_to_rest(spark):
    """Several components at once: ones that settle in a few rounds, a long chain, and ones that swing undamped."""
    chain = [(100 + (k + 1) // 2, 100 + k // 2, 1.0, 1.0, ALL, ALL, 0.3 + k % 3) for k in range(40)]
    rows = [*swinging(), *swinging(10, 5.0), *chain, (900, 900, 1.0, 1.0, ALL, ALL, 1.0)]
    got = {(r.c_id, r.o_id): r.confidence for r in entity_match.propagate(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert len(got) == len(rows)
    assert [got[r[:2]] for r in rows] == pytest.approx(fixed_point(rows), abs=0.02)


def test_messages_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(entity_match, "ROUNDS", 5)
    with pytest.raises(RuntimeError, match="6 pairs have not settled"):
        entity_match.propagate(spark.createDataFrame(swinging(), CLAIMS))


def test_parse_lines():
    assert entity_match.parse_lines(None) == [] and entity_match.parse_lines("[1]") == [] and entity_match.parse_lines('{"type":"LineString","coordinates":[[1,2]]}') == []
    swapped = entity_match.parse_lines('{"type":"MultiLineString","coordinates":[[[43,-170,5],[44,-171]],null,[["x",1]]]}')
    assert len(swapped) == 1 and swapped[0].tolist() == [[-170, 43], [-171, 44]]
