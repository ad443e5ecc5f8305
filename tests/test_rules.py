"""Hand-made cases at, below and above the rules' borders."""

import math

import pytest
from pyspark.sql import functions as F

from geolark.functions import geo, suitability as J, text as X
from geolark.operators import catalog, matches, raster, similarity, tiles, zonal
from geolark.schema import GridMeta

M = GridMeta(50, 10)


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (J.pair_stability, {0.95: "minimal", 0.9499: "slight", 0.9: "slight", 0.8999: "moderate", 0.8: "moderate", 0.7999: "significant"}),
        (J.overall_stability, {0.95: "highly_stable", 0.94: "stable", 0.9: "stable", 0.89: "moderate_change", 0.8: "moderate_change", 0.79: "significant_change"}),
        (J.pooling_risk, {4.99: "LOW", 5.0: "MODERATE", 6.99: "MODERATE", 7.0: "HIGH", 8.99: "HIGH", 9.0: "SEVERE"}),
        (J.high_risk_percent, {4.99: 5.0, 5.0: 15.0, 7.0: 35.0, 9.0: 60.0}),
        (J.water_assessment, {301.0: "surplus", 300.0: "marginal", 0.1: "marginal", 0.0: "slight", -200.0: "moderate", -199.9: "slight", -500.0: "severe", -499.0: "moderate"}),
        (J.irrigation_needed, {0.1: False, 0.0: True, -1.0: True}),
        (J.moisture_index, {-20.0: 0.0, -25.0: 0.0, -5.0: 1.0, 3.0: 1.0, -12.5: 0.5}),
        (J.moisture_status, {0.19: "DRY", 0.2: "MODERATELY_DRY", 0.4: "OPTIMAL", 0.6: "WET", 0.8: "SATURATED"}),
        (J.compass, {0.0: "N", 22.49: "N", 22.5: "NE", 67.5: "E", 112.5: "SE", 157.5: "S", 202.5: "SW", 247.5: "W", 292.5: "NW", 337.49: "NW", 337.5: "N"}),
        (J.heat_stress_level, {0.29: "LOW", 0.3: "MODERATE", 0.5: "HIGH", 0.7: "SEVERE"}),
        (J.suitability_level, {3.5: "EXCELLENT", 3.49: "GOOD", 2.5: "GOOD", 2.49: "MODERATE", 1.5: "MODERATE", 1.49: "POOR"}),
        (J.match_quality, {0.9: "EXCELLENT", 0.89: "GOOD", 0.8: "GOOD", 0.79: "MODERATE", 0.7: "MODERATE", 0.69: "LOW"}),
        (J.match_confidence, {0.9: "HIGH", 0.8: "MEDIUM", 0.7: "LOW", 0.69: "VERY LOW"}),
        (J.signal_verdict, {1.51: "GOOD", 1.5: "MODERATE", 1.11: "MODERATE", 1.1: "WEAK"}),
        (J.rank_verdict, {90.1: "EXCELLENT", 90.0: "GOOD", 75.0: "MODERATE", 50.0: "POOR"}),
    ],
)
def test_steps(spark, f, cases):
    assert values(spark, f(F.col("x")), list(cases), "x double") == list(cases.values())


@pytest.mark.parametrize(("aspect", "lat", "want"), [(225.0, 10.0, 1.0), (314.9, 30.0, 0.8), (315.0, 20.0, 0.7), (202.5, 20.0, 0.7), (157.5, 20.0, 0.5), (157.5, -20.0, 0.3), (45.0, 20.0, 0.2), (135.0, 20.0, 0.3), (135.0, 0.0, 0.6), (0.0, -30.0, 0.4)])
def test_heat_stress(spark, aspect, lat, want):
    assert values(spark, J.heat_stress_index(F.col("a"), F.col("l")), [(aspect, lat)], "a double, l double")[0] == pytest.approx(want)


def test_soil_defaults_and_classes(spark):
    f = J.soil(*[F.col(c) for c in "abcdef"])
    got = values(spark, f, [(None,) * 6, (0.0, 10.0, 1.0, 710.0, 900.0, 5.0), (50.0, 10.0, 1.0, 700.0, 401.0, 5.0), (50.0, 31.0, 1.0, 0.0, 400.0, 5.0)], "a double, b double, c double, d double, e double, f double")
    assert [(r.ph, r.soil_type, r.drainage) for r in got] == [(6.5, "Loam", "Moderate"), (6.5, "Sandy", "Excessive"), (5.0, "Clay", "Poor"), (5.0, "Organic-rich Loam", "Good")]


@pytest.mark.parametrize(("lat", "lng", "want"), [(70.0, -180.0, (0, 0)), (-60.0, 180.0, (9, 49)), (70.01, 0.0, None), (-60.01, 0.0, None), (0.0, 180.01, None), (0.0, -180.01, None), (56.9, -172.7, (1, 1)), (57.01, -172.81, (0, 0))])
def test_cells_of_points(spark, lat, lng, want):
    c = values(spark, geo.row_col(F.col("a"), F.col("b"), M), [(lat, lng)], "a double, b double")[0]
    assert (tuple(c) if c else None) == want


def test_clamped_cells(spark):
    assert [tuple(c) for c in values(spark, geo.row_col(F.col("a"), F.col("b"), M, clamp=True), [(90.0, -999.0), (-90.0, 999.0)], "a double, b double")] == [(0, 0), (9, 49)]


def test_regions_change_at_thirty_degrees(spark):
    got = values(spark, geo.region_bucket(F.col("a"), F.col("b")), [(-0.1, 0.0), (0.0, 0.0), (29.9, -0.1), (30.0, 30.0)], "a double, b double")
    assert got == [30, 42, 41, 55]


def test_tiles_tessellate(spark):
    t = spark.range(4).select(F.lit(2).alias("z"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"), geo.tile_bounds(F.lit(2), F.col("id"), F.lit(1)).alias("b"), geo.tile_bounds(F.lit(2), F.col("id"), F.lit(2)).alias("below")).orderBy("x").collect()
    assert [r.b.east for r in t][:-1] == [r.b.west for r in t][1:] and t[0].b.west == -180 and t[-1].b.east == 180
    assert all(r.b.south == r.below.north for r in t) and abs(t[0].b.south) < 1e-12


def test_ramp(spark):
    got = {r.id: tuple(r.c) for r in spark.range(256).select("id", geo.ramp_colour(F.col("id")).alias("c")).collect()}
    assert got[140] == (0, 0, 0, 0) and got[141] == (200, 180, 50, 60) and got[166] == got[167] == (240, 200, 30, 140) and got[255] == (180, 15, 30, 255)
    assert values(spark, geo.ramp_index(F.col("x")), [-1.0, 0.0, 0.999, 1.0, 2.0], "x double") == [0, 0, 254, 255, 255]


def test_quantise_round_trip_and_constant_bands(spark):
    rows = [(i, i // 2, i % 2, i != 5, [float(i), 7.0, -i / 3]) for i in range(8)]
    cells = spark.createDataFrame(rows, "pixel long, row int, col int, is_land boolean, e array<double>")
    ranges = raster.band_ranges(cells)
    scale = {r.band: r.scale for r in ranges.collect()}
    q = raster.quantize(cells, ranges)
    assert all(r.q[1] == 0 and min(r.q) >= -127 and max(r.q) <= 127 for r in q.collect()) and q.count() == 7
    for r in raster.dequantize(q, ranges).collect():
        assert all(abs(a - b) <= scale[k] / 2 + 1e-9 for k, (a, b) in enumerate(zip(r.restored, r.e, strict=True)))


def test_scan_ties_and_modes(spark):
    cells = spark.createDataFrame([(0, True, [1, 0]), (1, True, [-1, -1]), (2, False, [9, 9])], "pixel long, is_land boolean, q array<int>")
    pins = spark.createDataFrame([(3, [1, 0]), (1, [1, 0]), (2, [0, 5])], "pin_idx int, q array<int>")
    assert sorted(map(tuple, similarity.scan(cells, pins).drop("score").collect())) == [(0, 1, 1), (1, -1, 1)]
    assert sorted(map(tuple, similarity.scan(cells, pins, online=True).drop("score").collect())) == [(0, 1, 1), (1, 0, 0)]
    assert sorted(map(tuple, similarity.scan_arrow(cells, pins).drop("score").collect())) == [(0, 1, 1), (1, -1, 1)]
    assert similarity.scan(cells, pins.limit(0)).count() == 0
    assert similarity.scan_arrow(cells, pins.limit(0)).count() == 0


def test_too_many_pins_are_refused(spark):
    cells = spark.createDataFrame([(0, True, [1])], "pixel long, is_land boolean, q array<int>")
    pins = spark.range(51).select(F.col("id").cast("int").alias("pin_idx"), F.array(F.lit(1)).alias("q"))
    with pytest.raises(Exception, match="too many pins"):
        similarity.scan(cells, pins).collect()


def test_candidates_of_a_large_raster_are_whole(spark):
    big = GridMeta(4000, 1500)  # six million cells
    pins = spark.createDataFrame([(0, 85.0, 0.0)], "pin_idx int, lat double, lng double")
    scores = spark.createDataFrame([(i, 0.99, 0) for i in range(1, 14)], "pixel long, score double, best_pin int")
    assert matches.candidates(scores, pins, big).count() == 13
    assert matches.candidates(scores, pins, big, step=matches.sample_step(big)).count() == 2


def test_greedy_matches_keep_their_rules(spark):
    import random

    rng = random.Random(3)
    rows = [(p, p // 50, p % 50, rng.random(), rng.randrange(4)) for p in range(500)]
    pool = spark.createDataFrame(rows, "pixel long, row int, col int, score double, best_pin int")
    got = matches.top_matches(pool, M, 12).collect()
    want, pins, regions = [], {}, {}
    for p, r, c, s, b in sorted(rows, key=lambda x: (-x[3], x[0])):
        lat, lng = 70 - (r + 0.5) * 13, -180 + (c + 0.5) * 7.2
        region = (math.floor(lat / 30) + 3) * 12 + math.floor(lng / 30) + 6
        if len(want) == 12 or any(abs(r - y) + abs(c - x) < 2 for y, x in want) or pins.get(b, 0) >= 2 or regions.get(region, 0) >= 3:
            continue
        want.append((r, c))
        pins[b], regions[region] = pins.get(b, 0) + 1, regions.get(region, 0) + 1
    assert [r.pixel for r in got] == [y * 50 + x for y, x in want] and len(got) == 8
    assert matches.top_matches(pool.limit(0), M, 5).count() == 0
    assert matches.top_matches(pool, M, 12, head=1).collect() == got  # heads too short at first


def test_merges_take_whole_records(spark):
    from geolark.operators import catalog

    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, w string")
    right = spark.createDataFrame([(2, "c", None), (3, None, "t")], "k int, v string, w string")
    assert sorted(map(tuple, catalog.merge_keyed(left, right, "k").collect()), key=str) == sorted([(1, "a", "x"), (2, "c", None), (3, None, "t"), (None, "n", "z")], key=str)
    now = spark.createDataFrame([(1, True)], "k int, is_featured boolean")
    new = spark.createDataFrame([(1, False), (1, False), (2, False), (2, True), (None, True)], "k int, is_featured boolean")
    assert sorted(map(tuple, catalog.upsert(now, new, "k").collect())) == [(1, True), (2, True)]
    assert sorted(map(tuple, catalog.insert_missing(now, new, ["k"]).collect())) == [(1, True), (2, True)]


def test_tile_tree(spark, tmp_path):
    """Tiles written as files, read again, decoded, against the coloured pixels."""
    import zlib

    scores = spark.createDataFrame([(p, (p % 97) / 97) for p in range(500) if p % 5], "pixel long, score double")
    wanted = tiles.tile_list(spark, [0, 1], M)
    coloured = tiles.tile_rgba(tiles.tile_scores(wanted, scores, M, 16))
    images = tiles.tile_png(wanted, scores, M, 16)
    done = tiles.write_tile_tree(images, str(tmp_path / "tree"), "coffee").collect()
    assert (tmp_path / "tree/coffee/1/1/0.png").is_file() and len(done) == wanted.count() == 5
    want: dict = {}
    for r in coloured.collect():
        want.setdefault((r.z, r.x, r.y), {})[r.py, r.px] = (r.r, r.g, r.b, r.a)
    for r in tiles.read_tile_tree(spark, str(tmp_path / "tree")).collect():
        assert r.layer == "coffee"
        image = bytes(r.png)
        at = image.index(b"IDAT")
        raw = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
        for (py, px), colour in want[r.z, r.x, r.y].items():
            assert tuple(raw[py * 65 + 1 + 4 * px : py * 65 + 5 + 4 * px]) == colour
    tops = {(r.z, r.x, r.y): r.top for r in tiles.tile_tops(wanted, scores, M, 16).collect()}
    flat = {(r.z, r.x, r.y): r.top for r in tiles.tile_scores(wanted, scores, M, 16).groupBy("z", "x", "y").agg({"score": "max"}).withColumnRenamed("max(score)", "top").collect()}
    assert tops == flat


def test_tile_tree_commits_whole_attempts_only(spark, tmp_path):
    import pyarrow as pa
    import pytest

    image = lambda n: tiles.png(bytes([n, 0, 0, 255]), 1, 1)
    batch = lambda ys, n: pa.RecordBatch.from_pylist([{"z": 1, "x": 0, "y": y, "png": image(n)} for y in ys])
    root = tmp_path / "layer"

    def cut_off():
        yield batch([0, 1], 9)
        raise RuntimeError("lost")

    writer = tiles.TileTreeWriter(str(root))
    with pytest.raises(RuntimeError):
        writer.write(cut_off())
    writer.write(iter([batch([0, 1], 8)]))  # ended, but another attempt of the task counts
    writer.commit([writer.write(iter([batch([0], 1)])), None])
    files = lambda: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert files() == {"1/0/0.png": image(1)}
    again = tiles.TileTreeWriter(str(root))
    again.write(iter([batch([5], 7)]))
    again.abort([])
    assert files() == {"1/0/0.png": image(1)}
    rows = spark.createDataFrame([(1, 0, 1, bytearray(image(2))), (2, 3, 1, bytearray(image(3)))], "z int, x int, y int, png binary")
    with pytest.raises(Exception, match="no more"):
        from pyspark.sql import functions as F

        tiles.write_tile_tree(rows.withColumn("png", F.when(F.col("z") == 2, F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("png"))), str(tmp_path), "layer")
    assert files() == {"1/0/0.png": image(1)}
    assert tiles.write_tile_tree(rows, str(tmp_path), "layer").count() == 2
    assert files() == {"1/0/1.png": image(2), "2/3/1.png": image(3)}


def test_png_is_readable():
    import struct
    import zlib

    image = tiles.png(bytes(range(16)), 2, 2)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (2, 2)
    n = struct.unpack(">I", image[33:37])[0]
    assert zlib.decompress(image[41 : 41 + n]) == b"\0" + bytes(range(8)) + b"\0" + bytes(range(8, 16))


def test_missing_tiles_are_transparent(spark):
    wanted = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "z int, x int, y int")
    have = spark.createDataFrame([(0, 0, 0, b"x")], "z int, x int, y int, png binary")
    assert {r.z: bytes(r.png) for r in tiles.served(wanted, have).collect()} == {0: b"x", 1: tiles.TRANSPARENT}


def test_names_and_coordinates(spark):
    f = X.place_name([F.col("a"), F.col("b")], [F.col("c")], F.col("d"), F.col("e"), F.lit(1.234), F.lit(-5.0))
    rows = [("", "Town", "R", "L", ""), (None, "", "R", "L", ""), (None, None, "", "L", ""), ("T", "", "", "", "One , Two, Three"), ("", "", "", "", "One"), ("", "", "", "", "")]
    assert values(spark, f, rows, "a string, b string, c string, d string, e string") == ["Town, L", "R, L", "L", "One,Two", "One", "1.23, -5.00"]
    got = values(spark, X.coordinates(F.col("q")), ["5.77, -75.77", "5.77 -75.77", "91, 0", "0, 181", "abc", "5", None], "q string")
    assert [tuple(x) if x else None for x in got] == [(5.77, -75.77), (5.77, -75.77), None, None, None, None, None]


def test_request_checks(spark):
    pin = "pins array<struct<lat:double,lng:double>>"
    got = values(spark, X.pins_problem(F.col("pins")), [([],), (None,), ([(0.0, 0.0)] * 50,), ([(0.0, 0.0)] * 51,), ([(90.1, 0.0)],), ([(0.0, -180.1)],)], pin)
    assert got == ["no pins", "no pins", None, "too many pins", "latitude out of range", "longitude out of range"]
    t = values(spark, X.map_text(F.col("a"), F.col("b"), F.col("c")), [("", "", ""), ("x" * 255, "y" * 2000, "z" * 101), ("x" * 256, "", "a"), ("x", "y" * 2001, None)], "a string, b string, c string")
    assert [(r.ok, r.author[:12], len(r.author)) for r in t] == [(False, "anonymous", 9), (True, "z" * 12, 100), (False, "a", 1), (False, "anonymous", 9)]
    assert values(spark, X.is_slug(F.col("a")), ["a-B_9", "a/b", "", "x" * 101, None], "a string") == [True, False, False, False, False]


def test_catalogue(spark):
    now = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, title string, is_featured boolean")
    new = spark.createDataFrame([(2, "B", True), (3, "c", True)], now.schema)
    assert sorted(map(tuple, catalog.upsert(now, new, "id").collect())) == [(1, "a", True), (2, "B", False), (3, "c", True)]
    assert sorted(map(tuple, catalog.insert_missing(now, new, ["id"]).collect())) == [(1, "a", True), (2, "b", False), (3, "c", True)]
    assert sorted(r.id for r in catalog.search(now.withColumn("category", F.lit("Xy")), "xY").collect()) == [1, 2]


def test_clearest_image_per_interval(spark):
    import datetime

    day = lambda n: datetime.datetime(2023, 1, n)
    rows = [(1, day(1), 50), (2, day(5), 10), (3, day(6), 90), (4, day(10), 90), (5, day(21), 1)]
    got = zonal.clearest_per_interval(spark.createDataFrame(rows, "id long, ts timestamp, cloud int"), "ts", "cloud", "2023-01-01", 5, "id")
    assert sorted((r.interval, r.id) for r in got.collect()) == [(0, 2), (1, 3), (4, 5)]


def test_buffer(spark):
    near = zonal.in_buffer(F.col("a"), F.col("b"), 10.0, 20.0, 50.0)
    assert values(spark, near, [(10.0, 20.0), (10.4, 20.0), (10.5, 20.0), (10.0, 20.45), (10.0, 20.5)], "a double, b double") == [True, True, False, True, False]


def test_stable_uuid(spark):
    import uuid

    names = ["layer1", "", "é", *(f"x{i}" for i in range(40))]
    assert values(spark, X.stable_uuid(F.col("a")), names, "a string") == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_distinct_pins(spark):
    def kept(pins):
        df = spark.createDataFrame([([{"lat": a, "lng": b} for a, b in pins],)], "pins array<struct<lat:double,lng:double>>")
        return [(p.lat, p.lng) for p in df.select(X.distinct_pins(df["pins"]).alias("p")).first().p]

    assert kept([(0.0, 0.0), (0.009, 0.009), (0.011, 0.0), (0.005, 0.02)]) == [(0.0, 0.0), (0.011, 0.0), (0.005, 0.02)]
    assert len(kept([(float(i), 0.0) for i in range(60)])) == 50 and kept([]) == []


def test_score_bands(spark):
    assert values(spark, X.score_band(F.col("x")), [0.81, 0.8, 0.66, 0.65], "x double") == ["strong", "good", "good", "fair"]


def test_two_decimals_are_those_of_the_exact_value(spark):
    import random

    rng = random.Random(5)
    known = [0.125, 0.375, -0.125, 1.005, 24.325, 72.345, 0.005, 0.015, 0.994999, 0.995, 0.999, -0.001, -0.0, 0.0, 1e12 + 0.125, 99999.995, 1e-300, 4e15, None]
    xs = known + [rng.randint(-10**7, 10**7) / 1000 for _ in range(3000)] + [rng.uniform(-200, 200) for _ in range(500)] + [rng.randint(0, 1000) / 10000 for _ in range(500)]
    got = values(spark, X.two_decimals(F.col("x")), xs, "x double")
    assert got == [None if x is None else "%.2f" % x for x in xs]
    point = X.place_name([F.lit("")], [F.lit("")], F.lit(""), F.lit(""), F.col("x"), F.lit(0.25))
    assert values(spark, point, [24.325, -0.125, None], "x double") == ["24.32, 0.25", "-0.12, 0.25", None]
