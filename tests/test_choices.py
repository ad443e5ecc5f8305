"""Greedy matches and exact quantiles against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from geolark.functions.geo import region_bucket
from geolark.operators import matches
from geolark.operators.quantiles import exact_quantiles
from geolark.schema import GridMeta


def greedy(rows, gap, count, per_pin, per_region):
    taken, pins, regions = [], Counter(), Counter()
    for score, pixel, row, col, pin, region in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(taken) < count and pins[pin] < per_pin and regions[region] < per_region and all(abs(row - t[2]) + abs(col - t[3]) >= gap for t in taken):
            taken.append((score, pixel, row, col))
            pins[pin] += 1
            regions[region] += 1
    return [t[1] for t in taken]


@pytest.mark.parametrize(("peaks", "per_pin", "per_region"), [(1, 2, 3), (3, 4, 2), (1, 20, 20)])
def test_smooth_raster(spark, monkeypatch, peaks, per_pin, per_region):
    from pyspark.sql import functions as F

    from geolark.functions.geo import centre_lat, centre_lng

    meta = GridMeta(240, 120)
    spacing = 25 * meta.cell_w * 111.0
    height = lambda r, c: max(1 - math.hypot(r - 40 - 30 * k, c - 60 - 50 * k) / 200 for k in range(peaks))
    rows = [(r * 240 + c, r, c, round(height(r, c), 6), (r // 20 + c // 40) % 10) for r in range(120) for c in range(240)]
    df = spark.createDataFrame(rows, "pixel long, row int, col int, score double, best_pin int")
    seen = []
    plain = matches._greedy
    monkeypatch.setattr(matches, "_greedy", lambda found, *a: seen.append(len(found)) or plain(found, *a))
    got = [r.pixel for r in matches.top_matches(df, meta, 20, spacing + 1, per_pin, per_region).orderBy("rank").collect()]
    regions = {r.pixel: r.g for r in df.select("pixel", region_bucket(centre_lat(F.col("row"), meta), centre_lng(F.col("col"), meta)).alias("g")).collect()}
    want = greedy([(s, p, r, c, pin, regions[p]) for p, r, c, s, pin in rows], 25, 20, per_pin, per_region)
    assert got == want
    groups = len({(pin, regions[p]) for p, _, _, _, pin in rows})
    assert len(seen) <= 21 and max(seen) <= groups * 4


def test_no_candidates(spark):
    df = spark.createDataFrame([], "pixel long, row int, col int, score double, best_pin int")
    assert matches.top_matches(df, GridMeta(10, 10)).count() == 0


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles(spark, bins):
    rng = random.Random(bins)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(201)], "b": [7.0] * 30, None: [float(rng.randint(0, 3)) for _ in range(50)], "c": [1e-300, 1e300, -1e300, 0.0, 5e-324], "d": [1.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), ("a", math.inf), ("e", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "zone string, v double")
    p = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "v", p, "zone", bins)
    assert "ercentile" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r.zone: tuple(r)[1:] for r in got.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        assert got[g][1:] == pytest.approx(tuple(np.quantile(np.array(vs), p)), rel=1e-12)
    whole = exact_quantiles(df.where("zone = 'a'"), "v", [0.5], bins=bins).first()
    assert whole == (201, sorted(groups["a"])[100])
    assert exact_quantiles(df.where("false"), "v", [0.5]).count() == 0
