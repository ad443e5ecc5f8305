"""Z-order, buckets and NumPy files: what is read and written."""

import os
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from geolark.operators import buckets, catalog, zorder
from geolark.schema import GridMeta
from geolark.sources import tables as S


def interleaved(row, col):
    return sum((row >> i & 1) << 2 * i + 1 | (col >> i & 1) << 2 * i for i in range(31))


def test_codes_and_ranges(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(1 << rng.randint(1, 31)), rng.randrange(1 << rng.randint(1, 31))) for _ in range(200)] + [(0, 0), ((1 << 31) - 1, (1 << 31) - 1)]
    df = spark.createDataFrame(pairs, "row int, col int")
    assert all(r.z == interleaved(r.row, r.col) for r in df.withColumn("z", zorder.zcode(F.col("row"), F.col("col"))).collect())
    for _ in range(60):
        a, b = sorted(rng.sample(range(64), 2))
        c, d = sorted(rng.sample(range(64), 2))
        ranges = zorder.box_ranges(a, b, c, d, rng.choice([8, 32, 1000]))
        codes = {x for lo, hi in ranges for x in range(lo, hi + 1)}
        want = {interleaved(r, k) for r in range(a, b + 1) for k in range(c, d + 1)}
        assert want <= codes and all(p[1] < q[0] for p, q in zip(ranges, ranges[1:], strict=False))
    assert {x for lo, hi in zorder.box_ranges(3, 9, 5, 8, 1000) for x in range(lo, hi + 1)} == {interleaved(r, k) for r in range(3, 10) for k in range(5, 9)}
    assert zorder.box_ranges(3, 2, 0, 5) == [] and len(zorder.box_ranges(1, 1 << 30, 1, 1 << 30)) <= zorder.MOST_RANGES


def test_box_reads_few_row_groups(spark, tmp_path):
    meta = GridMeta(256, 256)
    path = str(tmp_path / "z")
    cells = S.synthetic_cells(spark, meta)
    zorder.write_zordered(cells, path, 1 << 16)
    got = zorder.read_box(spark, path, 100, 110, 30, 45)
    assert sorted(r.pixel for r in got.select("pixel").collect()) == sorted(r * 256 + c for r in range(100, 111) for c in range(30, 46))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(zcode" in plan
    ranges = zorder.box_ranges(100, 110, 30, 45)
    hit = total = 0
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta_ = pq.ParquetFile(f"{path}/{name}").metadata
            at = meta_.schema.to_arrow_schema().names.index("zcode")
            for i in range(meta_.num_row_groups):
                group = meta_.row_group(i)
                stats = next(group.column(k).statistics for k in range(group.num_columns) if group.column(k).path_in_schema == "zcode")
                total += 1
                hit += any(lo <= stats.max and stats.min <= hi for lo, hi in ranges)
    assert at >= 0 and total >= 16 and hit <= total / 4
    near = zorder.read_buffer(spark, path, meta, 0.0, 179.0, 300.0)
    assert 0 < near.count() < 2000


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"old {i}", i % 2 == 0) for i in range(300)], "id long, title string, is_featured boolean")
    buckets.create(rows, path, ["id"], 16)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    new = spark.createDataFrame([(5, "new", True), (1000, "new", True)], "id long, title string, is_featured boolean")
    touched = buckets.merge(spark, path, new, lambda now, more: catalog.upsert(now, more, "id"))
    assert 1 <= len(touched) <= 2
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("_bucket=")[1].split("/")[0] for f in before if f not in same} == {str(b) for b in touched}
    got = {r.id: (r.title, r.is_featured) for r in buckets.read(spark, path).collect()}
    assert len(got) == 301 and got[5] == ("new", False) and got[1000] == ("new", True) and got[6] == ("old 6", True)
    assert buckets.merge(spark, path, new.where("false"), lambda now, more: now) == []
    assert sorted(catalog.upsert(rows, new, "id").collect()) == sorted(buckets.read(spark, path).select("id", "title", "is_featured").collect())


def test_npy(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 64)).astype(np.float32)
    rows = [(i, None if i == 7 else v[i].tolist()) for i in range(50)]
    S.write_npy(spark.createDataFrame(rows, "id long, e array<float>").repartition(3), str(tmp_path / "n"), "e")
    names = sorted(os.listdir(tmp_path / "n"))
    assert names and all(n.endswith(".npy") for n in names)
    ids = np.concatenate([np.load(tmp_path / "n" / n) for n in names if n.startswith("ids")])
    both = np.concatenate([np.load(tmp_path / "n" / n) for n in names if n.startswith("vectors")])
    assert sorted(ids.tolist()) == [i for i in range(50) if i != 7] and (both == v[ids]).all()
    assert {r.id: r.v for r in S.read_npy(spark, str(tmp_path / "n")).collect()} == {i: v[i].tolist() for i in range(50) if i != 7}
