"""Vector index and pair statistics against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolark.operators import validation, vector_index


def clustered(n, dims=8, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=0.3, size=(n, dims))


def exact(rows, asked, k, groups):
    out = []
    for i in asked:
        s = []
        for j, v in rows.items():
            if j != i and (groups is None or groups[i] == groups[j]):
                s.append((-round(float(np.dot(rows[i], v) / math.sqrt(np.dot(rows[i], rows[i])) / math.sqrt(np.dot(v, v))), 9), j))
        out += [(i, n + 1, j, -a) for n, (a, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_index_with_all_lists_is_exact_and_probes_find_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    m = clustered(600)
    groups = {i: "ab"[i % 2] for i in range(600)}
    rows = spark.createDataFrame([(i, groups[i], v.tolist()) for i, v in enumerate(m)] + [(900, "a", None), (901, "a", [0.0] * 8), (902, "b", [1.0] * 7), (903, "b", [math.nan] * 8)], "id long, grp string, v array<double>")
    path = str(tmp_path / "index")
    vector_index.build_index(rows, path, 8, lists=12, train=200)
    asked = rows.where("id % 20 = 0 or id > 900").select(F.col("id").alias("query_id"), "grp", "v")
    plain = dict(enumerate(m))
    found = lambda q, probes: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in vector_index.search(spark, path, q, 5, probes).collect())
    assert found(asked, 12) == exact(plain, range(0, 600, 20), 5, groups)
    everywhere = asked.withColumn("grp", F.lit(None).cast("string"))
    whole = exact(plain, range(0, 600, 20), 5, None)
    assert found(everywhere, 12) == whole
    some = vector_index.search(spark, path, everywhere, 5, 3)
    truth = spark.createDataFrame(whole, "query_id long, rank int, id long, similarity double")
    assert vector_index.recall(some, truth).first()[0] >= 0.9
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.agg(F.sum(F.size("ids")), F.max(F.size("ids"))).first() == (600, 16)
    assert vector_index.search(spark, path, everywhere.where("false")).count() == 0


def test_probed_lists_are_all_that_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(clustered(100))], "id long, grp string, v array<double>")
    path = str(tmp_path / "index")
    vector_index.build_index(rows, path, 8, lists=5)
    plan = vector_index.search(spark, path, rows.limit(1).select(F.col("id").alias("query_id"), "grp", "v"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block", [3, 512])
def test_pair_statistics(spark, monkeypatch, block):
    monkeypatch.setattr(validation, "BLOCK", block)
    rng = random.Random(1)
    q = lambda: [rng.randint(-127, 127) for _ in range(64)]
    farms, others = [(i, q()) for i in range(11)], [(100 + i, q()) for i in range(7)]
    farms.append((50, farms[0][1]))
    others.append((200, farms[1][1]))
    f, o = (spark.createDataFrame(x, "id long, q array<int>") for x in (farms, others))
    packed = validation.blocks(f, block)
    dot = lambda a, b: int(np.dot(a, b))
    pairs = [dot(a[1], b[1]) for i, a in enumerate(farms) for b in farms[:i]]
    base = [dot(a[1], b[1]) for a in farms for b in others]
    for counts, moments, want in ((validation.pair_counts(f), validation.pair_moments(f), pairs), (validation.baseline_counts(f, o), validation.baseline_moments(f, o), base)):
        s = validation.summary(counts, moments)
        assert tuple(s.first()) == pytest.approx((len(want), round(float(np.mean(want)), 4), round(float(np.std(want)), 4), min(want), max(want), round(float(np.median(want)), 4)))
        plan = s._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = []
    for i, v in farms:
        order = sorted([(-dot(v, w), False, j) for j, w in farms if j != i] + [(-dot(v, w), True, j) for j, w in others])
        ranks = [n for n, x in enumerate(order) if not x[1]]
        mean = sum(ranks) / len(ranks)
        want.append((i, round(mean, 4), min(ranks), round(100 * (1 - mean / len(order)), 4)))
    loo = validation.leave_one_out(f, o)
    assert np.allclose(sorted(map(tuple, loo.collect())), sorted(want), atol=1e-4)
    plan = loo._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
    assert packed[1] >= 1


def test_pair_statistics_of_too_few(spark):
    none = spark.createDataFrame([], "id long, q array<int>")
    one = spark.createDataFrame([(1, [1] * 64)], "id long, q array<int>")
    for f in (none, one):
        assert tuple(validation.summary(validation.pair_counts(f), validation.pair_moments(f)).first()) == (0, None, None, None, None, None)
        assert validation.leave_one_out(f, none).count() == 0
    assert tuple(validation.baseline_moments(one, none).first()) == (0, None, None)


def test_pairs_of_a_block_that_is_packed_twice_in_different_orders(spark, monkeypatch):
    """Shuffled rows arrive in any order, so the two sides of a join may hold a block's farms in different ones."""
    m = np.random.default_rng(3).integers(-127, 128, (30, 4))
    monkeypatch.setattr(validation, "BLOCK", 8)
    farms = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, q array<int>")
    meet = validation.block_pairs

    def turned(packed, count, ordered):
        turn = F.udf(lambda cell, n: np.frombuffer(cell, "<i2").reshape(n, -1)[::-1].tobytes(), "binary")
        pairs = meet(packed, count, ordered)
        return pairs.withColumn("other_m", turn("other_m", F.size("other_ids"))).withColumn("other_ids", F.reverse("other_ids"))

    monkeypatch.setattr(validation, "block_pairs", turned)
    products = np.sort((m @ m.T)[np.triu_indices(30, 1)])
    values, n = np.unique(products, return_counts=True)
    assert sorted(map(tuple, validation.pair_counts(farms).collect())) == list(zip(values.tolist(), n.tolist(), strict=True))
