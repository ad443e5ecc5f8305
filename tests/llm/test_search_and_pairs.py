"""Exact top-k, SimHash groups, components and image copies against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

from geolark.llm.components import connected_components
from geolark.llm.simhash import byte_triples, fingerprint, keep_one_of_each, linked, simhash_groups
from geolark.llm.queries import ORACLE_SQL, QUERIES
from geolark.llm.vector_topk import exact_top_k, quantized


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = c.execute(ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(x) for x in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in order) for r in result.fetchall())


def test_top_k_ties_nulls_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 1.0]), (10, [-1.0, 0.0])]
    v = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, exact_top_k(v.where("vec_id in (0, 8)"), v, 3).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 3, 32768)]


def test_top_k_blocks_agree(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(-3, 4, (300, 20)) / 4
    rows = [(i, x.tolist()) for i, x in enumerate(m)]
    v = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 7 = 0")
    small = sorted(map(tuple, exact_top_k(q, v, 4, 10, 37).collect()))
    x = np.floor(256 * m).astype(int)
    want = []
    for i in range(0, 300, 7):
        s = sorted((-int(x[i] @ x[j]), j) for j in range(300) if j != i)[:4]
        want += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    assert small == sorted(want)


def test_top_k_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 5), 1.0]) for i in range(20)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    other = plain
    for c in ("v", "query_id", "query_key", "score", "dim", "rank", "qb", "cb", "label"):
        other = other.withColumn(c, F.lit("clash"))
    a, b = (sorted(map(tuple, exact_top_k(quantized(d).where("vec_id < 4"), quantized(d)).collect())) for d in (plain, other))
    assert a == b and len(a) == 20


def test_top_k_of_empty_table(spark):
    v = quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert exact_top_k(v, v).count() == 0


def test_triples_cover_every_four_positions():
    import itertools

    assert len(byte_triples()) == 20
    assert all(any(set(t) <= set(c) for t in byte_triples()) for c in itertools.combinations(range(8), 4))


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "É a  B\x0bc\x1cd e é", "x " * 70_000 + "end"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def components(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        low[root(i)] = min(low.get(root(i), 1 << 64), ids[i])
    return [low[root(i)] for i in range(len(fps))]


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))] for _ in range(60)]
    texts = [None, "", "  "]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = "new"
            texts.append(" ".join(c))
    rng.shuffle(texts)
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = components(fps, [r[0] for r in rows])
    assert got == {r[0]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)}


def test_long_posting_lists_are_cut_without_loss(spark):
    rng = random.Random(1)
    fps = {0xFFFF000000000000}
    while len(fps) < 400:  # chains of near fingerprints that all share bytes
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components([f % (1 << 64) for f in signed], signed)
    for block in (50, 8192):
        got = {r.node: r.component for r in connected_components(linked(frame, 4, block)).collect()}
        assert [got.get(f, f) for f in signed] == want


def test_keep_one_of_each(spark):
    rows = [(5, "a b c d e", "s"), (2, "a b c d e", "s"), (2, "a b c d e", "s"), (9, None, "t"), (None, "", "t"), (7, "q r s t u", None)]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"] and sorted(r.doc_id for r in got.collect()) == [2, 7, 9]
    assert keep_one_of_each(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_every_group_keeps_a_row(spark):
    # unrelated documents without an id, and an id that stands in several groups
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    rows = [(None, texts[0], "s"), (None, texts[1], "s"), (None, texts[1], "t"), (8, texts[2], "s"), (None, texts[2], "s"), (3, texts[3], "s"), (3, texts[4], "s"), (4, texts[4], "s"), (None, texts[5], None), (None, texts[5], None)]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.text, r.doc_id) for r in got), key=str) == [(texts[0], None), (texts[1], None), (texts[2], 8), (texts[3], 3), (texts[4], 3), (texts[5], None)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for n in sorted(near):
        if n in seen:
            continue
        stack, group = [n], set()
        while stack:
            x = stack.pop()
            if x not in group:
                group.add(x)
                stack += near[x]
        seen |= group
        want |= {x: min(group) for x in group}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {n for n in near if near[n] <= {n}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
