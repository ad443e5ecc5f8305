"""Jaccard classes against all pairs, and the tree against plain bounds."""

import random

import numpy as np
import pytest

from geolark.llm import jaccard
from geolark.llm.jaccard import CountTree, jaccard_groups, links_within, point_of, possible_links, shingle_set

SCHEMA = "doc_id long, text string"


def plain(rows, percent=80, shingle=5):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in w.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def near_copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 150))]
        if g % 3 == 0:
            base += passage
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            out.append(rng.choice([" ", "\n", "  "]).join(w))
    rng.shuffle(out)
    return out


EDGES = [None, "", " \t\n", "one", "One", "one two three", "one  two\tTHREE", "a b c d e", "a b c d e", "A B C D É", "a b c d é", "a b c d e f"]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs(spark, seed):
    rows = list(enumerate(near_copies(seed) + EDGES))
    rows += rows[3:8] + [(None, rows[0][1]), (None, None), (5, rows[40][1])]
    random.Random(seed).shuffle(rows)
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_blocks_agree(spark, monkeypatch):
    rows = list(enumerate(near_copies(2, groups=6, size=20)))
    monkeypatch.setattr(jaccard, "TREE_ROWS", 7)
    monkeypatch.setattr(jaccard, "SET_HASHES", 300)
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_hot_copies_long_text_other_columns_and_no_rows(spark):
    from pyspark.sql import functions as F

    long_one = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, "the same text again and again " * 3) for i in range(400)] + [(1000, long_one), (900, long_one.replace("w5 ", "other ")), (1, "alone in here with five")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("rid", "n", "k1", "h", "leader", "cell", "node", "low", "component_id", "r1", "r2"):
        df = df.withColumn(c, F.lit("clash"))
    got = jaccard_groups(df).collect()
    assert len(got) == 403 and {r["component_id"] for r in got if r["doc_id"] >= 900} == {900}
    assert sum(r["component_id"] == 0 for r in got) == 400
    assert jaccard_groups(df.where("false")).count() == 0


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    n, counts = [], []
    for _ in range(40):
        base = rng.integers(0, 6, jaccard.GROUPS)
        for _ in range(12):
            c = np.maximum(0, base + (rng.random(jaccard.GROUPS) < 0.1) * rng.integers(-3, 4, jaccard.GROUPS))
            counts.append(c.astype(np.uint32))
            n.append(int(c.sum()))
    n, counts = np.array(n), np.stack(counts)
    tree = CountTree(n, counts)
    for i in range(0, len(n), 7):
        shared = np.minimum(counts, counts[i]).sum(1).astype(int)
        want = {j for j in range(len(n)) if j != i and 180 * shared[j] >= 80 * (n[i] + n[j])}
        assert set(tree.found(i).tolist()) == want
    some = {x for pair in possible_links(np.arange(len(n)), n, counts) for x in pair}
    assert some == {i for i in range(len(n)) if len(tree.found(i))}


def test_points_bound_the_overlap_and_links_connect():
    sets = [shingle_set(t) for t in near_copies(5, groups=4, size=15)]
    for a in sets[:20]:
        for b in sets[:20]:
            assert len(np.intersect1d(a, b)) <= np.minimum(point_of(a), point_of(b)).sum()
    links = links_within(np.arange(len(sets)), sets)
    assert len(links) == len({x for p in links for x in p}) - len({c[2] for c in plain(list(enumerate(near_copies(5, groups=4, size=15)))) if c[0] in {x for p in links for x in p}})


def test_points_of_large_sets_have_more_coordinates():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(base, k, replace=False)) for k in (8800, 8300, 8000, 4200, 4000, 900, 500)] + [np.unique(rng.integers(0, 1 << 63, 4100, dtype=np.uint64) * np.uint64(2))]
    points = [point_of(s) for s in sets]
    assert len({len(p) for p in points}) > 2
    n = np.array([len(s) for s in sets])
    tree = CountTree(n, points)
    for i in range(len(sets)):
        found = set(tree.found(i).tolist())
        for j in range(len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 180 * shared >= 80 * (n[i] + n[j]):
                assert j in found
    assert not len(tree.found(len(sets) - 1))
    cell = jaccard._packed_point(points[0])
    assert (jaccard._unpacked_point(cell) == points[0]).all()


def test_common_shingles_come_last_and_lose_no_link(spark, monkeypatch):
    """Documents that share a line must not all meet in its lists, which grow with the table; links stay those of all pairs."""
    monkeypatch.setattr(jaccard, "COMMON", 30)
    rng = random.Random(9)
    line = " ".join(f"menu{i}" for i in range(14))
    texts = [line + "\n" + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(60)]
    texts += [t + " more" for t in texts[:9]] + [line] * 3 + [line + " more"] * 2 + [line + " " + line] + near_copies(4, groups=3, size=4)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = set(jaccard.common_shingles(docs).tolist())
    assert set(shingle_set(line).tolist()) <= found and len(found) < 30
    assert sorted(map(tuple, jaccard_groups(docs).collect()), key=repr) == plain(rows)
    sizes = [r["count"] for r in jaccard.groups_of(jaccard.described(docs).where("n > 0")).groupBy("leader").count().collect()]
    assert max(sizes) < 20


def test_fronts_follow_one_order():
    s = np.array([1, 3, 5, 7, 9, 11, 13, 15, 17, 19], np.uint64)
    assert jaccard.front_of(s, np.zeros(0, np.uint64)).tolist() == [1, 3, 5]
    assert jaccard.front_of(s, np.array([0, 3, 5, 20], np.uint64)).tolist() == [1, 7, 9]
    assert jaccard.front_of(s, s).tolist() == [1, 3, 5] and jaccard.front_of(s[:0], s).tolist() == []
