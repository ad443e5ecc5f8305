"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from geolark.llm.merkle import height_of, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(nodes):
    """Root, and for every node the (before, after) of each step."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(at)):
            run = nodes[at[i] // 3 * 3 : at[i] // 3 * 3 + 3]
            steps[i].append(("".join(run[: at[i] % 3]), "".join(run[at[i] % 3 + 1 :])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs[s] = (own, *tree([leaf(r, r[1]) for r in own]))
    root, upper = tree([subs[s][1] for s in order]) if order else ("", [])
    out = []
    for s, up in zip(order, upper, strict=True):
        own, sub, steps = subs[s]
        for r, way in zip(own, steps, strict=True):
            d = leaf(r, r[1])
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                d = leaf(r, r[1].replace("\n", ""))
            for a, b in way + up:
                d = h(a, d, b)
            out.append((r[0], leaf(r, r[1]), sub, root, h(*[a + b for a, b in way + up]), d, d == root))
    return sorted(out, key=repr)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a\nb", "line\n" * rng.randint(1, 4), "größe 中\n", "x" * 50])
    return [(rng.choice([None, i, i // 2]), text(), rng.choice([None, "en", ""]), rng.choice(sources), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (1, ["a"]), (3, [None]), (4, ["a"]), (28, ["a"]), (60, [None, "a", "B", "é", "\U0001f600", "￮", ""]), (90, ["hot"] * 9 + [str(i) for i in range(11)])])
def test_equals_plain_tree(spark, n, sources):
    rows = rows_of(n, sources, n)
    rows += rows[:2]  # repeated rows
    got = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_other_columns_and_long_text(spark):
    from pyspark.sql import functions as F

    rows = [(i, "word\n" * 100_000 if i == 3 else f"t{i}\n", "en", "a", i) for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df
    for c in ("g", "n", "pos", "d", "path", "leaf", "root", "altered", "_one", "tree"):
        more = more.withColumn(c, F.lit("clash"))
    got = sorted(map(tuple, manifest(more).collect()), key=repr)
    assert got == plain(rows)
    assert 0 < sum(r[-1] for r in got) < 7


def test_heights():
    assert [height_of(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
