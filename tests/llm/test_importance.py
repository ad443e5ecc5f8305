"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from geolark.llm.importance import bucket_counts, bucket_stream, bucket_streams, resampled, words_of

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) for r in runs]


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    raw, goal = (Counter(f % buckets for t in texts for f in features(t, longest)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(raw.values()), sum(goal.values())
    out = []
    for doc_id, text in docs:
        words, own = features(text, longest)
        weight = sum(math.floor(1000 * math.log((goal[f % buckets] + 1.0) * (s_all + buckets) / ((raw[f % buckets] + 1.0) * (t_all + buckets)))) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for n, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÀB", "中文", "x1", "A-b", "it's"]
    return [rng.choice(["", None]) if rng.random() < 0.05 else rng.choice([" ", "\n", " - "]).join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (1, 7), (3, 1000)])
def test_equals_plain_computation(spark, longest, buckets):
    docs = list(enumerate(texts(150, 1)))
    docs += docs[:5] + [(None, "word " * 30), (None, None), (7, docs[7][1])]
    target = [*texts(12, 2), None]
    got = resampled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, longest, buckets)


def test_ties_go_to_the_smaller_id_and_small_tables(spark):
    empty = spark.createDataFrame([], "text string")
    none = spark.createDataFrame([], SCHEMA)
    assert resampled(none, empty).count() == 0
    same = [(5, "a " * 20)] * 30
    assert sorted(r["rank"] for r in resampled(spark.createDataFrame(same, SCHEMA), empty).collect() if r["rank"]) == [1, 2, 3]
    assert sorted(map(tuple, resampled(spark.createDataFrame(same, SCHEMA), empty).collect()), key=repr) == plain(same, [])


def test_long_texts_and_other_columns(spark):
    from pyspark.sql import functions as F

    docs = [(1, "alpha beta " * 700_000), (2, "gamma"), (3, "delta " * 25)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("id", "ids", "words", "sizes", "stream", "bucket", "_in", "rank", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = resampled(df, df.select("text"), percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, [t for _, t in docs], percent=50)


def test_streams_hold_every_feature_once(spark):
    docs = list(enumerate(texts(80, 3)))
    s = bucket_streams(spark.createDataFrame(docs, SCHEMA), "doc_id")
    want = Counter(b for _, t in docs for b in bucket_stream(words_of(t)).tolist())
    assert {r["bucket"]: r["n"] for r in bucket_counts(s).collect()} == want
    assert sum(sum(r["sizes"]) for r in s.collect()) == sum(want.values())
