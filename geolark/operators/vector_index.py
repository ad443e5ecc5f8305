"""Inverted-file index for cosine search: coarse centroids, a list of packed blocks for each, and exact ranking of the lists probed.

The index is a folder: `centroids`, and `lists` partitioned by list, whose rows are blocks of up to BLOCK vectors. A search sends each
query to its nearest lists; queries meet blocks by list number, a matrix product a pair of blocks, and only the best of a block
go on. With all lists probed the answer is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .validation import sample

#: Lists of an index, and how many of them a search probes.
LISTS, PROBES = 20, 14
#: Rows that the centroids are fitted on at most, and rounds of the fit.
TRAIN, ROUNDS = 4096, 10
#: Vectors of a block of the index, and queries of a block.
BLOCK, QUERY_BLOCK = 1024, 256
#: Tasks over which a list is spread while it is written.
SPREAD = 16
MAX_LISTS = 1 << 14


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: of `dims` finite components, not all zero."""
    lengths = np.array([len(x) if x.is_valid else -1 for x in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    ok = lengths == dims
    m = np.zeros((len(column), dims))
    if ok.any():
        m[ok] = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    ok &= np.isfinite(m).all(1)
    size = np.sqrt((np.where(ok[:, None], m, 0.0) ** 2).sum(1))
    ok &= size > 0
    return m[ok] / size[ok, None], ok


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: first ones far from each other, then rounds of assignment and mean."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(lists, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    c = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def build_index(rows: DataFrame, path: str, dims: int, lists: int = LISTS, train: int = TRAIN, seed: int = 42) -> None:
    """Index `rows` (id, grp, v) in the folder `path`. grp: a class that searches keep to, such as the crop; may be null.

    Centroids are fitted on the `train` rows with the smallest hash, all rows are indexed. Vectors that are null, of other length, zero or
    not finite are left out, as they have no cosine.
    """
    if not 0 < lists <= MAX_LISTS:
        raise ValueError(f"an index has 1 to {MAX_LISTS} lists")
    spark = rows.sparkSession
    found = sample(rows.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v")), train, seed, "id").collect()  # at most `train` rows
    known, _ = _unit(pa.array([r.v for r in found], pa.list_(pa.float64())), dims)
    centres = fit_centroids(known, lists) if len(known) else np.zeros((1, dims))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, v array<double>").write.parquet(f"{path}/centroids")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ok = _unit(b.column("v"), dims)
            own = (m @ centres.T).argmax(1).astype(np.int32)
            vectors = pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), *(b.column(c).filter(pa.array(ok)) for c in ("grp", "id")), vectors], names=["list", "grp", "id", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}

        def block(key: tuple) -> pa.RecordBatch:
            ids, vectors = held.pop(key)
            cells = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(vectors)], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["list", "grp", "ids", "vectors"])

        for b in batches:
            for n, g, i, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids, vectors = held.setdefault((n, g), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == BLOCK:
                    yield block((n, g))
        for key in list(held):
            yield block(key)

    dealt = rows.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), F.col("v").cast("array<double>").alias("v"))
    listed = dealt.mapInArrow(assign, "list int, grp string, id long, vector binary").repartition("list", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    # a task holds an open block for each list and group that it gets
    listed.sortWithinPartitions("list", "grp").mapInArrow(pack, "list int, grp string, ids array<long>, vectors binary").write.partitionBy("list").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = PROBES, other_than_self: bool = True) -> DataFrame:
    """(query_id, rank, id, similarity): for each of `queries` (query_id, grp, v) the k nearest of its group in the `probes` nearest lists.

    A null grp asks in all groups. Similarities are rounded to 12 places, ties go to the smaller id. Queries without a cosine get no rows.
    """
    found = spark.read.parquet(f"{path}/centroids").limit(MAX_LISTS + 1).collect()  # one row a list
    if len(found) > MAX_LISTS:
        raise ValueError("too many lists")
    centres = np.array([r.v for r in sorted(found, key=lambda r: r.list)])
    dims = centres.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), QUERY_BLOCK):
                b = whole.slice(at, QUERY_BLOCK)
                m, ok = _unit(b.column("v"), dims)
                ids, groups = (np.array(b.column(c).filter(pa.array(ok)).to_pylist(), object) for c in ("query_id", "grp"))
                near = np.argsort(-(m @ centres.T), 1, kind="stable")[:, :probes]
                for n in np.unique(near).tolist():
                    mine = (near == n).any(1)
                    for g in set(groups[mine].tolist()):
                        own = mine & np.array([x == g for x in groups])
                        cells = [pa.array([n], pa.int32()), pa.array([g], pa.string()), pa.array([ids[own].tolist()], pa.list_(pa.int64())), pa.array([m[own].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cells, names=["list", "qgrp", "query_ids", "queries"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, q, ids, v in zip(*(b.column(c) for c in ("query_ids", "queries", "ids", "vectors")), strict=True):
                q_ids, r_ids = qs.values.to_numpy(), ids.values.to_numpy()
                score = np.frombuffer(q.as_buffer()).reshape(-1, dims) @ np.frombuffer(v.as_buffer()).reshape(-1, dims).T
                score = np.round(score, 12)
                if other_than_self:
                    score[q_ids[:, None] == r_ids] = -np.inf
                best = np.lexsort((np.broadcast_to(r_ids, score.shape), -score), 1)[:, :k]
                top = np.take_along_axis(score, best, 1)
                keep = np.isfinite(top)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(1))), pa.array(r_ids[best[keep]]), pa.array(top[keep])], names=["query_id", "id", "similarity"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("grp").cast("string").alias("grp"), F.col("v").cast("array<double>").alias("v"))
    dealt = asked.mapInArrow(deal, "list int, qgrp string, query_ids array<long>, queries binary")
    lists = spark.read.parquet(f"{path}/lists")
    met = dealt.join(lists, (dealt["list"] == lists["list"]) & (dealt["qgrp"].isNull() | (dealt["qgrp"] == lists["grp"])))
    near = met.select("query_ids", "queries", "ids", "vectors").mapInArrow(rank, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the rows of `exact` (query_id, id) that `found` has."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
