"""Exact top-k search by multi-resolution segment statistics.

A vector of d components is cut into 4, 8 and 16 segments. For segment means m and deviations s,
    |q - x|^2 >= sum_j len_j * ((mq_j - mx_j)^2 + (sq_j - sx_j)^2),
so, as the two norms are known, q.x <= sum_j len_j * (mq_j * mx_j + sq_j * sx_j). A coarse level
rejects most candidates, finer levels see its survivors only, and what is left gets the exact
integer product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 8, 16)
_PAIR = "dim int, query_id long, query_key long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as double; rows without id, without a vector, with an empty one or with a null or non-finite component are left out, and repeated rows count once."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v")).distinct()


def _features(m: np.ndarray) -> list[np.ndarray]:
    """For each level the weighted means and deviations, whose inner product bounds the vectors' own."""
    out = []
    for parts in LEVELS:
        cuts = np.linspace(0, m.shape[1], min(parts, m.shape[1]) + 1).astype(int)[:-1]
        lens = np.diff(np.append(cuts, m.shape[1]))
        mean = np.add.reduceat(m, cuts, axis=1) / lens
        var = np.maximum(np.add.reduceat(m * m, cuts, axis=1) / lens - mean * mean, 0)
        out.append(np.hstack([mean * np.sqrt(lens), np.sqrt(var * lens)]))
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[-k]
        few = np.flatnonzero(score >= floor)
        return few[np.lexsort((ids[few], -score[few]))[:k]]
    return np.lexsort((ids, -score))[:k]


def block_top_k(queries: pa.Table, candidates: pa.Table, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of one block, the places in `candidates` of its k best and their scores, coarse to fine."""
    q, x = _matrix(queries), _matrix(candidates)
    qid, xid = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
    fq, fx = _features(q.astype(float)), _features(x.astype(float))
    slack = 1e-9 * (np.linalg.norm(q.astype(float), axis=1)[:, None] * np.linalg.norm(x.astype(float), axis=1).max(initial=0) + 1)
    found = []
    step = max(1, 4_000_000 // max(1, len(x)))
    for at in range(0, len(q), step):
        coarse = fq[0][at : at + step] @ fx[0].T
        for row, i in enumerate(range(at, min(at + step, len(q)))):
            bound = coarse[row]
            bound[xid == qid[i]] = -np.inf
            live = np.flatnonzero(bound > -np.inf)
            first = live[np.argpartition(-bound[live], 8 * k)[: 8 * k]] if len(live) > 8 * k else live
            exact = x[first] @ q[i]
            floor = np.partition(exact, len(exact) - k)[-k] if len(exact) >= k else -np.inf
            live = live[bound[live] >= floor - slack[i, 0]]
            for level in range(1, len(LEVELS)):
                live = live[fx[level][live] @ fq[level][i] >= floor - slack[i, 0]]
            score = x[live] @ q[i]
            top = _best(xid[live], score, k)
            found.append((live[top], score[top]))
    return found


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Both inputs come from quantized(). Queries are dealt into blocks of about `query_block` and candidates
    into blocks of about `candidate_block`; one task call sees one block of each, so memory is bounded whatever
    the sizes or the number of equal vectors, and a block hands on k rows a query. A row never answers itself;
    vectors of different length do not meet; with fewer than k candidates all are returned. Scores are exact
    within the range of a long. Rows that quantized() leaves out (null ids, null, empty or non-finite vectors) take no part, repeated rows count once,
    an empty table on either side gives an empty result; only vec_id and v are looked at, so other columns may have any name.
    """
    nq, nx = (max(1, math.ceil(d.count() / n)) for d, n in ((queries, query_block), (candidates, candidate_block)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    q = queries.select(F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), F.col("v").alias("v"), deal(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("cb"))
    x = candidates.select(F.size("v").alias("dim"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), deal(nx).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            found: list = [(np.zeros(0, int), np.zeros(0, np.int64))] * len(a)
        else:
            found = block_top_k(a, b, k)
        n = [len(p) for p, _ in found]
        who = np.repeat(np.arange(len(a)), n)
        place = np.concatenate([p for p, _ in found]).astype(int) if found else np.zeros(0, int)
        score = np.concatenate([s for _, s in found]) if found else np.zeros(0)
        take = lambda t, c, i: t.column(c).combine_chunks().take(pa.array(i))
        cols = [take(a, "dim", who), take(a, "query_id", who), take(a, "query_key", who), take(b, "vec_id", place), pa.array(score.astype(np.int64))]
        return pa.table(dict(zip(["dim", "query_id", "query_key", "vec_id", "score"], cols, strict=True)))

    keys = ["dim", "qb", "cb"]
    pairs = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(search, _PAIR)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Rows of `embeddings` whose id is divisible by 50 against all rows, five best each."""
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(rows.where("vec_id % 50 = 0"), rows)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
