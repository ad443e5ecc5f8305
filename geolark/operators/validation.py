"""How well vectors tell a class of places from random ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.suitability import rank_verdict, signal_verdict
from ..schema import DIMS, Q_MAX

#: Farms of a block, and cells of a baseline sample at most.
BLOCK, MAX_SAMPLE = 512, 20_000
#: The largest product of two quantised vectors.
LARGEST = DIMS * Q_MAX * Q_MAX


def sample(rows: DataFrame, n: int, seed: int = 42, key: str = "pixel") -> DataFrame:
    """The n rows with the smallest hash of key and seed (all, if fewer): a sample that every run repeats."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def gram(farms: DataFrame) -> DataFrame:
    """(n, total, squares, fourth, g) of the vectors q of whole numbers of every task: their number, sum, sum of squared lengths and of those squared, and sum of outer products.

    They add up, exactly, and give the moments of all pairs' products without a pair.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, g, squares, fourth = 0, 0, 0, 0, 0
        for b in batches:
            if len(b):
                m = _matrix(b.column(0))
                lengths = (m * m).sum(1)
                n, sums, g = n + len(m), sums + m.sum(0), g + m.T @ m
                squares, fourth = squares + int(lengths.sum()), fourth + int((lengths * lengths).sum())
        if n:
            cells = [pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([squares]), pa.array([fourth], pa.int64()), pa.array([g.ravel().tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["n", "total", "squares", "fourth", "g"])

    return farms.select("q").mapInArrow(partial, "n long, total array<long>, squares long, fourth long, g array<long>")


def _moments(sides: DataFrame, of_pairs: bool) -> DataFrame:
    """(n, mean, std) from gram() rows with `side`: one row a task of the raster meets here, never a vector. Python's whole numbers don't overflow."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                own = sums.setdefault(r["side"], [0, 0, 0, np.zeros(len(r["total"]), object), np.zeros(len(r["g"]), object)])
                for i, c in enumerate(("n", "squares", "fourth")):
                    own[i] += r[c]
                own[3] += np.array(r["total"], object)
                own[4] += np.array(r["g"], object)
        n = first = second = 0
        if of_pairs and 0 in sums:
            k, squares, fourth, total, g = sums[0]
            n, first, second = k * (k - 1) // 2, (int(total @ total) - squares) // 2, (int(g @ g) - fourth) // 2
        elif len(sums) == 2:
            n, first, second = sums[0][0] * sums[1][0], int(sums[0][3] @ sums[1][3]), int(sums[0][4] @ sums[1][4])
        mean = first / n if n else None
        std = math.sqrt((n * second - first * first) / (n * n)) if n else None
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.float64()), pa.array([std], pa.float64())], names=["n", "mean", "std"])

    return sides.repartition(1).mapInArrow(finish, "n long, mean double, std double")


def pair_moments(farms: DataFrame) -> DataFrame:
    """(n, mean, std) of the products of all pairs of farms (id, q), from the Gram matrix: linear in the farms."""
    return _moments(gram(farms).withColumn("side", F.lit(0)), of_pairs=True)


def baseline_moments(farms: DataFrame, others: DataFrame) -> DataFrame:
    """(n, mean, std) of the products of all farms with all others, from their two Gram matrices."""
    return _moments(gram(farms).withColumn("side", F.lit(0)).union(gram(others).withColumn("side", F.lit(1))), of_pairs=False)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _packed(m: np.ndarray) -> bytes:
    return m.astype("<i2").tobytes()


def _unpacked(cell: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<i2").astype(np.float64).reshape(n, -1)  # products of whole numbers stay exact


def blocks(farms: DataFrame, rows: int = BLOCK) -> tuple[DataFrame, int]:
    """(block, ids, m) and the number of blocks: about `rows` farms each, by the hash of their id, as a packed matrix."""
    count = max(1, -(-farms.count() // rows))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        m = _matrix(t.column("q").combine_chunks())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "m": pa.array([_packed(m)], pa.binary())})

    keyed = farms.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"), F.col("id").cast("long").alias("id"), "q")
    return keyed.groupBy("block").applyInArrow(pack, "block int, ids array<long>, m binary"), count


def block_pairs(packed: DataFrame, count: int, ordered: bool) -> DataFrame:
    """(block, other, ids, m, other_ids, other_m): every two blocks, by an equi-join on the other's number; once each, or `ordered` both ways."""
    first = F.lit(0) if ordered else F.col("block")
    left = packed.withColumn("other", F.explode(F.sequence(first, F.lit(count - 1))))
    return left.join(packed.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("m").alias("other_m")), "other")


def _counts(found: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(found)
    return pa.RecordBatch.from_arrays([pa.array((at - LARGEST).astype(np.int32)), pa.array(found[at])], names=["sim", "n"])


def pair_counts(farms: DataFrame) -> DataFrame:
    """(sim, n): how many pairs of farms (id, q) have each product. Blocks meet as matrices; a task hands on one row a value, never a pair."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * LARGEST + 1, np.int64)
        for b in batches:
            for x, y, ids, m, other_ids, other_m in zip(*(b.column(c) for c in ("block", "other", "ids", "m", "other_ids", "other_m")), strict=True):
                own, same = _unpacked(m, len(ids)), x.as_py() == y.as_py()
                # a block meets itself, not its other copy: that one may have been packed in another order, and then the triangle is not each pair once
                s = own @ (own if same else _unpacked(other_m, len(other_ids))).T
                s = s[np.triu_indices(len(s), 1)] if same else s.ravel()
                values, n = np.unique(s.astype(np.int64), return_counts=True)
                found[values + LARGEST] += n
        yield _counts(found)

    packed, count = blocks(farms)
    return block_pairs(packed, count, ordered=False).mapInArrow(tally, "sim int, n long").groupBy("sim").agg(F.sum("n").alias("n"))


def _kept(others: DataFrame) -> np.ndarray:
    """The sampled vectors as a matrix that goes to the tasks with the function; MAX_SAMPLE at most, which is checked."""
    rows = others.select("q").limit(MAX_SAMPLE + 1).collect()
    if len(rows) > MAX_SAMPLE:
        raise ValueError("the sample is too large")
    return np.array([r.q for r in rows], np.float64).reshape(len(rows), DIMS)


def baseline_counts(farms: DataFrame, others: DataFrame) -> DataFrame:
    """(sim, n): how many products of a farm with a sampled cell have each value."""
    refs = _kept(others)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * LARGEST + 1, np.int64)
        for whole in batches:
            for at in range(0, len(whole) if len(refs) else 0, 256):
                s = _matrix(whole.column(0).slice(at, 256)).astype(np.float64) @ refs.T
                values, n = np.unique(s.astype(np.int64), return_counts=True)
                found[values + LARGEST] += n
        yield _counts(found)

    return farms.select("q").mapInArrow(tally, "sim int, n long").groupBy("sim").agg(F.sum("n").alias("n"))


def summary(counts: DataFrame, moments: DataFrame, prefix: str = "") -> DataFrame:
    """n, mean, population deviation (from `moments`), min, max and median (from `counts`, a row a value)."""
    r = lambda c: F.round(c, 4)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = counts.select("sim", "n", none("pairs", "long"), none("mean", "double"), none("std", "double"))
    both = both.union(moments.select(none("sim", "int"), F.lit(0).cast("long"), "n", "mean", "std"))
    return both.agg(
        F.max("pairs").alias(f"{prefix}n"), r(F.max("mean")).alias(f"{prefix}mean"), r(F.max("std")).alias(f"{prefix}std"),
        F.min("sim").alias(f"{prefix}min"), F.max("sim").alias(f"{prefix}max"), r(F.percentile("sim", F.lit(0.5), F.col("n"))).alias(f"{prefix}median"),
    )


def signal(pairs: DataFrame, baseline: DataFrame) -> DataFrame:
    """(ratio, separation, verdict) of the mean similarity within the class against the baseline's, both (n, mean, std)."""
    both = pairs.select("mean", "std", F.lit(True).alias("own")).union(baseline.select("mean", "std", F.lit(False)))
    of = lambda c, own: F.max(F.when(F.col("own") == own, F.col(c)))
    both = both.agg(of("mean", True).alias("m"), of("mean", False).alias("bm"), of("std", False).alias("bs"))
    ratio = F.when(F.col("bm") != 0, F.col("m") / F.col("bm"))
    return both.select(F.round(ratio, 4).alias("ratio"), F.round((F.col("m") - F.col("bm")) / F.nullif("bs", F.lit(0.0)), 4).alias("separation"), signal_verdict(ratio).alias("verdict"))


def leave_one_out(farms: DataFrame, others: DataFrame) -> DataFrame:
    """(id, mean_rank, best_rank, percentile): where a farm's fellows stand among all rows ordered by similarity to it.

    Farms come before others of equal similarity, so a fellow's rank is the number of others above it and of fellows before it, and the latter
    add up to 0 + 1 + ... whatever their order: only others have to be counted, by bisection in their sorted products. Blocks of
    farms meet blocks of fellows; a task hands on a row a farm and block.
    """
    refs = _kept(others)

    def count_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ordered = None, None
        for b in batches:
            for x, y, ids, m, other_ids, other_m in zip(*(b.column(c) for c in ("block", "other", "ids", "m", "other_ids", "other_m")), strict=True):
                own = _unpacked(m, len(ids))
                if last != x.as_py():
                    last, ordered = x.as_py(), np.sort(own @ refs.T, 1) if len(refs) else np.zeros((len(ids), 0))
                sims = own @ _unpacked(other_m, len(other_ids)).T
                above = np.stack([len(refs) - np.searchsorted(o, s, "right") for o, s in zip(ordered, sims, strict=True)])
                fellow = ids.values.to_numpy()[:, None] != other_ids.values.to_numpy()
                some = fellow.any(1)
                cells = [ids.values.filter(pa.array(some)), pa.array(fellow.sum(1)[some]), pa.array(np.where(fellow, above, 0).sum(1)[some]), pa.array(np.where(fellow, above, len(refs)).min(1)[some])]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "fellows", "above", "least"])

    packed, count = blocks(farms)
    met = block_pairs(packed, count, ordered=True).repartition("block").sortWithinPartitions("block")
    per = met.mapInArrow(count_above, "id long, fellows long, above long, least long").groupBy("id").agg(F.sum("fellows").alias("f"), F.sum("above").alias("a"), F.min("least").cast("int").alias("best_rank"))
    mean = F.col("a") / F.col("f") + (F.col("f") - 1) / 2
    return per.select("id", F.round(mean, 4).alias("mean_rank"), "best_rank", F.round(100.0 * (1.0 - mean / (F.col("f") + F.lit(len(refs)))), 4).alias("percentile"))


def leave_one_out_summary(ranks: DataFrame) -> DataFrame:
    mean = F.avg("percentile")
    return ranks.agg(F.round(mean, 4).alias("mean_percentile"), F.round(F.percentile("percentile", F.lit(0.5)), 4).alias("median_percentile"), rank_verdict(mean).alias("verdict"))
