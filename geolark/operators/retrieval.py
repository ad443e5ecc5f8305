"""Nearest farms, yield prediction, stability over years, zones and class shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.suitability import match_confidence, match_quality, overall_stability, pair_stability
from ..sources.shared import written
from .similarity import dot
from .validation import sample


def cosine(a: Column, b: Column) -> Column:
    """True cosine; null where a vector has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)
    return dot(a, b, zero) / F.nullif(F.sqrt(dot(a, a, zero)) * F.sqrt(dot(b, b, zero)), zero)


def nearest_farms(farms: DataFrame, query: DataFrame, crop: str, limit: int = 5) -> DataFrame:
    """The farms of a crop nearest by cosine to the one vector `v` of `query`, with similarity rounded to 3 and quality. Exact, not by index."""
    rows = farms.where((F.lower("crop") == crop.lower()) & F.col("embedding").isNotNull()).crossJoin(F.broadcast(query.select("v").limit(1)))
    best = rows.withColumn("exact", cosine(F.col("embedding"), F.col("v"))).drop("v").orderBy(F.desc("exact"), "id").limit(limit)
    return best.withColumn("similarity", F.round("exact", 3)).withColumn("quality", match_quality(F.col("exact")))


def predict_yield(matches: DataFrame) -> DataFrame:
    """(n, expected, low, high, confidence): typical yields weighted by similarity; without weight the best match's."""
    w = F.sum("similarity")
    first = lambda c: F.max_by(c, F.struct("exact", -F.col("id")))
    pick = lambda weighted, c: F.when(w > 0, weighted).otherwise(F.coalesce(first(c), F.lit(0.0)))
    best = F.coalesce(F.max("similarity"), F.lit(0.0))
    return matches.agg(
        F.count("*").alias("n"),
        F.round(pick(F.sum(F.col("yield_typical") * F.col("similarity")) / w, "yield_typical"), 6).alias("expected"),
        pick(F.min("yield_min"), "yield_min").alias("low"),
        pick(F.max("yield_max"), "yield_max").alias("high"),
        match_confidence(best).alias("confidence"),
    )


def stability(yearly: DataFrame) -> DataFrame:
    """(loc, from_year, year, similarity, change) of a location's vector with that of the year before it that has one."""
    w = Window.partitionBy("loc").orderBy("year")
    pairs = yearly.withColumn("prev", F.lag("embedding").over(w)).withColumn("from_year", F.lag("year").over(w)).where("prev is not null")
    sim = dot(F.col("prev").cast("array<double>"), F.col("embedding").cast("array<double>"), F.lit(0.0))
    return pairs.withColumn("sim", sim).select("loc", "from_year", "year", F.round("sim", 6).alias("similarity"), pair_stability(F.col("sim")).alias("change"))


def stability_overall(pairs: DataFrame) -> DataFrame:
    """(loc, score, verdict): mean of a location's similarities."""
    m = F.avg("similarity")
    return pairs.groupBy("loc").agg(F.round(m, 5).alias("score"), overall_stability(m).alias("verdict"))


def class_shares(rows: DataFrame, code: str, digits: int = 2) -> DataFrame:
    """(code, n, pct), commonest first by share. The window runs over one row a class."""
    n = rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))


def named_classes(shares: DataFrame, names: DataFrame, default: str = "Unknown") -> DataFrame:
    return shares.join(names, "code", "left").withColumn("name", F.coalesce("name", F.lit(default)))


def zone_labels(shares: DataFrame, labels: list[str]) -> DataFrame:
    """Zones named by size: the given labels in turn, then zone_<n>."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "code"))
    given = F.array(*[F.lit(x) for x in labels])
    return shares.withColumn("rank", rank).withColumn("label", F.coalesce(F.get(given, F.col("rank") - 1), F.concat(F.lit("zone_"), F.col("rank").cast("string"))))


def zone_centres(rows: DataFrame, k: int = 4, train: int = 1000, rounds: int = 10, seed: int = 42, key: str = "pixel", vector: str = "q") -> np.ndarray:
    """k centres by Lloyd's rule on the `train` sampled rows of whole-number vectors; the first k of the sample are where it starts.

    A round sums the vectors of every zone in its tasks; what reaches the driver is k rows a task. The sums are exact, so every run has the same centres. A
    zone that loses all rows keeps its centre.
    """
    chosen = written(sample(rows.where(F.col(vector).isNotNull()), train, seed, key).select(F.col(key).alias("key"), F.col(vector).cast("array<long>").alias("v")), "train")
    first = chosen.orderBy(F.md5(F.concat_ws(":", F.col("key").cast("string"), F.lit(str(seed))).cast("binary")), "key").limit(k).collect()
    centres = np.array([r.v for r in first], np.float64).reshape(len(first), -1)
    for _ in range(rounds if len(first) else 0):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
            for b in batches:
                if len(b):
                    m = b.column(0).flatten().to_numpy().reshape(len(b), -1)
                    zone = nearest_centre(m, centres)
                    np.add.at(total, zone, m)
                    n += np.bincount(zone, minlength=len(centres))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["zone", "n", "total"])

        n, total = np.zeros(len(centres)), np.zeros(centres.shape)
        for r in chosen.select("v").mapInArrow(sums, "zone int, n long, total array<long>").collect():
            n[r.zone] += r.n
            total[r.zone] += r.total
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of every row."""
    return np.stack([((m - c) ** 2).sum(1) for c in centres]).argmin(0)


def kmeans_zones(rows: DataFrame, k: int = 4, train: int = 1000, rounds: int = 10, seed: int = 42, key: str = "pixel", vector: str = "q") -> DataFrame:
    """(key, zone): the nearest of zone_centres() of all rows that have a vector."""
    centres = zone_centres(rows, k, train, rounds, seed, key, vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b) and len(centres):
                m = b.column(1).flatten().to_numpy().reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest_centre(m, centres).astype(np.int32))], names=[key, "zone"])

    keyed = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<long>").alias(vector))
    return keyed.mapInArrow(assign, f"{key} long, zone int")


def cloud_fraction(rows: DataFrame, group: str, code: str = "scl") -> DataFrame:
    """(group, cloud_pct): share of the cloud classes 8, 9 and 10; 100 where no class is known."""
    hit = F.when(F.col(code).isNotNull(), F.col(code).isin(8, 9, 10).cast("double"))
    return rows.groupBy(group).agg(F.round(F.coalesce(F.avg(hit) * 100, F.lit(100.0)), 4).alias("cloud_pct"))
