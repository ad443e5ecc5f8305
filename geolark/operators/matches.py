"""Diversified best matches of a score raster, and lookups on it."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import centre_lat, centre_lng, region_bucket, row_col
from ..schema import MATCH_THRESHOLD, MAX_PINS, GridMeta
from ..sources.shared import written


def sample_step(meta: GridMeta) -> int:
    """Every how many cells a sample of about a million cells has one."""
    return max(1, meta.width * meta.height // 1_000_000)


def candidates(scores: DataFrame, pins: DataFrame, meta: GridMeta, threshold: float = MATCH_THRESHOLD, exclude_km: float = 100.0, step: int = 1) -> DataFrame:
    """Scores from the threshold on, outside the square boxes around all pins that lie in the raster (water or not), with row and col.

    All cells are looked at; a caller that wants a sample passes every how many (`sample_step`).
    """
    k = max(1, meta.cells_of_km(exclude_km))
    boxed = pins.select(row_col(F.col("lat"), F.col("lng"), meta).alias("c")).where("c is not null").select(F.col("c.row").alias("prow"), F.col("c.col").alias("pcol"))
    rows = scores.where((F.col("score") >= threshold) & (F.col("pixel") % F.lit(step) == 0))
    rows = rows.withColumn("row", F.expr(f"cast(pixel div {meta.width} as int)")).withColumn("col", (F.col("pixel") % meta.width).cast("int"))
    boxed = boxed.limit(MAX_PINS + 1).groupBy().agg(F.collect_list(F.struct("prow", "pcol")).alias("b"))
    boxed = boxed.select(F.when(F.size("b") <= MAX_PINS, F.col("b")).otherwise(F.raise_error(F.lit("too many pins"))).alias("b")).select(F.inline("b"))
    near = (F.abs(F.col("row") - F.col("prow")) <= k) & (F.abs(F.col("col") - F.col("pcol")) <= k)
    return rows.join(F.broadcast(boxed), near, "left_anti")


def top_matches(found: DataFrame, meta: GridMeta, count: int = 20, spacing_km: float = 50.0, per_pin: int = 2, per_region: int = 3, head: int = 4) -> DataFrame:
    """(rank, pixel, lat, lng, score, best_pin): the greedy choice by (score descending, pixel) under spacing and diversity caps.

    Each pass filters the candidates by what is taken so far (the squares around it, the pins and regions that are full) and takes the
    `head` best rows of every pin and region that are left. The greedy rule runs on these up to the end of some group's rows, which
    is one match further at least; so there are `count` passes at most, and a pass collects `head` rows a group, however many cells lie close together.
    """
    spark = found.sparkSession
    gap = max(2, meta.cells_of_km(spacing_km))
    lat, lng = centre_lat(F.col("row"), meta), centre_lng(F.col("col"), meta)
    order = Window.partitionBy("best_pin", "region").orderBy(F.desc("score"), "pixel")
    placed = found.withColumn("lat", lat).withColumn("lng", lng).select("pixel", "row", "col", "lat", "lng", "score", "best_pin", region_bucket(lat, lng).alias("region"))
    placed = written(placed, "candidates")  # every pass reads them
    taken: list = []
    while len(taken) < count:
        rows = placed.where(_still_free(taken, gap, per_pin, per_region)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= head).collect()
        before = len(taken)
        done = _greedy(sorted(rows, key=lambda r: (-r.score, r.pixel)), taken, gap, count, per_pin, per_region, head)
        if done or len(taken) == before:
            break
    schema = "rank int, pixel long, lat double, lng double, score double, best_pin int"
    chosen = spark.createDataFrame([(n + 1, t.pixel, t.lat, t.lng, t.score, t.best_pin) for n, t in enumerate(taken)], schema)
    return chosen.select("rank", "pixel", *[F.round(c, 4).alias(c) for c in ("lat", "lng", "score")], "best_pin")


def _full(taken: list, per_pin: int, per_region: int) -> tuple[set, set]:
    """Pins and regions that can't take another match."""
    pins, regions = Counter(t.best_pin for t in taken), Counter(t.region for t in taken)
    return {p for p, n in pins.items() if n >= per_pin}, {r for r, n in regions.items() if n >= per_region}


def _still_free(taken: list, gap: int, per_pin: int, per_region: int) -> Column:
    """Which candidates the matches taken so far leave possible; a condition on the scan, as long as the matches are many."""
    pins, regions = _full(taken, per_pin, per_region)
    ok = ~F.col("best_pin").isin(*sorted(pins)) if pins else F.lit(True)
    ok = ok & ~F.col("region").isin(*sorted(regions)) if regions else ok
    for t in taken:
        ok = ok & (F.abs(F.col("row") - t.row) + F.abs(F.col("col") - t.col) >= gap)
    return ok


def _greedy(rows: list, taken: list, gap: int, count: int, per_pin: int, per_region: int, head: int) -> bool:
    """Append the rows that the rule accepts, in order, until a group's rows end that may have had more; whether that didn't happen."""
    for r in rows:
        if len(taken) == count:
            return True
        pins, regions = _full(taken, per_pin, per_region)
        if r.best_pin in pins or r.region in regions:
            continue
        if all(abs(r.row - t.row) + abs(r.col - t.col) >= gap for t in taken):
            taken.append(r)
        if r.nth == head:
            return False
    return True


def matches_per_pin(matches: DataFrame) -> DataFrame:
    return matches.groupBy("best_pin").agg(F.count("*").alias("n"))


def named_matches(matches: DataFrame, pins: DataFrame) -> DataFrame:
    """Matches with the label of their pin, or Pin n without one."""
    labels = pins.select(F.col("pin_idx").alias("best_pin"), "label")
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Pin "), (F.col("best_pin") + 1).cast("string")))
    return matches.join(labels, "best_pin", "left").withColumn("label", name)


def point_scores(points: DataFrame, scores: DataFrame, meta: GridMeta) -> DataFrame:
    """Points with the score of their cell, 0 on water and outside."""
    c = row_col(F.col("lat"), F.col("lng"), meta)
    keyed = points.withColumn("pixel", (c["row"] * meta.width + c["col"]).cast("long"))
    return keyed.join(scores.select("pixel", "score"), "pixel", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
