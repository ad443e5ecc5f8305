"""Maximum dot product of every cell over the pins."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLOAT_DIVISOR, MAX_LAYER_PINS, MAX_PINS, SCORE_DIVISOR
from .quantiles import exact_quantiles


def dot(a: Column, b: Column, zero: Column | None = None) -> Column:
    """Left fold of the products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0) if zero is None else zero, lambda s, x: s + x)


def score_of(value: Column, divisor: float = SCORE_DIVISOR) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / F.lit(divisor)))


def _pin_row(pins: DataFrame, vector: str) -> DataFrame:
    """All pins as one array in one row; a request has MAX_PINS at most, which is checked when the row is made."""
    row = pins.agg(F.array_sort(F.collect_list(F.struct("pin_idx", F.col(vector).alias("v")))).alias("pins"))
    return row.select(F.when(F.size("pins") <= MAX_PINS, F.col("pins")).otherwise(F.raise_error(F.lit("too many pins"))).alias("pins"))


def scan(cells: DataFrame, pins: DataFrame, online: bool = False) -> DataFrame:
    """(pixel, dot, best_pin, score): one row a land cell. No shuffle: each cell meets the broadcast row of pins.

    Of equal products the pin with the smallest ordinal wins. `online`: products start from 0, so a cell without a positive product
    reports dot 0 and pin 0; scores are the same.
    """
    best = F.array_max(F.transform("pins", lambda p: F.struct(dot(F.col("q"), p["v"]).alias("dot"), (-p["pin_idx"]).alias("at"))))
    found = cells.where("is_land").crossJoin(F.broadcast(_pin_row(pins, "q"))).where("size(pins) > 0").select("pixel", best.alias("best"))
    d, pin = F.col("best.dot"), -F.col("best.at")
    if online:
        d, pin = F.greatest(d, F.lit(0)), F.when(d > 0, pin).otherwise(0)
    return found.select("pixel", d.alias("dot"), pin.cast("int").alias("best_pin")).withColumn("score", score_of(F.col("dot")))


def scan_float(cells: DataFrame, pins: DataFrame, vector: str = "v", divisor: float = FLOAT_DIVISOR) -> DataFrame:
    """(pixel, dot, score) with float vectors on both sides, as for 10 m tiles."""
    best = F.array_max(F.transform("pins", lambda p: dot(F.col(vector).cast("array<double>"), p["v"].cast("array<double>"), F.lit(0.0))))
    found = cells.crossJoin(F.broadcast(_pin_row(pins, vector))).where("size(pins) > 0").select("pixel", best.alias("dot"))
    return found.withColumn("score", score_of(F.col("dot"), divisor))


def scan_arrow(cells: DataFrame, pins: DataFrame) -> DataFrame:
    """scan() as a matrix product a batch: the fast form for large rasters. The pins, MAX_PINS at most, go to the tasks with the function."""
    rows = sorted(pins.select("pin_idx", "q").limit(MAX_PINS + 1).collect())
    if len(rows) > MAX_PINS:
        raise ValueError("too many pins")
    refs = np.array([r.q for r in rows], np.float32)
    ordinal = np.array([r.pin_idx for r in rows], np.int32)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not len(refs):
                continue  # without pins no cell has a score
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(b), -1)
            dots = q @ refs.T  # exact: products stay below 2**24
            best = dots.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dots[np.arange(len(b)), best].astype(np.int32)), pa.array(ordinal[best])], names=["pixel", "dot", "best_pin"])

    return cells.where("is_land").select("pixel", "q").mapInArrow(product, "pixel long, dot int, best_pin int").withColumn("score", score_of(F.col("dot")))


def scan_layers(cells: DataFrame, layer_pins: DataFrame) -> DataFrame:
    """(layer_id, pixel, dot, best_pin, score) of every layer in one pass over the cells, a matrix product a batch.

    The pins of all layers, MAX_LAYER_PINS at most, go to the tasks with the function.
    """
    rows = sorted(layer_pins.select("layer_id", "pin_idx", "q").limit(MAX_LAYER_PINS + 1).collect())
    if len(rows) > MAX_LAYER_PINS:
        raise ValueError("too many pins of layers")
    layers = [(name, list(group)) for name, group in itertools.groupby(rows, key=lambda r: r.layer_id)]
    refs = [(name, np.array([r.q for r in group], np.float32), np.array([r.pin_idx for r in group], np.int32)) for name, group in layers]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(b), -1)
            for name, pins, ordinal in refs:
                dots = q @ pins.T
                best = dots.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), b.column(0), pa.array(dots[np.arange(len(b)), best].astype(np.int32)), pa.array(ordinal[best])], names=["layer_id", "pixel", "dot", "best_pin"])

    found = cells.where("is_land").select("pixel", "q").mapInArrow(product, "layer_id string, pixel long, dot int, best_pin int")
    return found.withColumn("score", score_of(F.col("dot")))


def score_stats(scores: DataFrame) -> DataFrame:
    """(n, p50, p90, p99, top) of the positive products; exact percentiles, rounded to 4."""
    names = ("p50", "p90", "p99")
    found = exact_quantiles(scores.where("dot > 0"), "dot", [0.5, 0.9, 0.99, 1.0])
    none = F.lit(None).cast("double")
    empty = scores.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), *[none.alias(f"q{k}") for k in range(4)])
    one = found.union(empty).agg(F.max("n").alias("n"), *[F.max(f"q{k}").alias(f"q{k}") for k in range(4)])
    return one.select("n", *[F.round(f"q{i}", 4).alias(name) for i, name in enumerate(names)], F.col("q3").cast("int").alias("top"))
