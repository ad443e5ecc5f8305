"""Building and quantising rasters of vectors, pins, and land statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import row_col
from ..schema import DIMS, Q_MAX, Q_MIN, Q_STEPS, GridMeta


def any_band(vector: Column) -> Column:
    """Land mask: some band is not zero."""
    return F.exists(vector, lambda x: x != 0)


def mask_water(vector: Column, landcover: Column, occurrence: Column) -> Column:
    """Zeros where the land cover is water (17) or water occurs more than half of the time."""
    return F.when((landcover == 17) | (occurrence > 50), F.transform(vector, lambda x: x * 0)).otherwise(vector)


def band_ranges(cells: DataFrame, vector: str = "e", dims: int = DIMS) -> DataFrame:
    """(band, lo, hi, scale, offset) over the land cells: each task gives one row of minima and maxima, no cell is taken apart into rows."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.nan), np.full(dims, np.nan)
        for b in batches:
            lengths = np.diff(b.column(0).offsets.to_numpy())
            for n in np.unique(lengths).tolist():  # one, as a rule
                m = b.column(0).filter(pa.array(lengths == n)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[:, :dims]
                k = m.shape[1]
                low[:k], high[:k] = np.fmin(low[:k], np.fmin.reduce(m)), np.fmax(high[:k], np.fmax.reduce(m))
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (low, high)], names=["low", "high"])

    each = cells.where(F.col("is_land") & (F.size(vector) > 0)).select(F.col(vector).cast("array<double>")).mapInArrow(ends, "low array<double>, high array<double>")
    flat = each.select(F.posexplode(F.arrays_zip("low", "high")).alias("band", "x"))
    known = flat.where(~F.isnan("x.low"))
    r = known.groupBy("band").agg(F.min("x.low").alias("lo"), F.max("x.high").alias("hi"))
    scale = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / Q_STEPS)
    r = r.withColumn("scale", scale)
    return r.withColumn("offset", F.when(F.col("hi") == F.col("lo"), F.col("lo")).otherwise(F.col("lo") + 127.0 * F.col("scale")))


def kept_ranges(ranges: DataFrame) -> DataFrame:
    """The same few rows as constants of the plan: computed once, so that scans that quantise on the fly don't read the raster again."""
    rows = [f"({r.band}, {r.lo!r}D, {r.hi!r}D, {r.scale!r}D, {r.offset!r}D)" for r in ranges.select("band", "lo", "hi", "scale", "offset").collect()]  # one row a band
    return ranges.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(band, lo, hi, scale, offset)") if rows else ranges


def band_arrays(ranges: DataFrame) -> DataFrame:
    """One row with the bands' scales, offsets and whether a band is constant, in band order."""
    one = ranges.agg(F.array_sort(F.collect_list(F.struct("band", "scale", "offset", (F.col("hi") == F.col("lo")).alias("constant")))).alias("b"))
    return one.select(F.col("b.scale").alias("scales"), F.col("b.offset").alias("offsets"), F.col("b.constant").alias("constants"))


def quantize(cells: DataFrame, ranges: DataFrame, vector: str = "e") -> DataFrame:
    """Land cells with `q`: every band scaled to -127..127, rounded half to even; constant bands are 0."""

    def one(v: Column, i: Column) -> Column:
        q = F.rint((v - F.get(F.col("offsets"), i)) / F.get(F.col("scales"), i)).cast("int")
        return F.when(F.get(F.col("constants"), i), 0).otherwise(F.greatest(F.lit(Q_MIN), F.least(F.lit(Q_MAX), q)))

    # the side that is broadcast is one row of 64 bands
    wide = cells.where("is_land").crossJoin(F.broadcast(band_arrays(ranges)))
    return wide.withColumn("q", F.transform(vector, one)).drop("scales", "offsets", "constants")


def dequantize(cells: DataFrame, ranges: DataFrame, out: str = "restored") -> DataFrame:
    """Cells with `out`: q * scale + offset of every band."""
    wide = cells.crossJoin(F.broadcast(band_arrays(ranges)))
    return wide.withColumn(out, F.transform("q", lambda v, i: v * F.get(F.col("scales"), i) + F.get(F.col("offsets"), i))).drop("scales", "offsets", "constants")


def roundtrip_error(cells: DataFrame, ranges: DataFrame, vector: str = "e") -> DataFrame:
    """(mse, max_error) of quantised against original values over all land cells."""
    back = dequantize(quantize(cells, ranges, vector), ranges)
    gap = back.select(F.zip_with("restored", vector, lambda a, b: a - b).alias("d"))
    sums = gap.select(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x).alias("s"), F.array_max(F.transform("d", F.abs)).alias("m"), F.size("d").alias("n"))
    return sums.agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mse"), F.round(F.max("m"), 9).alias("max_error"))


def box_cells(boxes: DataFrame, meta: GridMeta) -> DataFrame:
    """`boxes` (west, south, east, north) with the pixels of the cells whose centres lie inside; each box makes its own cells, no cell is compared with all boxes."""
    row = lambda lat: (F.lit(meta.north) - lat) / meta.cell_h - 0.5
    col = lambda lng: (lng - F.lit(meta.west)) / meta.cell_w - 0.5
    span = lambda low, high, n: F.when(F.greatest(F.ceil(low), F.lit(0)) <= F.least(F.floor(high), F.lit(n - 1)), F.sequence(F.greatest(F.ceil(low), F.lit(0)), F.least(F.floor(high), F.lit(n - 1))))
    rows = boxes.withColumn("_row", F.explode(span(row(F.col("north")), row(F.col("south")), meta.height)))
    return rows.withColumn("_col", F.explode(span(col(F.col("west")), col(F.col("east")), meta.width))).withColumn("pixel", (F.col("_row") * meta.width + F.col("_col")).cast("long")).drop("_row", "_col")


def sampled_at(points: DataFrame, cells: DataFrame, meta: GridMeta, columns: list[str]) -> DataFrame:
    """Points with the given columns of the cell they fall in (elevation, slope, aspect and the like), null outside the raster."""
    c = row_col(F.col("lat"), F.col("lng"), meta)
    return points.withColumn("pixel", (c["row"] * meta.width + c["col"]).cast("long")).join(cells.select("pixel", *columns), "pixel", "left").drop("pixel")


def land_stats(cells: DataFrame) -> DataFrame:
    """(total, land, water, land_pct) of a raster."""
    n, land = F.count("*"), F.count_if("is_land")
    return cells.agg(n.alias("total"), land.alias("land"), (n - land).alias("water"), F.round(land * 100.0 / n, 4).alias("land_pct"))


def lookup_pins(pins: DataFrame, cells: DataFrame, meta: GridMeta, clamp: bool = False) -> DataFrame:
    """Pins that fall on land, with the cell's pixel, row, col and q. Original ordinals stay; pins on water or outside are dropped."""
    placed = pins.withColumn("_cell", row_col(F.col("lat"), F.col("lng"), meta, clamp)).where("_cell is not null")
    keyed = placed.select("pin_idx", "lat", "lng", F.col("_cell.row").alias("row"), F.col("_cell.col").alias("col"))
    return keyed.join(cells.where("is_land").select("pixel", "row", "col", "q"), ["row", "col"]).select("pin_idx", "lat", "lng", "row", "col", "pixel", "q")
