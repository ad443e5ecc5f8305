"""Rasters in Z-order: cells sorted by the interleaved bits of row and column, so that a box is a few ranges of codes.

Parquet keeps the smallest and largest code of each row group; a filter on a box's ranges is pushed into the scan and skips the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KM_PER_DEGREE, GridMeta

#: Ranges at most that a box is cut into; a coarser cut only reads more.
MOST_RANGES = 32
#: Bytes of a row group, small enough that boxes skip most of them.
GROUP_BYTES = 1 << 20
# The masks that spread 31 bits over every other of 62.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def zcode(row: Column, col: Column) -> Column:
    """The bits of row and col in turn, those of row first; both up to 2^31 - 1."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def box_ranges(first_row: int, last_row: int, first_col: int, last_col: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of codes, first and last, that cover the box; `most` of them at most, so they may cover more.

    Squares of the quadtree that lie across the box's border are divided largest first, as long as the ranges don't become too many.
    """
    if first_row > last_row or first_col > last_col:
        return []
    bits = max(last_row, last_col, 1).bit_length()
    done: list[tuple[int, int]] = []
    todo = [(0, bits, 0, 0)]  # code, size in bits, row, col
    while todo and len(done) + len(todo) + 3 <= most:
        code, n, row, col = todo.pop(0)
        side = 1 << n
        if row >= first_row and row + side - 1 <= last_row and col >= first_col and col + side - 1 <= last_col or n == 0:
            done.append((code, code + side * side - 1))
            continue
        half = side // 2
        for k in range(4):
            r, c = row + (k >> 1) * half, col + (k & 1) * half
            if r <= last_row and r + half > first_row and c <= last_col and c + half > first_col:
                todo.append((code + k * half * half, n - 1, r, c))
    out: list[tuple[int, int]] = []
    for a, b in sorted(done + [(code, code + (1 << 2 * n) - 1) for code, n, _, _ in todo]):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write_zordered(cells: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """`cells` (row, col, ...) as Parquet files that follow each other in Z-order, with `zcode`."""
    coded = cells.withColumn("zcode", zcode(F.col("row"), F.col("col")))
    coded.repartitionByRange("zcode").sortWithinPartitions("zcode").write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000).parquet(path)


def read_box(spark: SparkSession, path: str, first_row: int, last_row: int, first_col: int, last_col: int) -> DataFrame:
    """The cells of a box of rows and columns, ends included."""
    rows = spark.read.parquet(path)
    codes = F.lit(False)
    for a, b in box_ranges(max(0, first_row), last_row, max(0, first_col), last_col):
        codes = codes | F.col("zcode").between(a, b)
    return rows.where(codes & F.col("row").between(first_row, last_row) & F.col("col").between(first_col, last_col))


def read_buffer(spark: SparkSession, path: str, meta: GridMeta, lat: float, lng: float, km: float) -> DataFrame:
    """The cells of the box around the circle of `km` around a point, for in_buffer() to choose from; the box doesn't go round the date line."""
    reach = km / KM_PER_DEGREE
    wide = reach / max(0.01, min(math.cos(math.radians(max(-90.0, lat - reach))), math.cos(math.radians(min(90.0, lat + reach)))))
    row = lambda v: int((meta.north - v) / meta.cell_h)
    col = lambda v: int((v - meta.west) / meta.cell_w)
    return read_box(spark, path, max(0, row(lat + reach)), min(meta.height - 1, row(lat - reach)), max(0, col(lng - wide)), min(meta.width - 1, col(lng + wide)))
