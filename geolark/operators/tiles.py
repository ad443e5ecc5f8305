"""Web-mercator heat tiles from a score raster."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.geo import palette_colour, ramp_colour, ramp_index, row_col, tile_bounds
from ..schema import VISIBLE_THRESHOLD, GridMeta

TILE = 256
#: Neighbouring cells of a raster row that travel together.
CHUNK = 32


def tile_list(spark: SparkSession, zooms: range | list[int], meta: GridMeta) -> DataFrame:
    """(z, x, y) of every tile of the zooms that overlaps the raster; pruned before any pixel is made."""
    out = None
    for z in zooms:
        n = 1 << z
        one = spark.range(n * n).select(F.lit(z).alias("z"), (F.col("id") % n).cast("int").alias("x"), F.expr(f"cast(id div {n} as int)").alias("y"))
        out = one if out is None else out.union(one)
    b = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    hit = (b["west"] < meta.east) & (b["east"] > meta.west) & (b["south"] < meta.north) & (b["north"] > meta.south)
    return out.where(hit)


def _axes(meta: GridMeta, size: int) -> tuple[Column, Column]:
    """For a tile's z, x, y: the raster row of each pixel row and the raster column of each pixel column, null outside."""
    b = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    inner_lat, inner_lng = F.lit((meta.north + meta.south) / 2), F.lit((meta.west + meta.east) / 2)
    whole = F.transform(F.array(b), lambda t: F.struct(
        F.transform(steps, lambda p: row_col(t["north"] - (p + 0.5) * ((t["north"] - t["south"]) / float(size)), inner_lng, meta)["row"]).alias("rows"),
        F.transform(steps, lambda p: row_col(inner_lat, t["west"] + (p + 0.5) * ((t["east"] - t["west"]) / float(size)), meta)["col"]).alias("cols"),
    ))[0]
    return whole["rows"], whole["cols"]


def score_chunks(scores: DataFrame, meta: GridMeta) -> DataFrame:
    """(row, block, v): the scores of CHUNK neighbouring cells of a raster row as one array, null on water."""
    at = (F.col("pixel") % meta.width % CHUNK).cast("int")
    keyed = scores.select(F.expr(f"cast(pixel div {meta.width} as int)").alias("row"), F.expr(f"cast(pixel % {meta.width} div {CHUNK} as int)").alias("block"), at.alias("at"), "score")
    return keyed.groupBy("row", "block").agg(F.array(*[F.max(F.when(F.col("at") == k, F.col("score"))) for k in range(CHUNK)]).alias("v"))


def tile_strips(tiles: DataFrame, scores: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """(z, x, y, row, block, v): for every tile the raster chunks that it shows. What is shuffled is a tile's chunks, not its pixels."""
    rows, cols = _axes(meta, size)
    some = lambda a: F.array_distinct(F.filter(a, lambda v: v.isNotNull()))
    placed = tiles.select("z", "x", "y", F.explode(some(rows)).alias("row"), cols.alias("cols"))
    placed = placed.select("z", "x", "y", "row", F.explode(some(F.transform("cols", lambda c: F.floor(c / CHUNK).cast("int")))).alias("block"))
    return placed.join(score_chunks(scores, meta), ["row", "block"], "left")


def _shown(col: Column) -> Column:
    """Score of a raster column in a strip, null where the strip doesn't hold it."""
    return F.when(F.floor(col / CHUNK) == F.col("block"), F.coalesce(F.get("v", col - F.col("block") * CHUNK), F.lit(0.0)))


def tile_scores(tiles: DataFrame, scores: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """(z, x, y, py, px, score): tile pixels with the score of the cell their centre falls in: null outside the raster, 0 on water."""
    rows, cols = _axes(meta, size)
    # a strip is small and becomes up to size * CHUNK rows: adaptive execution would leave few tasks for them
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = tile_strips(tiles, scores, meta, size).repartition(tasks, "z", "x", "y", "row")
    # the axes are arguments of transform(), never used inside a lambda, so each is computed once a strip
    pys = F.filter(F.transform(rows, lambda r, i: F.when(r == F.col("row"), i)), lambda p: p.isNotNull())
    line = F.filter(F.transform(cols, lambda c, i: F.struct(i.alias("px"), _shown(c).alias("score"))), lambda x: x["score"].isNotNull())
    inside = strips.select("z", "x", "y", pys.alias("pys"), line.alias("line")).select("z", "x", "y", F.explode("pys").alias("py"), "line").select("z", "x", "y", "py", F.inline("line"))
    axes = tiles.withColumn("rows", rows).withColumn("cols", cols).where(F.exists("rows", lambda v: v.isNull()) | F.exists("cols", lambda v: v.isNull()))
    blank = axes.select("z", "x", "y", F.posexplode("rows").alias("py", "r"), "cols").select("z", "x", "y", "py", "r", F.posexplode("cols").alias("px", "c")).where("r is null or c is null")
    return inside.unionByName(blank.select("z", "x", "y", "py", "px", F.lit(None).cast("double").alias("score")))


def tile_rgba(pixels: DataFrame, palette: bool = False) -> DataFrame:
    """Tile pixels with ramp index and colour; transparent outside the raster."""
    score = F.coalesce("score", F.lit(0.0))
    index = ramp_index(score)
    return pixels.withColumn("ci", index).withColumn("c", palette_colour(score) if palette else ramp_colour(index)).select("z", "x", "y", "py", "px", "ci", "c.r", "c.g", "c.b", "c.a")


def tile_tops(tiles: DataFrame, scores: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """(z, x, y, top) of all tiles: the highest score of a pixel, null outside the raster; no pixel becomes a row."""
    _, cols = _axes(meta, size)
    top = tile_strips(tiles, scores, meta, size).select("z", "x", "y", F.array_max(F.transform(cols, _shown)).alias("top"))
    return tiles.join(top.groupBy("z", "x", "y").agg(F.max("top").alias("top")), ["z", "x", "y"], "left")


def visible_tiles(tops: DataFrame, threshold: float = VISIBLE_THRESHOLD) -> DataFrame:
    """The rows of tile_tops() with some pixel that shows."""
    return tops.where(F.col("top") >= threshold)


def tile_counts(tops: DataFrame, threshold: float = VISIBLE_THRESHOLD) -> DataFrame:
    """(z, tiles, rendered, skipped) for each zoom and, with z null, for all, from tile_tops()."""
    shown = F.count_if(F.coalesce(F.col("top") >= threshold, F.lit(False)))
    return tops.rollup("z").agg(F.count("*").alias("tiles"), shown.alias("rendered"), (F.count("*") - shown).alias("skipped"))


def png(rgba: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGBA PNG without filtering."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_pixels(image: bytes) -> np.ndarray:
    """(height, width, 4) of a PNG as png() writes it."""
    width, height, depth, kind = struct.unpack(">IIBB", image[16:26])
    if image[:8] != b"\x89PNG\r\n\x1a\n" or (depth, kind) != (8, 6):
        raise ValueError("not an 8-bit RGBA PNG")
    at, data = 8, b""
    while at < len(image):
        n, name = struct.unpack(">I4s", image[at : at + 8])
        data += image[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 4 * width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].reshape(height, width, 4)


#: What is served for a tile that does not exist.
TRANSPARENT = png(b"\0\0\0\0", 1, 1)


def tile_png(tiles: DataFrame, scores: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """(z, x, y, png): one image a tile, drawn from its raster strips; no pixel becomes a row.

    What meets in a row is a tile's strips, at most one for each pixel row and column, and its two axes.
    """
    colours = [tuple(r.c) for r in tiles.sparkSession.range(256).select("id", ramp_colour(F.col("id").cast("int")).alias("c")).orderBy("id").collect()]
    ramp = np.array(colours, np.uint8)
    rows, cols = _axes(meta, size)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = []
            for t in b.select(["rows", "cols", "strips"]).to_pylist():
                index = np.zeros((size, size), np.int64)
                own_rows, own_cols = (np.array([-1 if v is None else v for v in t[c]]) for c in ("rows", "cols"))
                for strip in t["strips"] or ():
                    if strip["v"] is not None:
                        px = np.flatnonzero(own_cols // CHUNK == strip["block"])
                        v = np.array([x or 0.0 for x in strip["v"]])[own_cols[px] % CHUNK]
                        index[np.ix_(np.flatnonzero(own_rows == strip["row"]), px)] = np.clip((v * 255).astype(np.int64), 0, 255)
                images.append(png(ramp[index].tobytes(), size, size))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in "zxy"), pa.array(images, pa.binary())], names=["z", "x", "y", "png"])

    strips = tile_strips(tiles, scores, meta, size).groupBy("z", "x", "y").agg(F.collect_list(F.struct("row", "block", "v")).alias("strips"))
    whole = tiles.withColumn("rows", rows).withColumn("cols", cols).join(strips, ["z", "x", "y"], "left")
    return whole.select("z", "x", "y", "rows", "cols", "strips").mapInArrow(draw, "z int, x int, y int, png binary")


def tile_digest(tiles: DataFrame) -> DataFrame:
    """(z, x, y, width, height, r, g, b, a, mix) of (z, x, y, png): the images' pixels, decoded and summed; mix depends on their places."""

    @F.pandas_udf("width int, height int, r long, g long, b long, a long, mix long")
    def read(images: pd.Series) -> pd.DataFrame:
        def one(image: bytes) -> tuple:
            m = png_pixels(image).astype(np.int64)
            place = np.arange(m.shape[0] * m.shape[1]).reshape(m.shape[:2]) % 251 + 1
            return (m.shape[1], m.shape[0], *m.sum((0, 1)).tolist(), int(((m @ np.array([1, 2, 3, 5])) * place).sum()))

        return pd.DataFrame([one(x) for x in images], columns=["width", "height", "r", "g", "b", "a", "mix"])

    return tiles.select("z", "x", "y", read("png").alias("d")).select("z", "x", "y", "d.*")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Columns(WriterCommitMessage):
    attempt: str
    #: The (z, x) whose tiles the attempt has written.
    found: list[tuple[int, int]]


class TileTreeWriter(DataSourceArrowWriter):
    """Every attempt of a task writes whole columns {z}/{x} of tiles in a folder of its own; the commit moves those of the attempts that count.

    So the driver moves a folder a column and no tile, and what lost, repeated or failed attempts wrote goes with their folder.
    """

    def __init__(self, root: str):
        self.root, self.place = root, f"{root}/_uncommitted-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Columns:
        system, inner = _system(self.place)
        attempt, found = uuid.uuid4().hex, set()
        for b in iterator:
            for z, x, y, image in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "png")), strict=True):
                folder = f"{inner}/{attempt}/{z}/{x}"
                if (z, x) not in found:
                    system.create_dir(folder, recursive=True)
                    found.add((z, x))
                with system.open_output_stream(f"{folder}/{y}.png") as f:
                    f.write(image)
        return Columns(attempt, sorted(found))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.root)
        _, place = _system(self.place)
        for m in messages:
            for z, x in m.found if m else ():
                system.create_dir(f"{inner}/{z}", recursive=True)
                if system.get_file_info(f"{inner}/{z}/{x}").type.name == "Directory":
                    system.delete_dir(f"{inner}/{z}/{x}")
                system.move(f"{place}/{m.attempt}/{z}/{x}", f"{inner}/{z}/{x}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = _system(self.place)
        if system.get_file_info(place).type.name == "Directory":
            system.delete_dir(place)


class TileTree(DataSource):
    """df.write.format("tile_tree") of (z, x, y, png), each column (z, x) in one task."""

    @classmethod
    def name(cls) -> str:
        return "tile_tree"

    def writer(self, schema, overwrite: bool) -> TileTreeWriter:
        return TileTreeWriter(self.options["path"])


def write_tile_tree(tiles: DataFrame, path: str, layer: str) -> DataFrame:
    """Write (z, x, y, png) as {path}/{layer}/{z}/{x}/{y}.png; returns (z, x, y, bytes) of the layer's files.

    A column {z}/{x} that is written replaces an earlier one; nothing changes before all tasks have ended well.
    """
    spark = tiles.sparkSession
    spark.dataSource.register(TileTree)
    root = f"{path.rstrip('/')}/{layer}"
    tiles.select("z", "x", "y", "png").repartition("z", "x").sortWithinPartitions("z", "x", "y").write.format("tile_tree").mode("append").option("path", root).save()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root)
    return files.select(*[_named(i + 2).cast("int").alias(n) for i, n in enumerate("zxy")], F.col("length").alias("bytes"))


def _named(i: int) -> Column:
    return F.regexp_extract("path", r"([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\.png$", i)


def read_tile_tree(spark: SparkSession, path: str) -> DataFrame:
    """(layer, z, x, y, png) of a tree of tiles."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return files.select(_named(1).alias("layer"), *[_named(i + 2).cast("int").alias(n) for i, n in enumerate("zxy")], F.col("content").alias("png"))


def served(wanted: DataFrame, tiles: DataFrame) -> DataFrame:
    """Requested (z, x, y) with their image, or the transparent one."""
    return wanted.join(tiles, ["z", "x", "y"], "left").withColumn("png", F.coalesce("png", F.lit(TRANSPARENT)))
