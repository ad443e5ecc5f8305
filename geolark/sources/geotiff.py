"""GeoTIFF rasters: a Python data source that reads one task a row of blocks, and a writer of a mosaic of files.

Of each file the driver reads the directory only. Strips and tiles, both byte orders, 32- and 64-bit offsets, bands together or apart,
whole numbers and floats of 8 to 64 bits, no compression, deflate and LZW, with the horizontal and the floating-point predictor.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import GridMeta
from .grid_file import _system

# Tags, value types and codes of the TIFF and GeoTIFF formats.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NO_DATA = 33550, 33922, 42113
VALUE_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
PLAIN, HORIZONTAL, FLOATING = 1, 2, 3
KINDS = {1: "u", 2: "i", 3: "f"}

ROW = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


@dataclass
class Directory:
    """What the first directory of a file says. A block is a strip or a tile; blocks of separate bands follow each other band by band."""

    width: int
    height: int
    bands: int
    kind: str
    order: str
    compression: int
    predictor: int
    separate: bool
    block_width: int
    block_height: int
    offsets: list[int]
    counts: list[int]
    scale: list[float] = field(default_factory=list)
    tie: list[float] = field(default_factory=list)
    no_data: float | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)


def read_directory(f) -> Directory:
    """The directory of an open, seekable file. What is no TIFF, or of a kind not read, is an error."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order or '<'}H", head[2:4])[0]
    if order is None or version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    f.seek(at)
    n = struct.unpack(f"{order}Q", f.read(8))[0] if big else struct.unpack(f"{order}H", f.read(2))[0]
    size, inline = (20, 8) if big else (12, 4)
    entries = f.read(n * size)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", entries[i * size : i * size + size - inline])
        if kind not in VALUE_TYPES:
            continue
        whole = struct.calcsize(VALUE_TYPES[kind]) * count
        raw = entries[(i + 1) * size - inline : (i + 1) * size]
        if whole > inline:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", raw)[0])
            raw = f.read(whole)
        tags[tag] = (raw[:whole].split(b"\0")[0].decode(),) if kind == 2 else struct.unpack(f"{order}{count}{VALUE_TYPES[kind]}", raw[:whole])
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, formats = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    if len(bits) > 1 or len(formats) > 1 or not bits <= {8, 16, 32, 64} or not formats <= set(KINDS):
        raise ValueError(f"samples of {sorted(bits)} bits and formats {sorted(formats)} are not read")
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, PLAIN)
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (PLAIN, HORIZONTAL, FLOATING):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    tiled = TILE_OFFSETS in tags
    no_data = one(NO_DATA)
    return Directory(
        width, height, bands, f"{KINDS[formats.pop()]}{bits.pop() // 8}", order, compression, predictor, one(PLANAR, 1) == 2,
        one(TILE_WIDTH) if tiled else width, one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height),
        list(tags[TILE_OFFSETS if tiled else OFFSETS]), list(tags[TILE_COUNTS if tiled else COUNTS]),
        list(tags.get(PIXEL_SCALE, ())), list(tags.get(TIE_POINT, ())), float(no_data) if no_data not in (None, "") else None,
    )


def lzw_decoded(data: bytes) -> bytes:
    """The TIFF kind of LZW: codes of 9 to 12 bits, highest bit first, widened one code early; 256 clears the table, 257 ends."""
    table: list[bytes] = []
    out: list[bytes] = []
    bits = held = 0
    width, last = 9, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data don't begin with a clear code")
        if last:
            table.append(last + (table[code][:1] if code < len(table) else last[:1]))
        last = table[code]
        out.append(last)
        width = 9 + (len(table) >= 510) + (len(table) >= 1022) + (len(table) >= 2046)
    return b"".join(out)


def decoded(raw: bytes, d: Directory, samples: int) -> np.ndarray:
    """(rows, block_width, samples) of one block; the last strip of a file has fewer rows."""
    if d.compression == LZW:
        raw = lzw_decoded(raw)
    elif d.compression != NONE:
        raw = zlib.decompress(raw)
    item = int(d.kind[1])
    line = d.block_width * samples * item
    rows = len(raw) // line
    raw = raw[: rows * line]
    if d.predictor == FLOATING:
        b = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples)
        b = np.add.accumulate(b, 1, dtype=np.uint8).reshape(rows, item, -1)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(f">{d.kind}").reshape(rows, d.block_width, samples)
    m = np.frombuffer(raw, f"{d.order}{d.kind}").reshape(rows, d.block_width, samples)
    if d.predictor == HORIZONTAL:
        whole = m.astype(f"u{item}", copy=False) if d.kind[0] != "f" else m
        m = np.add.accumulate(whole, 1, dtype=whole.dtype.newbyteorder("=")).astype(d.kind)
    return m


def encoded(m: np.ndarray, order: str = "<", compression: int = DEFLATE, predictor: int = PLAIN, block: tuple[int, int] | None = None, strip_rows: int = 16, separate: bool = False, scale: tuple = (), tie: tuple = (), no_data: str = "") -> bytes:
    """A TIFF file of (rows, cols, bands): tiles of `block` (height, width), or strips."""
    height, width, bands = m.shape
    item, kind = m.dtype.itemsize, m.dtype.kind
    rows, cols = block or (min(strip_rows, height), width)

    def pack(part: np.ndarray) -> bytes:
        if predictor == HORIZONTAL:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
        if predictor == FLOATING:
            b = part.astype(f">{kind}{item}").view(np.uint8).reshape(part.shape[0], -1, item).transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
            raw = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1).tobytes()
        else:
            raw = part.astype(f"{order}{kind}{item}").tobytes()
        return zlib.compress(raw) if compression == DEFLATE else raw

    blocks = []
    for plane in [m[:, :, i : i + 1] for i in range(bands)] if separate else [m]:
        for r in range(0, height, rows):
            for c in range(0, width, cols):
                part = plane[r : r + rows, c : c + cols]
                blocks.append(pack(np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1]), (0, 0))) if block else part))
    code = {v: k for k, v in KINDS.items()}[kind]
    places = (TILE_OFFSETS, TILE_COUNTS) if block else (OFFSETS, COUNTS)
    tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * item] * bands), COMPRESSION: (3, [compression]), 262: (3, [1]), SAMPLES: (3, [bands]), PLANAR: (3, [2 if separate else 1]), PREDICTOR: (3, [predictor]), FORMAT: (3, [code] * bands)}
    tags |= {TILE_WIDTH: (4, [cols]), TILE_HEIGHT: (4, [rows])} if block else {STRIP_ROWS: (4, [rows])}
    tags |= {places[0]: (4, [0] * len(blocks)), places[1]: (4, [len(b) for b in blocks])}
    tags |= {PIXEL_SCALE: (12, list(scale))} if scale else {}
    tags |= {TIE_POINT: (12, list(tie))} if tie else {}
    tags |= {NO_DATA: (2, [bytes([c]) for c in no_data.encode() + b"\0"])} if no_data else {}
    more_at = 8 + 2 + 12 * len(tags) + 4
    sizes = {t: struct.calcsize(VALUE_TYPES[k]) * len(v) for t, (k, v) in tags.items()}
    data_at = more_at + sum(s + s % 2 for s in sizes.values() if s > 4)
    ends = np.cumsum([0, *map(len, blocks)]).tolist()
    tags[places[0]] = (4, [data_at + e for e in ends[:-1]])
    out, more = struct.pack(f"{order}2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(tags)), b""
    for tag, (k, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{VALUE_TYPES[k]}", *values)
        if len(raw) > 4:
            place = struct.pack(f"{order}I", more_at + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        out += struct.pack(f"{order}HHI", tag, k, len(values)) + place
    return out + bytes(4) + more + b"".join(blocks)


@dataclass
class BlockRow(InputPartition):
    path: str
    directory: Directory
    nth: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str):
        system, inner = _system(path)
        info = system.get_file_info(inner)
        files = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        self.system = path
        self.files = sorted(x.path for x in files if x.type == fs.FileType.File and (info.type == fs.FileType.File or x.path.lower().endswith((".tif", ".tiff"))))

    def partitions(self) -> list[BlockRow]:
        out = []
        system, _ = _system(self.system)
        for path in self.files:
            with system.open_input_file(path) as f:
                d = read_directory(f)
            for i in range(d.down):  # a task gets the places of its own blocks only
                own = [b * d.across * d.down + i * d.across + k for b in range(d.bands if d.separate else 1) for k in range(d.across)]
                part = Directory(**{**d.__dict__, "offsets": [d.offsets[k] for k in own], "counts": [d.counts[k] for k in own]})
                out.append(BlockRow(path, part, i))
        return out

    def read(self, part: BlockRow) -> Iterator[pa.RecordBatch]:
        d = part.directory
        system, _ = _system(self.system)
        with system.open_input_file(part.path) as f:
            blocks = []
            for at, n in zip(d.offsets, d.counts, strict=True):
                f.seek(at)
                blocks.append(decoded(f.read(n), d, 1 if d.separate else d.bands))
        planes = [np.concatenate(blocks[i : i + d.across], 1) for i in range(0, len(blocks), d.across)]
        first = part.nth * d.block_height
        m = np.concatenate(planes, 2)[: d.height - first, : d.width].astype(np.float64)
        missing = np.isnan(m).any(2) if d.no_data is None or np.isnan(d.no_data) else (m == d.no_data).any(2) | np.isnan(m).any(2)
        cols = np.arange(d.width)
        placed = len(d.scale) >= 2 and len(d.tie) >= 6
        for i in range(len(m)):
            flat = np.where(missing[i][:, None], 0.0, m[i])
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), d.bands, mask=pa.array(missing[i])).cast(pa.list_(pa.float64()))
            lat = d.tie[4] - (first + i - d.tie[1] + 0.5) * d.scale[1] if placed else None
            lng = d.tie[3] + (cols - d.tie[0] + 0.5) * d.scale[0] if placed else None
            n = d.width
            cells = [pa.array([part.path] * n), pa.array(np.full(n, first + i, np.int32)), pa.array(cols.astype(np.int32)), pa.array(np.full(n, lat)) if placed else pa.nulls(n, pa.float64()), pa.array(lng) if placed else pa.nulls(n, pa.float64()), vectors]
            yield pa.RecordBatch.from_arrays(cells, names=ROW.names)


@dataclass
class Files(WriterCommitMessage):
    attempt: str
    names: list[str]


class GeoTiffWriter(DataSourceArrowWriter):
    """A file each for the blocks of raster rows; attempts write in folders of their own, the commit moves the files of those that count."""

    def __init__(self, path: str, meta: GridMeta, bands: int, rows: int):
        self.path, self.meta, self.bands, self.rows = path, meta, bands, rows
        self.place = f"{path}/_uncommitted-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        m, attempt, names = self.meta, uuid.uuid4().hex, []
        system, inner = _system(self.place)
        system.create_dir(f"{inner}/{attempt}", recursive=True)
        part, cells = None, None

        def put() -> None:
            tie = (0.0, 0.0, 0.0, m.west, m.north - part * self.rows * m.cell_h, 0.0)
            with system.open_output_stream(f"{inner}/{attempt}/rows-{part}.tif") as f:
                f.write(encoded(cells, predictor=FLOATING, scale=(m.cell_w, m.cell_h, 0.0), tie=tie, no_data="nan"))
            names.append(f"rows-{part}.tif")

        for b in iterator:
            parts, pixel = b.column("part").to_numpy(), b.column("pixel").to_numpy()
            for p in np.unique(parts).tolist():
                if p != part:
                    if part is not None:
                        put()
                    part = p
                    cells = np.full((min(m.height, (p + 1) * self.rows) - p * self.rows, m.width, self.bands), np.nan, np.float32)
                own = np.flatnonzero((parts == p) & ~b.column("v").is_null().to_numpy(zero_copy_only=False))
                at = pixel[own] - p * self.rows * m.width
                cells[at // m.width, at % m.width] = b.column("v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), self.bands)
        if part is not None:
            put()
        return Files(attempt, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.path)
        _, place = _system(self.place)
        for x in messages:
            for name in x.names if x else ():
                system.move(f"{place}/{x.attempt}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = _system(self.place)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").option("path", a file or a folder).load()"""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> T.StructType:
        return ROW

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options["path"], GridMeta(*json.loads(self.options["meta"])), int(self.options["bands"]), int(self.options["rows"]))


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, lat, lng, v): a row a pixel of a file or of all files in a folder, v its bands.

    row and col count within the file; lat and lng are the pixel's centre, null in a file without a place. A pixel in which a band has
    no data (the file's value, or NaN) has a null vector.
    """
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").option("path", path).load()


def write_geotiffs(cells: DataFrame, path: str, meta: GridMeta, bands: int, vector: str = "v", rows: int = 64) -> None:
    """(pixel, v) as a mosaic of GeoTIFF files of `rows` raster rows each: float32, deflate, floating-point predictor. Missing cells and null vectors have no data."""
    cells.sparkSession.dataSource.register(GeoTiffSource)
    numbers = json.dumps([meta.width, meta.height, meta.west, meta.south, meta.east, meta.north])
    keyed = cells.select(F.floor(F.col("pixel") / (meta.width * rows)).cast("int").alias("part"), "pixel", F.col(vector).cast("array<float>").alias("v"))
    dealt = keyed.repartition("part").sortWithinPartitions("part")
    dealt.write.format("geotiff").mode("append").option("path", path).option("meta", numbers).option("bands", str(bands)).option("rows", str(rows)).save()


def pixel_of(lat: Column, lng: Column, meta: GridMeta) -> Column:
    """The cell of a raster in which a pixel's centre lies."""
    return (F.floor((meta.north - lat) / meta.cell_h) * meta.width + F.floor((lng - meta.west) / meta.cell_w)).cast("long")
