"""Binary rasters of int8 vectors: a Python data source that splits a file by rows, takes filters, and writes with a commit.

Layout, little endian: magic, u32 version, bands, width, height; f64 west, south, east, north; f32 scale and f32 offset for each band;
int8 values row by row, bands innermost; one land bit a cell, highest bit first. After ingest the raster lives in Parquet.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import CELL, DIMS, GridMeta

MAGIC, VERSION = b"TRGRID01", 1
HEADER = struct.Struct("<8s4I4d")
#: Cells between two wanted ones up to which they are read together.
GAP = 64


def _system(path: str):
    """The file system of a path, as Arrow knows it, and the path in it; plain paths are local."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _open(path: str):
    """A seekable file."""
    system, inner = _system(path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Header:
    meta: GridMeta
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def data_at(self) -> int:
        return HEADER.size + 8 * DIMS


def read_header(path: str) -> Header:
    """Size, placement and band scales, without the cells. Wrong magic, version or bands are errors."""
    with _open(path) as f:
        magic, version, bands, width, height, *box = HEADER.unpack(f.read(HEADER.size))
        if magic != MAGIC or version != VERSION or bands != DIMS:
            raise ValueError(f"{path} is no raster of {DIMS} bands: {magic!r}, version {version}, {bands} bands")
        floats = np.frombuffer(f.read(8 * DIMS), "<f4")
    return Header(GridMeta(width, height, *box), tuple(floats[:DIMS].tolist()), tuple(floats[DIMS:].tolist()))


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class GridReader(DataSourceReader):
    """Reads the rows and columns that filters leave, land bits first: with a filter on land, vectors of water are not read."""

    def __init__(self, path: str, rows_per_task: int, columns: list[str]):
        self.path, self.step, self.columns = path, rows_per_task, columns
        self.header = read_header(path)
        m = self.header.meta
        self.upto = {"row": m.height, "col": m.width, "pixel": m.height * m.width}
        self.since = dict.fromkeys(self.upto, 0)
        self.land_only = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of row, col and pixel with whole numbers and is_land = true; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(f, IsNotNull) and name in CELL.names:
                continue  # no column has nulls
            if isinstance(f, EqualTo) and name == "is_land" and value is True:
                self.land_only = True
            elif name in self.upto and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.since[name] = max(self.since[name], value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.upto[name] = min(self.upto[name], value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        w = self.header.meta.width
        first = max(self.since["row"], self.since["pixel"] // w)
        last = min(self.upto["row"], -(-self.upto["pixel"] // w))
        return [Rows(a, min(last, a + self.step)) for a in range(first, last, self.step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        m, at = self.header.meta, self.header.data_at
        w = m.width
        with _open(self.path) as f:

            def raw(begin: int, n: int) -> np.ndarray:
                f.seek(begin)
                out = np.frombuffer(f.read(n), np.uint8)
                if len(out) != n:
                    raise ValueError(f"{self.path} ends before byte {begin + n}")
                return out

            for row in range(part.first, part.last):
                first = max(self.since["col"], self.since["pixel"] - row * w)
                last = min(self.upto["col"], self.upto["pixel"] - row * w)
                if first >= last:
                    continue
                bit, n = row * w + first, last - first
                land = np.unpackbits(raw(at + m.height * w * DIMS + bit // 8, (bit + n + 7) // 8 - bit // 8))[bit % 8 : bit % 8 + n].astype(bool)
                cells = np.flatnonzero(land) if self.land_only else np.arange(n)
                if not len(cells):
                    continue
                found = {"pixel": pa.array(bit + cells), "row": pa.array(np.full(len(cells), row, np.int32)), "col": pa.array((first + cells).astype(np.int32)), "is_land": pa.array(land[cells])}
                if "q" in self.columns:
                    cuts = np.flatnonzero(np.diff(cells) > GAP) + 1  # one read for cells close together
                    runs = zip(np.concatenate([cells[:1], cells[cuts]]).tolist(), np.append(cells[cuts - 1], cells[-1]).tolist(), strict=True)
                    q = np.concatenate([raw(at + (bit + a) * DIMS, (z - a + 1) * DIMS).reshape(-1, DIMS)[land[a : z + 1] if self.land_only else slice(None)] for a, z in runs])
                    found["q"] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) * DIMS + 1, DIMS), pa.int32()), pa.array(q.view(np.int8).ravel()))
                yield pa.RecordBatch.from_arrays([found[c] for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    #: (part, the attempt that wrote it)
    parts: list[tuple[int, str]]


class GridWriter(DataSourceArrowWriter):
    """Tasks write parts of whole raster rows; the driver sees their names only.

    On a file system with seeking the parts go to their places in one new file, where a repeated attempt writes the same bytes again,
    and the commit gives it its name. Elsewhere each attempt writes files of its own, the commit has one task join those of the
    attempts that succeeded, and the rest is deleted.
    """

    def __init__(self, path: str, header: Header, rows_per_part: int):
        self.path, self.header, self.step = path, header, rows_per_part
        self.place = f"{path}.{uuid.uuid4().hex}"  # where what is not committed lies
        self.in_place = isinstance(_system(path)[0], fs.LocalFileSystem)
        m = header.meta
        self.head = HEADER.pack(MAGIC, VERSION, DIMS, m.width, m.height, m.west, m.south, m.east, m.north) + np.asarray(header.scale + header.offset, "<f4").tobytes()
        self.land_at = header.data_at + m.width * m.height * DIMS
        self.size = self.land_at + -(-m.width * m.height // 8)
        if self.in_place:
            os.makedirs(os.path.dirname(os.path.abspath(_system(path)[1])), exist_ok=True)
            with open(_system(self.place)[1], "wb") as f:
                f.write(self.head)
                f.truncate(self.size)  # cells that nobody writes are water

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        m, attempt, done = self.header.meta, uuid.uuid4().hex, []
        part, data, land = None, None, None

        def put() -> None:
            first = part * self.step * m.width
            if self.in_place:
                with open(_system(self.place)[1], "r+b") as f:
                    f.seek(self.header.data_at + first * DIMS)
                    f.write(data.tobytes())
                    f.seek(self.land_at + first // 8)
                    f.write(np.packbits(land).tobytes())
            else:
                system, inner = _system(self.place)
                system.create_dir(inner, recursive=True)
                for name, raw in (("data", data.tobytes()), ("land", np.packbits(land).tobytes())):
                    with system.open_output_stream(f"{inner}/{name}-{part}-{attempt}") as f:
                        f.write(raw)
            done.append((part, attempt))

        for b in iterator:
            parts, pixel, is_land = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "pixel", "is_land"))
            for p in np.unique(parts).tolist():
                if p != part:
                    if part is not None:
                        put()
                    part = p
                    rows = min(m.height, (p + 1) * self.step) - p * self.step
                    data, land = np.zeros((rows * m.width, DIMS), np.int8), np.zeros(rows * m.width, bool)
                own = np.flatnonzero((parts == p) & is_land.astype(bool))
                at = pixel[own] - p * self.step * m.width
                land[at] = True
                q = b.column("q").take(pa.array(own))
                data[at] = q.flatten().to_numpy(zero_copy_only=False).reshape(len(own), DIMS) if len(own) else data[at]
        if part is not None:
            put()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.path)
        if self.in_place:
            os.replace(_system(self.place)[1], inner)
            return
        spark = SparkSession.getActiveSession()
        names = dict(p for x in messages if x for p in x.parts)
        spark.range(1).mapInArrow(lambda batches: self._join(batches, names), "bytes long").collect()
        self.abort(messages)

    def _join(self, batches: Iterator[pa.RecordBatch], names: dict[int, str]) -> Iterator[pa.RecordBatch]:
        m, n = self.header.meta, 0
        system, inner = _system(self.path)
        with system.open_output_stream(inner) as out:
            n += out.write(self.head) or len(self.head)
            for name, bits in (("data", 8 * DIMS), ("land", 1)):
                for part in range(-(-m.height // self.step)):
                    rows = min(m.height, (part + 1) * self.step) - part * self.step
                    if part not in names:
                        out.write(bytes(-(-rows * m.width * bits // 8)))
                        continue
                    with system.open_input_stream(f"{_system(self.place)[1]}/{name}-{part}-{names[part]}") as f:
                        while raw := f.read(1 << 20):
                            out.write(raw)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([self.size])], names=["bytes"])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.place)
        kind = system.get_file_info(inner).type
        if kind == fs.FileType.Directory:
            system.delete_dir(inner)
        elif kind == fs.FileType.File:
            system.delete_file(inner)


class GridSource(DataSource):
    """spark.read.format("vector_grid").option("path", ...).load(), and df.write of (part, pixel, is_land, q) sorted by part."""

    @classmethod
    def name(cls) -> str:
        return "vector_grid"

    def _columns(self) -> list[str]:
        return self.options.get("columns", ",".join(CELL.names)).split(",")

    def schema(self) -> T.StructType:
        return T.StructType([CELL[c] for c in self._columns()])

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"], int(self.options.get("rowsPerTask", "64")), self._columns())

    def writer(self, schema, overwrite: bool) -> GridWriter:
        o = self.options
        numbers = json.loads(o["header"])
        return GridWriter(o["path"], Header(GridMeta(*numbers["meta"]), tuple(numbers["scale"]), tuple(numbers["offset"])), int(o["rowsPerPart"]))


def read_grid(spark: SparkSession, path: str, rows_per_task: int = 64, columns: list[str] | None = None) -> DataFrame:
    """(pixel, row, col, is_land, q) or some `columns` of these, one task every `rows_per_task` rows of the raster.

    Filters on row, col, pixel and is_land reach the file: only their byte ranges are read. A source in Python doesn't learn
    which columns a query uses, so a caller that needs no vectors says so.
    """
    spark.dataSource.register(GridSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("vector_grid").option("path", path).option("rowsPerTask", str(rows_per_task))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def write_grid_file(cells: DataFrame, path: str, header: Header, rows_per_part: int = 64) -> None:
    """The binary file of (pixel, is_land, q), for exchange with other tools; see GridWriter.

    Tasks write parts of `rows_per_part` (a multiple of 8) raster rows. Cells that are missing are water. An existing file is replaced
    when all is written; after a failure it is as it was.
    """
    if rows_per_part % 8:
        raise ValueError("rows_per_part must be a multiple of 8, so that land bits of parts begin on a byte")
    m = header.meta
    cells.sparkSession.dataSource.register(GridSource)
    numbers = json.dumps({"meta": [m.width, m.height, m.west, m.south, m.east, m.north], "scale": header.scale, "offset": header.offset})
    keyed = cells.select(F.floor(F.col("pixel") / (m.width * rows_per_part)).cast("int").alias("part"), "pixel", "is_land", F.col("q").cast("array<tinyint>").alias("q"))
    dealt = keyed.repartition("part").sortWithinPartitions("part")
    dealt.write.format("vector_grid").mode("append").option("path", path).option("header", numbers).option("rowsPerPart", str(rows_per_part)).save()
