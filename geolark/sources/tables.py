"""Tables around the raster: synthetic cells, layers, farms, scores, weather and soil."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DIMS, FARMS_CSV, LAYERS_JSON, GridMeta
from .grid_file import _system

# The field names of the replies.
WEATHER = "daily struct<temperature_2m_mean:array<double>,temperature_2m_min:array<double>,temperature_2m_max:array<double>,precipitation_sum:array<double>,relative_humidity_2m_mean:array<double>,sunshine_duration:array<double>>, hourly struct<cloud_cover:array<double>>"
SOIL = "properties struct<layers:array<struct<name:string,depths:array<struct<values:struct<mean:double>>>>>>"


def synthetic_cells(spark: SparkSession, meta: GridMeta, land: float = 0.7, seed: int = 42) -> DataFrame:
    """(pixel, row, col, is_land, q): hashed values, the same on every run; about `land` of the cells are land."""
    value = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(255)) - 127
    q = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda b: (F.pmod(F.xxhash64("id", b, F.lit(seed)), F.lit(255)) - 127).cast("byte"))
    rows = spark.range(meta.width * meta.height)
    is_land = (value(-1) + 127) < 255 * land
    return rows.select(F.col("id").alias("pixel"), F.expr(f"cast(id div {meta.width} as int)").alias("row"), (F.col("id") % meta.width).cast("int").alias("col"), is_land.alias("is_land"), q.alias("q"))


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, category, featured, pins, top_matches) of a JSON map keyed by layer."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n(?=\\{)")).alias("value"))
    return text.select(F.explode(F.from_json("value", LAYERS_JSON)).alias("id", "layer")).select("id", "layer.*")


def layer_pins(layers: DataFrame) -> DataFrame:
    return layers.select(F.col("id").alias("layer_id"), F.posexplode("pins").alias("pin_idx", "pin")).select("layer_id", "pin_idx", "pin.*")


def write_layers(layers: DataFrame, path: str) -> None:
    """The JSON map that read_layers() takes, keyed by layer; one map a file, so that no task gets all layers."""
    body = F.struct(*[c for c in layers.columns if c != "id"])
    layers.select(F.to_json(F.create_map("id", body)).alias("value")).write.text(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(layer_id, name, category, region, west, south, east, north): the boxes of a JSON map of layers with named regions."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n(?=\\{)")).alias("value"))
    schema = "map<string, struct<name: string, category: string, regions: map<string, array<double>>>>"
    layers = text.select(F.explode(F.from_json("value", schema)).alias("layer_id", "l"))
    boxes = layers.select("layer_id", "l.name", "l.category", F.explode("l.regions").alias("region", "b"))
    return boxes.select("layer_id", "name", "category", "region", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


def read_farms(spark: SparkSession, path: str, crop: str | None = None) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=FARMS_CSV)
    return rows if crop is None else rows.where(F.lower("crop") == crop.lower())


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores by layer, sorted by pixel within a file, so that a layer or a range of pixels is read alone."""
    scores.repartitionByRange("layer_id", "pixel").sortWithinPartitions("layer_id", "pixel").write.partitionBy("layer_id").mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str, layer: str | None = None, schema: str | None = None) -> DataFrame:
    """All layers, or one by partition pruning; nothing is read before it is used. Corrupt files are left out; unreadable_files() names them.

    Without a schema the footers of all files are read, as any single one may be corrupt.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true")
    rows = (reader.schema(schema) if schema else reader.option("mergeSchema", "true")).parquet(path)
    return rows if layer is None else rows.where(F.col("layer_id") == layer)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the Parquet files under a path that lack the format's mark at either end. Tasks read eight bytes of each, whatever its size."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for file in b.column(0).to_pylist():
                system, inner = _system(unquote(file) if file.startswith("file:") else file)
                with system.open_input_file(inner) as f:
                    if f.size() < 12 or f.read_at(4, 0) != b"PAR1" or f.read_at(4, f.size() - 4) != b"PAR1":
                        bad.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path").mapInArrow(check, "file string")


def write_npy(rows: DataFrame, path: str, vector: str, key: str = "id", dims: int = DIMS) -> None:
    """Vectors as NumPy files for other tools: a folder with vectors-<n>.npy (float32, a row a vector) and ids-<n>.npy for every task that has rows."""
    where, name = _system(path), uuid.uuid4().hex
    where[0].create_dir(f"{where[1]}/{name}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(path)
        attempt, n = uuid.uuid4().hex, 0
        for b in batches:
            if not len(b):
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(b), dims)
            for kind, values in (("ids", b.column(0).to_numpy()), ("vectors", m)):
                with system.open_output_stream(f"{inner}/{name}/{kind}-{attempt}-{n}.npy") as f:
                    np.save(f, values)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([attempt]), pa.array([n])], names=["attempt", "n"])

    known = rows.where(F.size(vector) == dims).select(F.col(key).cast("long"), F.col(vector).cast("array<float>"))
    done = known.mapInArrow(write, "attempt string, n long").collect()  # a row a task
    at = 0
    for r in done:  # the files of attempts that count; what others left goes with the folder
        for i in range(r.n):
            for kind in ("ids", "vectors"):
                where[0].move(f"{where[1]}/{name}/{kind}-{r.attempt}-{i}.npy", f"{where[1]}/{kind}-{at}.npy")
            at += 1
    where[0].delete_dir(f"{where[1]}/{name}")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a folder of NumPy files as write_npy() writes them."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                system, inner = _system(unquote(file) if file.startswith("file:") else file)
                ids, m = (np.load(io.BytesIO(system.open_input_stream(inner.replace("/vectors-", f"/{kind}-")).read())) for kind in ("ids", "vectors"))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors], names=["id", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "vectors-*.npy").load(path)
    return files.select("path").mapInArrow(load, "id long, v array<float>")


def weather_days(replies: DataFrame, place: str = "place", body: str = "body") -> DataFrame:
    """Daily rows out of JSON replies: (place, temp_mean, temp_min, temp_max, rain, humidity, sunshine, cloud)."""
    r = replies.select(place, F.from_json(body, WEATHER).alias("r"))
    d = "r.daily."
    known = lambda c: F.coalesce(F.col(c), F.array().cast("array<double>"))  # noqa: E731  a missing measure must not lose the others
    lists = [known(d + c) for c in ("temperature_2m_mean", "temperature_2m_min", "temperature_2m_max", "precipitation_sum", "relative_humidity_2m_mean", "sunshine_duration")]
    names = ["temp_mean", "temp_min", "temp_max", "rain", "humidity", "sunshine"]
    days = r.select(place, F.explode_outer(F.arrays_zip(*[x.alias(n) for n, x in zip(names, lists, strict=True)], known("r.hourly.cloud_cover").alias("cloud"))).alias("d"))
    return days.select(place, *[F.col(f"d.{n}").alias(n) for n in (*names, "cloud")])


def soil_values(replies: DataFrame, place: str = "place", body: str = "body") -> DataFrame:
    """(place, phh2o, soc, nitrogen, sand, clay, silt): mean of the first depth of each property."""
    layers = replies.select(place, F.explode(F.from_json(body, SOIL)["properties"]["layers"]).alias("l"))
    values = layers.select(place, F.col("l.name").alias("name"), F.get(F.col("l.depths"), F.lit(0))["values"]["mean"].alias("v"))
    return values.groupBy(place).pivot("name", ["phh2o", "soc", "nitrogen", "sand", "clay", "silt"]).agg(F.first("v"))


def search_places(places: DataFrame, text: str, most: int = 5) -> DataFrame:
    """Forward search: the places whose name holds the text, whatever the case; names that begin with it first, then shorter ones, then by name."""
    name, q = F.lower("name"), F.lit(text.strip().lower())
    found = places.where(F.contains(name, q)).withColumn("_late", ~F.startswith(name, q))
    return found.orderBy("_late", F.length("name"), "name").limit(most).drop("_late")


def geocoded(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points joined to known places by their coordinates at four decimals."""
    key = F.format_string("%.4f,%.4f", F.col("lat"), F.col("lng"))
    return points.withColumn("key", key).join(places, "key", "left")
