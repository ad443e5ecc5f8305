"""Round trips of files, and streams against batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolark.operators import catalog
from geolark.schema import EVENT, GridMeta
from geolark.sources import grid_file as G
from geolark.sources import tables as S
from geolark.streaming import events as E


def test_grid_file(spark, tmp_path):
    meta = GridMeta(13, 7)
    cells = S.synthetic_cells(spark, meta)
    header = G.Header(meta, tuple(float(x) for x in np.linspace(1, 2, 64, dtype=np.float32)), (0.5,) * 64)
    path = str(tmp_path / "grid.bin")
    G.write_grid_file(cells, path, header)
    assert G.read_header(path) == header and G.read_header(path).data_at == 568
    want = {r.pixel: (r.row, r.col, r.is_land, list(r.q) if r.is_land else [0] * 64) for r in cells.collect()}
    got = {r.pixel: (r.row, r.col, r.is_land, list(r.q)) for r in G.read_grid(spark, path, 2).collect()}
    assert got == want and 0.4 < np.mean([v[2] for v in want.values()]) < 0.95
    assert G.read_grid(spark, path, 2).rdd.getNumPartitions() == 4
    bad = tmp_path / "bad.bin"
    bad.write_bytes(b"NOTAGRID" + bytes(600))
    with pytest.raises(ValueError, match="no raster"):
        G.read_header(str(bad))


class Counted:
    """A file that counts the bytes read."""

    def __init__(self, path, tally):
        self.f, self.tally = open(path, "rb"), tally

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        raw = self.f.read(n)
        self.tally.append(len(raw))
        return raw


def test_grid_filters_reach_the_file(spark, tmp_path, monkeypatch):
    meta = GridMeta(70, 40)
    path = str(tmp_path / "grid.bin")
    cells = S.synthetic_cells(spark, meta)
    G.write_grid_file(cells, path, G.Header(meta, (1.0,) * 64, (0.0,) * 64), 8)
    whole = G.read_grid(spark, path, 16)
    where = "row >= 7 and row < 21 and col > 10 and col <= 30 and is_land and pixel <> 800"
    got = G.read_grid(spark, path, 16).where(where)
    key = lambda r: (r.pixel, r.row, r.col, r.is_land, tuple(r.q))
    assert sorted(map(key, got.collect())) == sorted(key(r) for r in whole.collect() if 7 <= r.row < 21 and 10 < r.col <= 30 and r.is_land and r.pixel != 800)
    assert G.read_grid(spark, path).where("pixel between 100 and 299").count() == 200 and G.read_grid(spark, path).where("row > 99").count() == 0
    assert G.read_grid(spark, path, columns=["pixel", "is_land"]).columns == ["pixel", "is_land"]

    def bytes_of(filters, columns=("pixel", "row", "col", "is_land", "q")):
        tally = []
        reader = G.GridReader(path, 16, list(columns))
        left = list(reader.pushFilters(filters))
        monkeypatch.setattr(G, "_open", lambda p: Counted(p, tally))
        rows = sum(len(b) for part in reader.partitions() for b in reader.read(part))
        monkeypatch.undo()
        return sum(tally), rows, left

    everything = bytes_of([])
    assert everything[0] >= 70 * 40 * 64 and everything[1] == 2800
    some = bytes_of([G.GreaterThanOrEqual(("row",), 7), G.LessThan(("row",), 21), G.GreaterThan(("col",), 10), G.LessThanOrEqual(("col",), 30)])
    assert some[1] == 14 * 20 and some[0] < everything[0] / 8 and not some[2]
    monkeypatch.setattr(G, "GAP", 1)
    land = bytes_of([G.EqualTo(("is_land",), True), G.IsNotNull(("is_land",))])
    n = cells.where("is_land").count()
    assert land[1] == n and land[0] < n * 64 + 40 * 10 and not land[2]
    assert bytes_of([], ["pixel", "is_land"])[0] < 40 * 10
    other = [G.EqualTo(("is_land",), False), G.IsNotNull(("nowhere",))]
    assert bytes_of(other)[2] == other


def test_grid_writer_replaces_a_file_only_at_the_end(spark, tmp_path, monkeypatch):
    meta = GridMeta(9, 16)
    header = G.Header(meta, (1.0,) * 64, (0.0,) * 64)
    path = str(tmp_path / "grid.bin")
    cells = S.synthetic_cells(spark, meta)
    G.write_grid_file(cells, path, header, 8)
    before = (tmp_path / "grid.bin").read_bytes()
    with pytest.raises(Exception, match="no more"):
        G.write_grid_file(cells.withColumn("pixel", F.when(F.col("pixel") == 100, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("pixel"))), path, header, 8)
    assert (tmp_path / "grid.bin").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["grid.bin"]

    # where a file can't be written in the middle: an attempt that is lost leaves nothing in the result
    monkeypatch.setattr(G.fs, "LocalFileSystem", type("Other", (G.fs.LocalFileSystem,), {}))
    monkeypatch.setattr(G, "_system", lambda p: (G.fs.FileSystem.from_uri("file:///")[0], p))
    writer = G.GridWriter(str(tmp_path / "parts.bin"), header, 8)
    assert not writer.in_place
    table = cells.select(F.floor(F.col("pixel") / 72).cast("int").alias("part"), "pixel", "is_land", "q").orderBy("pixel").toArrow()

    def cut_off():
        yield table.to_batches()[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(cut_off())
    message = writer.write(iter(table.to_batches()))
    list(writer._join(iter([]), dict(message.parts)))
    writer.abort([])
    assert (tmp_path / "parts.bin").read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["grid.bin", "parts.bin"]


def test_synthetic_cells_repeat(spark):
    meta = GridMeta(40, 25)
    a, b = (S.synthetic_cells(spark, meta).agg(F.sum(F.xxhash64("pixel", "is_land", "q").cast("decimal(38,0)"))).first()[0] for _ in range(2))
    assert a == b


def test_layers_json(spark, tmp_path):
    layers = {"coffee": {"name": "Coffee", "category": "Crops", "featured": True, "pins": [{"lat": 1.0, "lng": 2.0, "label": "p"}, {"lat": 3.0, "lng": 4.0}], "top_matches": []}, "bare": {"pins": []}}
    path = tmp_path / "layers.json"
    path.write_text(json.dumps(layers, indent=1))
    got = S.read_layers(spark, str(path))
    assert {r.id: r.name for r in got.collect()} == {"coffee": "Coffee", "bare": None}
    assert sorted((r.layer_id, r.pin_idx, r.lat) for r in S.layer_pins(got).collect()) == [("coffee", 0, 1.0), ("coffee", 1, 3.0)]
    S.write_layers(got, str(tmp_path / "out"))
    assert sorted(map(str, S.read_layers(spark, str(tmp_path / "out")).collect())) == sorted(map(str, got.collect()))
    S.write_layers(got.coalesce(1), str(tmp_path / "one"))
    assert S.read_layers(spark, str(tmp_path / "one")).count() == 2


def test_regions_and_unreadable_files(spark, tmp_path):
    (tmp_path / "regions.json").write_text(json.dumps({"rice": {"name": "Rice", "category": "Cereals", "regions": {"Delta": [1.0, 2.0, 3.0, 4.0], "Plain": [5, 6, 7, 8]}}}))
    got = S.read_regions(spark, str(tmp_path / "regions.json")).collect()
    assert sorted((r.layer_id, r.region, r.west, r.north) for r in got) == [("rice", "Delta", 1.0, 4.0), ("rice", "Plain", 5.0, 8.0)]
    S.write_scores(spark.createDataFrame([("a", 1, 0.5)], "layer_id string, pixel long, score double"), str(tmp_path / "s"))
    (tmp_path / "s" / "layer_id=a" / "bad.parquet").write_bytes(b"PAR1 cut off")
    assert S.read_scores(spark, str(tmp_path / "s")).count() == 1
    assert [r.file.rsplit("/", 1)[1] for r in S.unreadable_files(spark, str(tmp_path / "s")).collect()] == ["bad.parquet"]


def test_farms_csv(spark, tmp_path):
    path = tmp_path / "farms.csv"
    path.write_text("crop,farm_name,latitude,longitude,region,country\nHass Avocado,A,1.5,2,R,C\nCoffee,B,3,4,R,C\n")
    assert [(r.farm_name, r.latitude) for r in S.read_farms(spark, str(path), "hass AVOCADO").collect()] == [("A", 1.5)]


def test_scores_by_layer(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25), ("b", 1, 1.0)], "layer_id string, pixel long, score double")
    S.write_scores(scores, str(tmp_path / "s"))
    one = S.read_scores(spark, str(tmp_path / "s"), "b")
    assert sorted((r.pixel, r.score) for r in one.collect()) == [(1, 1.0), (2, 0.25)]
    assert "PartitionFilters: [isnotnull(layer_id" in one._jdf.queryExecution().executedPlan().toString()


def test_weather_and_soil_replies(spark):
    from geolark.operators.zonal import weather_summary

    reply = {"daily": {"temperature_2m_mean": [10.0, None, 20.0], "precipitation_sum": [0.5, 2.0, 1.0], "sunshine_duration": [3600, 7200, None]}, "hourly": {"cloud_cover": [10, 20]}}
    days = S.weather_days(spark.createDataFrame([("x", json.dumps(reply)), ("y", "{}")], "place string, body string"))
    got = {r.place: r for r in weather_summary(days, "place").collect()}
    assert (got["x"].temp_mean, got["x"].rain, got["x"].wet_days, got["x"].sun_hours, got["x"].cloud, got["x"].temp_min) == (15.0, 3.5, 1, 1.5, 15.0, 15.0)
    assert (got["y"].temp_mean, got["y"].rain, got["y"].wet_days) == (20.0, 1000.0, 0)
    soil = {"properties": {"layers": [{"name": "phh2o", "depths": [{"values": {"mean": 61.0}}, {"values": {"mean": 1.0}}]}, {"name": "sand", "depths": []}]}}
    row = S.soil_values(spark.createDataFrame([("x", json.dumps(soil))], "place string, body string")).first()
    assert (row.phh2o, row.sand, row.clay) == (61.0, None, None)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5, -3.0, "n")], "id long, lat double, lng double, name string")
    features = catalog.geojson(rows, "lat", "lng", ["id", "name"])
    assert json.loads(features.first()[0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-3.0, 2.5]}, "properties": {"id": 1, "name": "n"}}
    catalog.write_export(features, str(tmp_path / "g"), "geojson")
    catalog.write_export(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().name == "n" and spark.read.text(str(tmp_path / "g")).count() == 1
    with pytest.raises(ValueError):
        catalog.write_export(rows, str(tmp_path / "x"), "pdf")


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = sorted(map(tuple, E.counts(spark.read.parquet(path)).collect()))
    assert sorted(map(tuple, E.run_once(E.counts(E.stream(spark, path, EVENT)), "complete").collect())) == batch


def test_stream_of_a_folder_in_several_batches(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events.parquet")
    rows.repartition(3).write.parquet(folder)
    batch = sorted(map(tuple, E.counts(rows).collect()))
    assert batch and sorted(map(tuple, E.run_once(E.counts(E.stream(spark, folder, EVENT)), "complete").collect())) == batch
    slow = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    got = E.run_once(E.counts(slow), "update", ["user_id", "event_type"])
    assert sorted(map(tuple, got.collect())) == batch
    assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString()  # read from files, not kept by the driver


def test_stream_append_needs_the_watermark(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    got = E.run_once(E.over_limit(E.stream(spark, path, EVENT), 0, "1 day", "1 day"), "append")
    rows = E.windowed_counts(spark.read.schema(EVENT).parquet(path), "1 day")
    assert set(map(tuple, got.collect())) <= set(map(tuple, rows.collect()))


def test_weather_is_rounded_like_sql(spark):
    import duckdb

    from geolark.operators.zonal import weather_summary

    means = [60.949999999999996, 60.94999999999999, 0.25, -0.25, 0.35, 1.05, -3.85, 8.45, None]
    days = spark.createDataFrame([(str(i), x, x, x, x, x, None, x) for i, x in enumerate(means)], "place string, temp_mean double, temp_min double, temp_max double, rain double, humidity double, sunshine double, cloud double")
    got = {r.place: r for r in weather_summary(days, "place").collect()}
    for i, x in enumerate(means):
        want = None if x is None else duckdb.execute("SELECT round(CAST(? AS DOUBLE), 1)", [x]).fetchone()[0]
        r = got[str(i)]
        assert (r.temp_mean, r.temp_min, r.temp_max, r.rain, r.humidity, r.cloud) == ((20.0, 15.0, 30.0, 1000.0, 70.0, 50.0) if x is None else (want,) * 6)


def test_weather_of_events_without_a_type(spark, tmp_path):
    from geolark.plans.table_queries import weather_summary

    spark.createDataFrame([(1, None, 7.0), (1, "error", 9.0)], "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert weather_summary(spark, str(tmp_path)).first().temp_mean == 7.0
