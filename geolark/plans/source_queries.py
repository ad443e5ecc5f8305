"""Named queries on files: each writes into the shared folder, reads back and returns what it read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matches as M
from ..operators import raster as R
from ..operators import tiles as T
from ..operators import zorder as Q
from ..schema import GridMeta
from ..sources import geotiff as X
from ..sources import grid_file as G
from ..sources import tables as S
from ..sources.shared import new_folder
from . import cte
from . import fixtures as fx
from .cte import query as sql
from .raster_queries import _PIXELS, _POINTS, _points, sim_scan, sim_scan_layers, tile_images
from .registry import query


def _grid_file(spark, d) -> str:
    path = new_folder(spark, "grid") + ".bin"
    header = G.Header(fx.meta(spark, d), (1.0,) * 64, (0.5,) * 64)
    c = fx.cells(spark, d)
    G.write_grid_file(c.join(fx.quantized(spark, d).select("pixel", "q"), "pixel", "left"), path, header, 8)
    return path


@query(sql(cte.QUANT, "SELECT c.pixel, c.row, c.col, c.is_land, coalesce(list_sum(k.q), 0) AS total, coalesce(k.q[64], 0) AS last FROM cells c LEFT JOIN quant k USING (pixel)"))
def grid_file_roundtrip(spark, d):
    cells = G.read_grid(spark, _grid_file(spark, d), 8)
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    return cells.where(F.col("pixel") < fx.cells(spark, d).count()).select("pixel", "row", "col", "is_land", total.alias("total"), F.get("q", F.lit(63)).cast("int").alias("last"))


@query(sql(cte.CELLS, "SELECT w AS width, h AS height, CAST(-180 AS DOUBLE) AS west, CAST(-60 AS DOUBLE) AS south, CAST(180 AS DOUBLE) AS east, CAST(70 AS DOUBLE) AS north FROM grid"))
def grid_header(spark, d):
    m: GridMeta = G.read_header(_grid_file(spark, d)).meta
    return spark.sql(f"SELECT {m.width} AS width, {m.height} AS height, {m.west}D AS west, {m.south}D AS south, {m.east}D AS east, {m.north}D AS north")


@query(
    sql(
        cte.QUANT
        + """, lp AS (SELECT label, q FROM (SELECT c.label, k.q, row_number() OVER (PARTITION BY c.label ORDER BY c.pixel) AS n FROM cells c JOIN quant k USING (pixel)) WHERE n <= 3 AND label = 2)""",
        "SELECT 'layer2' AS layer_id, pixel, greatest(0.0, least(1.0, max(CAST(list_dot_product(CAST(k.q AS DOUBLE[]), CAST(p.q AS DOUBLE[])) AS INTEGER)) / CAST(105000 AS DOUBLE))) AS score FROM quant k, lp p GROUP BY pixel",
    )
)
def scores_roundtrip(spark, d):
    path = new_folder(spark, "scores")
    S.write_scores(sim_scan_layers(spark, d).select("layer_id", "pixel", "score"), path)
    return S.read_scores(spark, path, "layer2", "pixel long, score double, layer_id string").select("layer_id", "pixel", "score")


@query("SELECT 'n' || r_regionkey AS layer_id, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pin_idx, CAST(n_nationkey AS DOUBLE) AS lat, CAST(-n_nationkey AS DOUBLE) AS lng, n_name AS label, r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def layers_roundtrip(spark, d):
    pin = F.struct(F.col("n_nationkey").cast("double").alias("lat"), (-F.col("n_nationkey")).cast("double").alias("lng"), F.col("n_name").alias("label"))
    n = fx.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(pin)).alias("pins"))
    layers = fx.table(spark, d, "region").join(n, "r_regionkey").select(F.concat(F.lit("n"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), "pins")
    path = new_folder(spark, "layers")
    S.write_layers(layers, path)
    back = S.read_layers(spark, path)
    return S.layer_pins(back).join(back.select(F.col("id").alias("layer_id"), "name"), "layer_id")


@query("SELECT c_name AS farm_name, CAST(c_custkey AS DOUBLE) / 10 AS latitude FROM customer WHERE c_mktsegment = 'BUILDING'")
def farms_csv(spark, d):
    c = fx.table(spark, d, "customer")
    path = new_folder(spark, "farms")
    C.write_export(c.select(F.initcap("c_mktsegment").alias("crop"), F.col("c_name").alias("farm_name"), (F.col("c_custkey") / 10).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit("r").alias("region"), F.lit("c").alias("country")), path)
    return S.read_farms(spark, path, "building").select("farm_name", "latitude")


@query(sql(_PIXELS, "SELECT tl.z, tl.x, tl.y, coalesce(width, 1) AS width, coalesce(height, 1) AS height, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a, coalesce(mix, 0) AS mix FROM tl LEFT JOIN digest d ON d.z = tl.z AND d.x = tl.x AND d.y = tl.y"))
def tile_tree(spark, d):
    """Tiles written as {layer}/{z}/{x}/{y}.png, and what a request for each tile of the zooms gets, decoded: its file or the transparent one."""
    path = new_folder(spark, "tiles")
    T.write_tile_tree(tile_images(spark, d), path, "coffee")
    wanted = T.tile_list(spark, range(3), GridMeta(1, 1, -180.0, -90.0, 180.0, 90.0))
    found = T.read_tile_tree(spark, path).where("layer = 'coffee'").select("z", "x", "y", "png")
    return T.tile_digest(T.served(wanted, found))


@query(sql(cte.QUANT, "SELECT c.pixel, c.row, c.col, list_sum(k.q) AS total FROM cells c JOIN quant k USING (pixel) WHERE c.row BETWEEN 1 AND 3 AND c.col >= 20"))
def grid_window(spark, d):
    """Land of some rows and columns of a raster file: the filters reach the file, and nothing else of it is read."""
    cells = G.read_grid(spark, _grid_file(spark, d), 8).where("row between 1 and 3 and col >= 20 and is_land")
    return cells.select("pixel", "row", "col", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(sql(cte.CANDIDATES, "SELECT pixel, score FROM cand WHERE pixel % 7 = 0"))
def sampled_candidates(spark, d):
    """Every seventh cell, for a caller that asks for a sample."""
    return M.candidates(sim_scan(spark, d), fx.pins(spark, d), fx.meta(spark, d), fx.THRESHOLD, step=7).select("pixel", "score")


@query(sql(cte.CELLS, "SELECT pixel, round(70.0 - (row + 0.5) * ch, 6) AS lat, round(-180.0 + (col + 0.5) * cw, 6) AS lng, e[1] AS first, e[64] AS last, round(list_sum(e), 6) AS total FROM cells, grid WHERE is_land"))
def geotiff_cells(spark, d):
    """The land cells as a mosaic of GeoTIFF files, read back and placed by their coordinates."""
    m = fx.meta(spark, d)
    path = new_folder(spark, "geotiff")
    X.write_geotiffs(fx.cells(spark, d).where("is_land"), path, m, 64, "e", 8)
    back = X.read_geotiff(spark, path).where("v is not null")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return back.select(X.pixel_of(F.col("lat"), F.col("lng"), m).alias("pixel"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"), F.round(total, 6).alias("total"))


_BOXES = "SELECT n_name AS region, n_nationkey * 12.0 - 170.0 AS west, n_nationkey * 4.0 - 55.0 AS south, n_nationkey * 12.0 - 140.0 AS east, n_nationkey * 4.0 - 25.0 AS north FROM nation"


@query(sql(cte.CELLS + f", boxes AS ({_BOXES})", "SELECT b.region, c.pixel FROM boxes b, cells c, grid WHERE 70.0 - (c.row + 0.5) * ch BETWEEN b.south AND b.north AND -180.0 + (c.col + 0.5) * cw BETWEEN b.west AND b.east"))
def region_cells(spark, d):
    """The cells of every named box of a layer, the boxes read from a JSON map of layers."""
    k = F.col("n_nationkey")
    box = F.array(k * 12.0 - 170.0, k * 4.0 - 55.0, k * 12.0 - 140.0, k * 4.0 - 25.0)
    layer = F.struct(F.lit("Nations").alias("name"), F.create_map("n_name", box).alias("regions"))
    path = new_folder(spark, "regions")
    fx.table(spark, d, "nation").select(F.to_json(F.create_map(F.lit("nations"), layer))).coalesce(1).write.option("lineSep", "\n").text(path)
    boxes = S.read_regions(spark, path).select("region", "west", "south", "east", "north")
    return R.box_cells(boxes, fx.meta(spark, d)).join(fx.cells(spark, d).select("pixel"), "pixel").select("region", "pixel")


def _zordered(spark, d) -> str:
    path = new_folder(spark, "zorder")
    Q.write_zordered(fx.cells(spark, d).select("pixel", "row", "col", "label"), path)
    return path


@query(sql(cte.CELLS, "SELECT pixel, label FROM cells WHERE row BETWEEN 2 AND 7 AND col BETWEEN 11 AND 37"))
def zorder_box(spark, d):
    """A box of the raster in Z-order: a few ranges of codes, which the scan's row groups are chosen by."""
    return Q.read_box(spark, _zordered(spark, d), 2, 7, 11, 37).select("pixel", "label")


@query(sql(cte.CELLS, "SELECT pixel FROM cells, grid WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(70.0 - (row + 0.5) * ch - 10.0) / 2), 2) + cos(radians(70.0 - (row + 0.5) * ch)) * cos(radians(10.0)) * pow(sin(radians(-180.0 + (col + 0.5) * cw - 20.0) / 2), 2))) <= 2500"))
def zorder_buffer(spark, d):
    """The cells within 2500 km of a point, out of the ranges of codes of the box around them."""
    from ..functions.geo import centre_lat, centre_lng
    from ..operators.zonal import in_buffer

    m = fx.meta(spark, d)
    near = Q.read_buffer(spark, _zordered(spark, d), m, 10.0, 20.0, 2500.0)
    return near.where(in_buffer(centre_lat(F.col("row"), m), centre_lng(F.col("col"), m), 10.0, 20.0, 2500.0)).select("pixel")


@query("SELECT vec_id AS id, embedding[1] AS first, embedding[64] AS last FROM embeddings WHERE embedding IS NOT NULL")
def farm_vectors_npy(spark, d):
    """The farms' vectors as NumPy files, and read back."""
    path = new_folder(spark, "npy")
    S.write_npy(fx.farms(spark, d), path, "embedding")
    return S.read_npy(spark, path).select("id", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"))


@query(
    sql(
        cte.CELLS + f", pts AS ({_POINTS})",
        "SELECT id, c.label * 100 AS elevation FROM (SELECT id, CASE WHEN lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180 THEN CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) * w + greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS BIGINT) END AS pixel FROM pts, grid) p LEFT JOIN cells c USING (pixel)",
    )
)
def terrain_at_points(spark, d):
    cells = fx.cells(spark, d).withColumn("elevation", F.col("label") * 100)
    return R.sampled_at(_points(spark, d), cells, fx.meta(spark, d), ["elevation"]).select("id", "elevation")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_name ILIKE '%an%' ORDER BY n_name NOT ILIKE 'an%', length(n_name), n_name LIMIT 5")
def place_search(spark, d):
    return S.search_places(fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), " An", 5)


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE 'map-' || p_partkey = 'map-17'")
def map_by_slug(spark, d):
    slug = F.concat(F.lit("map-"), F.col("p_partkey").cast("string"))
    return fx.table(spark, d, "part").where(slug == "map-17").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
