"""Named queries on the raster: cells, quantisation, scans, matches, tiles, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import centre_lat, centre_lng, from_mercator, mercator_bounds, palette_colour, ramp_colour, region_bucket, row_col, tile_bounds
from ..functions.text import distinct_pins as near_pins
from ..functions.text import pins_problem
from ..operators import matches as M
from ..operators import raster as R
from ..operators import similarity as S
from ..operators import tiles as T
from ..operators import validation as V
from . import cte
from . import fixtures as fx
from .cte import query as sql
from .registry import query

SIZE = T.TILE
#: Random land cells that the validation queries compare with.
BASELINE = 5000


@query(sql(cte.CELLS, "SELECT pixel, row, col, is_land, len(list_filter(e, lambda x: x <> 0)) > 0 AS has_data FROM cells"))
def grid_cells(spark, d):
    return fx.cells(spark, d).select("pixel", "row", "col", "is_land", R.any_band(F.col("e")).alias("has_data"))


@query(sql(cte.CELLS, "SELECT count(*) AS total, count(*) FILTER (WHERE is_land) AS land, count(*) FILTER (WHERE NOT is_land) AS water, round(count(*) FILTER (WHERE is_land) * 100.0 / count(*), 4) AS land_pct FROM cells"))
def grid_land_stats(spark, d):
    return R.land_stats(fx.cells(spark, d))


@query(sql(cte.CELLS, "SELECT pixel, round(list_sum(list_transform(e, lambda x: CASE WHEN label = 0 OR pixel % 100 > 50 THEN 0.0 ELSE x END)), 9) AS total FROM cells"))
def water_mask(spark, d):
    masked = R.mask_water(F.col("e"), F.when(F.col("label") == 0, 17).otherwise(1), F.col("pixel") % 100)
    return fx.cells(spark, d).select("pixel", F.round(F.aggregate(masked, F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


_POINTS = "SELECT c_custkey AS id, (c_custkey * 37 % 18500) / 100.0 - 92.0 AS lat, (c_custkey * 91 % 37000) / 100.0 - 185.0 AS lng FROM customer"


def _points(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("id"), ((k * 37 % 18500) / 100.0 - 92.0).alias("lat"), ((k * 91 % 37000) / 100.0 - 185.0).alias("lng"))


@query(
    sql(
        cte.CELLS + f", pts AS ({_POINTS})",
        "SELECT id, CASE WHEN lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180 THEN CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) AS INTEGER) END AS row,"
        " CASE WHEN lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180 THEN CAST(greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS INTEGER) END AS col,"
        " CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) AS INTEGER) AS crow, CAST(greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS INTEGER) AS ccol FROM pts, grid",
    )
)
def latlng_to_cell(spark, d):
    m = fx.meta(spark, d)
    c, k = row_col(F.col("lat"), F.col("lng"), m), row_col(F.col("lat"), F.col("lng"), m, clamp=True)
    return _points(spark, d).select("id", c["row"].alias("row"), c["col"].alias("col"), k["row"].alias("crow"), k["col"].alias("ccol"))


@query(sql(cte.CELLS, "SELECT pixel, round(70.0 - (row + 0.5) * ch, 9) AS lat, round(-180.0 + (col + 0.5) * cw, 9) AS lng FROM cells, grid"))
def cell_centres(spark, d):
    m = fx.meta(spark, d)
    return fx.cells(spark, d).select("pixel", F.round(centre_lat(F.col("row"), m), 9).alias("lat"), F.round(centre_lng(F.col("col"), m), 9).alias("lng"))


@query(sql(cte.CELLS, "SELECT pixel, CAST((floor((70.0 - (row + 0.5) * ch) / 30) + 3) * 12 + floor((-180.0 + (col + 0.5) * cw) / 30) + 6 AS INTEGER) AS region FROM cells, grid"))
def regions(spark, d):
    m = fx.meta(spark, d)
    return fx.cells(spark, d).select("pixel", region_bucket(centre_lat(F.col("row"), m), centre_lng(F.col("col"), m)).alias("region"))


@query(sql(cte.BANDS, "SELECT band, round(lo, 9) AS lo, round(hi, 9) AS hi, round(scale, 12) AS scale, round(off, 9) AS offs FROM scaled"))
def band_minmax(spark, d):
    r = R.band_ranges(fx.cells(spark, d))
    return r.select("band", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("scale", 12).alias("scale"), F.round("offset", 9).alias("offs"))


@query(sql(cte.QUANT, "SELECT pixel, CAST(band AS INTEGER) AS band, q FROM qflat"))
def quantize(spark, d):
    return fx.quantized(spark, d).select("pixel", F.posexplode("q").alias("band", "q"))


@query(sql(cte.QUANT, "SELECT pixel, CAST(band AS INTEGER) AS band, round(q * scale + off, 9) AS v FROM qflat"))
def dequantize(spark, d):
    c = fx.cells(spark, d)
    return R.dequantize(fx.quantized(spark, d), R.band_ranges(c)).select("pixel", F.posexplode(F.transform("restored", lambda x: F.round(x, 9))).alias("band", "v"))


@query(sql(cte.QUANT, "SELECT round(avg((q * scale + off - v) * (q * scale + off - v)), 9) AS mse, round(max(abs(q * scale + off - v)), 9) AS max_error FROM qflat"))
def quant_roundtrip_error(spark, d):
    c = fx.cells(spark, d)
    return R.roundtrip_error(c, R.band_ranges(c))


@query(sql(cte.PINS, "SELECT pin_idx, round(lat, 6) AS lat, round(lng, 6) AS lng, row, col, pixel FROM landpins"))
def pin_lookup(spark, d):
    return fx.land_pins(spark, d).select("pin_idx", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "row", "col", "pixel")


@query(
    f"WITH pts AS ({_POINTS}), req AS (SELECT CAST(id // 60 AS BIGINT) AS id, count(*) AS n, bool_or(lat NOT BETWEEN -90 AND 90) AS a, bool_or(lng NOT BETWEEN -180 AND 180) AS b FROM pts WHERE id % 60 < 30 + id // 60 GROUP BY 1)"
    " SELECT id, n, CASE WHEN n > 50 THEN 'too many pins' WHEN a THEN 'latitude out of range' WHEN b THEN 'longitude out of range' END AS problem FROM req"
)
def pin_validate(spark, d):
    p = _points(spark, d).where("id % 60 < 30 + id div 60").groupBy(F.expr("id div 60").alias("id")).agg(F.collect_list(F.struct("lat", "lng")).alias("pins"))
    return p.select("id", F.size("pins").cast("long").alias("n"), pins_problem(F.col("pins")).alias("problem"))


@query(
    f"WITH RECURSIVE pts AS (SELECT id // 30 AS req, id, round(lat / 40, 2) AS lat, round(lng / 80, 2) AS lng FROM ({_POINTS})), o AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY id) AS i FROM pts),"
    " walk AS (SELECT DISTINCT req, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lng DOUBLE)[]) AS acc FROM o UNION ALL"
    " SELECT w.req, o.i, CASE WHEN len(w.acc) < 8 AND len(list_filter(w.acc, lambda a: abs(a.lat - o.lat) < 0.5 AND abs(a.lng - o.lng) < 0.5)) = 0 THEN list_append(w.acc, {'id': o.id, 'lat': o.lat, 'lng': o.lng}) ELSE w.acc END FROM walk w JOIN o ON o.req = w.req AND o.i = w.i + 1)"
    " SELECT req, unnest(acc).id AS id FROM (SELECT req, arg_max(acc, i) AS acc FROM walk GROUP BY req)"
)
def distinct_pins(spark, d):
    """The pins of each request without those close to an earlier one."""
    p = _points(spark, d).select(F.expr("id div 30").alias("req"), "id", F.round(F.col("lat") / 40, 2).alias("lat"), F.round(F.col("lng") / 80, 2).alias("lng"))
    requests = p.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lng"))).alias("pins"))
    return requests.select("req", F.inline(near_pins(F.col("pins"), 0.5, 8))).select("req", "id")


_SCAN = sql(cte.SCORES, "SELECT pixel, dot, best_pin, score FROM scores")


@query(_SCAN)
def sim_scan(spark, d):
    return S.scan_arrow(*fx.scan_inputs(spark, d))


@query(_SCAN)
def sim_scan_expressions(spark, d):
    """The same scan as column expressions, without Python in the tasks."""
    return S.scan(*fx.scan_inputs(spark, d))


@query(sql(cte.SCORES, "SELECT pixel, greatest(dot, 0) AS dot, CASE WHEN dot > 0 THEN best_pin ELSE 0 END AS best_pin, score FROM scores"))
def sim_scan_online(spark, d):
    return S.scan(*fx.scan_inputs(spark, d), online=True)


@query(_SCAN)
def sim_scan_arrow(spark, d):
    return S.scan_arrow(*fx.scan_inputs(spark, d))


@query(
    sql(
        cte.QUANT
        + """, lp AS (SELECT 'layer' || label AS layer_id, CAST(n - 1 AS INTEGER) AS pin_idx, q FROM (SELECT c.label, k.q, row_number() OVER (PARTITION BY c.label ORDER BY c.pixel) AS n FROM cells c JOIN quant k USING (pixel)) WHERE n <= 3),
ld AS (SELECT layer_id, pixel, pin_idx, CAST(list_dot_product(CAST(k.q AS DOUBLE[]), CAST(p.q AS DOUBLE[])) AS INTEGER) AS d FROM quant k, lp p)""",
        "SELECT layer_id, pixel, max(d) AS dot, min(pin_idx) FILTER (WHERE d = m) AS best_pin, greatest(0.0, least(1.0, max(d) / CAST(105000 AS DOUBLE))) AS score FROM (SELECT *, max(d) OVER (PARTITION BY layer_id, pixel) AS m FROM ld) GROUP BY layer_id, pixel",
    )
)
def sim_scan_layers(spark, d):
    return S.scan_layers(*fx.layer_inputs(spark, d))


def _float_rows(spark, d):
    c = fx.cells(spark, d)
    ranges = R.kept_ranges(R.band_ranges(c))
    return c.withColumn("v", F.col("e")), R.dequantize(fx.quantized_pins(spark, d, c, ranges), ranges, "v")


@query(sql(cte.PINS + ", pv AS (SELECT p.pin_idx, list(q.q * q.scale + q.off ORDER BY q.band) AS v FROM landpins p JOIN qflat q USING (pixel) GROUP BY p.pin_idx)", "SELECT pixel, round(max(list_dot_product(e, v)), 6) AS dot, round(greatest(0.0, least(1.0, max(list_dot_product(e, v)) / 0.9)), 6) AS score FROM cells, pv GROUP BY pixel"))
def sim_scan_float(spark, d):
    c, p = _float_rows(spark, d)
    return S.scan_float(c, p).select("pixel", F.round("dot", 6).alias("dot"), F.round("score", 6).alias("score"))


@query(sql(cte.SCORES, "SELECT count(*) AS n, round(quantile_cont(dot, 0.5), 4) AS p50, round(quantile_cont(dot, 0.9), 4) AS p90, round(quantile_cont(dot, 0.99), 4) AS p99, max(dot) AS top FROM scores WHERE dot > 0"))
def score_stats(spark, d):
    return S.score_stats(sim_scan(spark, d))


def _candidates(spark, d):
    return M.candidates(sim_scan(spark, d), fx.pins(spark, d), fx.meta(spark, d), fx.THRESHOLD)


@query(sql(cte.CANDIDATES, "SELECT pixel, dot, best_pin, score, row, col FROM cand"))
def exclusion_candidates(spark, d):
    return _candidates(spark, d)


def _matches(spark, d):
    return M.top_matches(_candidates(spark, d), fx.meta(spark, d), 10)


@query("WITH RECURSIVE " + cte.MATCHES + "\nSELECT rank, pixel, lat, lng, score, best_pin FROM matches")
def top_matches(spark, d):
    return _matches(spark, d)


@query("WITH RECURSIVE " + cte.MATCHES + "\nSELECT best_pin, count(*) AS n FROM matches GROUP BY best_pin")
def matches_per_pin(spark, d):
    return M.matches_per_pin(_matches(spark, d))


@query("WITH RECURSIVE " + cte.MATCHES + "\nSELECT m.rank, m.pixel, m.best_pin, coalesce(nullif(p.label, ''), 'Pin ' || (m.best_pin + 1)) AS label FROM matches m LEFT JOIN pins p ON p.pin_idx = m.best_pin")
def match_labels(spark, d):
    return M.named_matches(_matches(spark, d), fx.pins(spark, d)).select("rank", "pixel", "best_pin", "label")


@query(
    sql(
        cte.SCORES + f", pts AS ({_POINTS})",
        "SELECT id, coalesce(s.score, 0.0) AS score FROM (SELECT id, CASE WHEN lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180 THEN CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) * w + greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS BIGINT) END AS pixel FROM pts, grid) p LEFT JOIN scores s USING (pixel)",
    )
)
def point_score(spark, d):
    return M.point_scores(_points(spark, d), sim_scan(spark, d), fx.meta(spark, d)).select("id", "score")


@query("WITH " + cte.TILES.lstrip(",\n") + "\nSELECT z, x, y, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north FROM tb WHERE west < 180 AND east > -180 AND south < 70 AND north > -60")
def tile_bounds_list(spark, d):
    b = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return T.tile_list(spark, range(3), fx.meta(spark, d)).select("z", "x", "y", *[F.round(b[n], 9).alias(n) for n in ("west", "south", "east", "north")])


_WORLD = "20037508.342789244"


@query(
    "WITH " + cte.TILES.lstrip(",\n") + f", mb AS (SELECT z, x, y, x * (2 * {_WORLD} / pow(2, z)) - {_WORLD} AS minx, {_WORLD} - (y + 1) * (2 * {_WORLD} / pow(2, z)) AS miny FROM tb WHERE west < 180 AND east > -180 AND south < 70 AND north > -60)\n"
    f"SELECT z, x, y, round(minx, 3) AS minx, round(miny, 3) AS miny, round(atan(exp(miny / {_WORLD} * pi())) * 360 / pi() - 90, 9) AS lat, round(minx / {_WORLD} * 180, 9) AS lng FROM mb"
)
def mercator(spark, d):
    b = mercator_bounds(F.col("z"), F.col("x"), F.col("y"))
    t = T.tile_list(spark, range(3), fx.meta(spark, d)).withColumn("b", b).withColumn("p", from_mercator(F.col("b.minx"), F.col("b.miny")))
    return t.select("z", "x", "y", F.round("b.minx", 3).alias("minx"), F.round("b.miny", 3).alias("miny"), F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


def _tile_scores(spark, d):
    m = fx.meta(spark, d)
    return T.tile_scores(T.tile_list(spark, range(3), m), sim_scan(spark, d), m, SIZE)


@query(sql(cte.TILE_PIXELS, "SELECT z, x, y, py, px, score FROM ts"))
def tile_scores(spark, d):
    return _tile_scores(spark, d)


_RAMP = """ramp AS (SELECT CAST(i AS INTEGER) AS ci,
 CAST(CASE WHEN i <= 140 THEN 0 WHEN i <= 166 THEN trunc(200 + 40 * ((i - 141) / 25.0)) WHEN i <= 204 THEN trunc(240 + 5 * ((i - 167) / 37.0)) WHEN i <= 240 THEN trunc(245 + -25 * ((i - 205) / 35.0)) ELSE trunc(220 + -40 * ((i - 241) / 14.0)) END AS INTEGER) AS r,
 CAST(CASE WHEN i <= 140 THEN 0 WHEN i <= 166 THEN trunc(180 + 20 * ((i - 141) / 25.0)) WHEN i <= 204 THEN trunc(200 + -80 * ((i - 167) / 37.0)) WHEN i <= 240 THEN trunc(120 + -80 * ((i - 205) / 35.0)) ELSE trunc(40 + -25 * ((i - 241) / 14.0)) END AS INTEGER) AS g,
 CAST(CASE WHEN i <= 140 THEN 0 WHEN i <= 166 THEN trunc(50 + -20 * ((i - 141) / 25.0)) WHEN i <= 204 THEN trunc(30 + -10 * ((i - 167) / 37.0)) WHEN i <= 240 THEN 20 ELSE trunc(20 + 10 * ((i - 241) / 14.0)) END AS INTEGER) AS b,
 CAST(CASE WHEN i <= 140 THEN 0 WHEN i <= 166 THEN trunc(60 + 80 * ((i - 141) / 25.0)) WHEN i <= 204 THEN trunc(140 + 70 * ((i - 167) / 37.0)) WHEN i <= 240 THEN trunc(210 + 30 * ((i - 205) / 35.0)) ELSE trunc(240 + 15 * ((i - 241) / 14.0)) END AS INTEGER) AS a
 FROM (SELECT CAST(range AS DOUBLE) AS i FROM range(0, 256)))"""


@query(f"WITH {_RAMP} SELECT ci, r, g, b, a FROM ramp")
def color_ramp(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("ci")).withColumn("c", ramp_colour(F.col("ci"))).select("ci", "c.r", "c.g", "c.b", "c.a")


@query(sql(cte.TILE_PIXELS + ", " + _RAMP, "SELECT z, x, y, py, px, ci, r, g, b, a FROM (SELECT z, x, y, py, px, CAST(greatest(0, least(255, trunc(coalesce(score, 0.0) * 255))) AS INTEGER) AS ci FROM ts) JOIN ramp USING (ci)"))
def tile_rgba(spark, d):
    return T.tile_rgba(_tile_scores(spark, d))


@query(sql(cte.SCORES, "SELECT pixel, CASE WHEN s >= 0.016 THEN 134 WHEN s >= 0.015 THEN 192 WHEN s >= 0.013 THEN 232 ELSE 0 END AS r, CASE WHEN s >= 0.016 THEN 25 WHEN s >= 0.015 THEN 38 WHEN s >= 0.013 THEN 121 ELSE 0 END AS g, CASE WHEN s >= 0.016 THEN 143 WHEN s >= 0.015 THEN 211 WHEN s >= 0.013 THEN 249 ELSE 0 END AS b, CASE WHEN s >= 0.013 THEN 200 ELSE 0 END AS a FROM (SELECT pixel, score / 20 AS s FROM scores)"))
def palette(spark, d):
    return sim_scan(spark, d).select("pixel", palette_colour(F.col("score") / 20).alias("c")).select("pixel", "c.r", "c.g", "c.b", "c.a")


def _tile_tops(spark, d):
    m = fx.meta(spark, d)
    return T.tile_tops(T.tile_list(spark, range(3), m), sim_scan(spark, d), m, SIZE)


@query(sql(cte.TILE_PIXELS, "SELECT z, count(*) AS tiles, count(*) FILTER (WHERE top >= 0.55) AS rendered, count(*) - count(*) FILTER (WHERE top >= 0.55) AS skipped FROM (SELECT z, x, y, max(score) AS top FROM ts GROUP BY z, x, y) GROUP BY ROLLUP (z)"))
def tile_counts(spark, d):
    return T.tile_counts(_tile_tops(spark, d))


_PIXELS = cte.TILE_PIXELS + ", " + _RAMP + """, painted AS (SELECT z, x, y, py, px, r, g, b, a FROM (SELECT z, x, y, py, px, CAST(greatest(0, least(255, trunc(coalesce(score, 0.0) * 255))) AS INTEGER) AS ci FROM ts) JOIN ramp USING (ci)),
digest AS (SELECT z, x, y, 256 AS width, 256 AS height, sum(r) AS r, sum(g) AS g, sum(b) AS b, sum(a) AS a, sum((r + 2 * g + 3 * b + 5 * a) * ((py * 256 + px) % 251 + 1)) AS mix FROM painted GROUP BY z, x, y)"""


def tile_images(spark, d):
    m = fx.meta(spark, d)
    return T.tile_png(T.tile_list(spark, range(3), m), sim_scan(spark, d), m, SIZE)


@query(sql(_PIXELS, "SELECT * FROM digest"))
def tile_png(spark, d):
    """Every tile as a PNG, decoded again: its size, the sums of its channels, and one that tells where the colours are."""
    return T.tile_digest(tile_images(spark, d))


_SAMPLE = """, others AS (SELECT c.pixel AS id, k.q FROM cells c JOIN quant k USING (pixel) WHERE c.label > 2 ORDER BY md5(c.pixel || ':42'), c.pixel LIMIT 5000),
farms AS (SELECT c.pixel AS id, k.q FROM cells c JOIN quant k USING (pixel) WHERE c.label = 1),
pairs AS (SELECT a.id AS a, b.id AS b, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS INTEGER) AS sim FROM farms a JOIN farms b ON a.id < b.id),
base AS (SELECT a.id AS a, b.id AS b, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS INTEGER) AS sim FROM farms a, others b)"""
_SUMMARY = "SELECT count(*) AS n, round(avg(sim), 4) AS mean, round(stddev_pop(sim), 4) AS std, min(sim) AS min, max(sim) AS max, round(quantile_cont(sim, 0.5), 4) AS median FROM "


def _class_rows(spark, d):
    q = fx.quantized(spark, d).select(F.col("pixel").alias("id"), "label", "q")
    return q.where("label = 1").drop("label"), V.sample(q.where("label > 2").drop("label"), BASELINE, key="id")


@query(sql(cte.QUANT + _SAMPLE, _SUMMARY + "pairs"))
def pair_similarity_stats(spark, d):
    farms = _class_rows(spark, d)[0]
    return V.summary(V.pair_counts(farms), V.pair_moments(farms))


@query(sql(cte.QUANT + _SAMPLE, _SUMMARY + "base"))
def baseline_stats(spark, d):
    both = _class_rows(spark, d)
    return V.summary(V.baseline_counts(*both), V.baseline_moments(*both))


@query(sql(cte.QUANT + _SAMPLE, "SELECT round(m / bm, 4) AS ratio, round((m - bm) / bs, 4) AS separation, CASE WHEN m / bm > 1.5 THEN 'GOOD' WHEN m / bm > 1.1 THEN 'MODERATE' ELSE 'WEAK' END AS verdict FROM (SELECT avg(sim) AS m FROM pairs), (SELECT avg(sim) AS bm, stddev_pop(sim) AS bs FROM base)"))
def signal_ratio(spark, d):
    f, o = _class_rows(spark, d)
    return V.signal(V.pair_moments(f), V.baseline_moments(f, o))


_LOO = (
    cte.QUANT
    + _SAMPLE
    + """, every AS (SELECT id, q, true AS farm FROM farms UNION ALL SELECT id, q, false FROM others),
near AS (SELECT a.id AS query, b.id, b.farm, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS INTEGER) AS sim FROM farms a JOIN every b ON a.id <> b.id OR NOT b.farm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, farm DESC, id) - 1 AS rank, count(*) OVER (PARTITION BY query) AS n FROM near),
loo AS (SELECT query AS id, round(avg(rank), 4) AS mean_rank, CAST(min(rank) AS INTEGER) AS best_rank, round(100.0 * (1.0 - avg(rank) / max(n)), 4) AS percentile FROM ranked WHERE farm GROUP BY query)"""
)


@query(sql(_LOO, "SELECT * FROM loo"))
def loo_rank(spark, d):
    return V.leave_one_out(*_class_rows(spark, d))


@query(sql(_LOO, "SELECT round(avg(percentile), 4) AS mean_percentile, round(quantile_cont(percentile, 0.5), 4) AS median_percentile, CASE WHEN avg(percentile) > 90 THEN 'EXCELLENT' WHEN avg(percentile) > 75 THEN 'GOOD' WHEN avg(percentile) > 50 THEN 'MODERATE' ELSE 'POOR' END AS verdict FROM loo"))
def loo_summary(spark, d):
    return V.leave_one_out_summary(loo_rank(spark, d))


@query(sql(cte.CELLS, "SELECT pixel, label FROM cells WHERE is_land ORDER BY md5(pixel || ':42'), pixel LIMIT 100"))
def random_sample(spark, d):
    return V.sample(fx.cells(spark, d).where("is_land"), 100).select("pixel", "label")


@query(sql(cte.SCORES, "SELECT pixel, CASE WHEN score > 0.8 THEN 'strong' WHEN score > 0.65 THEN 'good' ELSE 'fair' END AS band FROM scores"))
def score_bands(spark, d):
    from ..functions.text import score_band

    return sim_scan(spark, d).select("pixel", score_band(F.col("score")).alias("band"))


@query(sql(cte.PINS + ", pv AS (SELECT p.pin_idx, list(q.q * q.scale + q.off ORDER BY q.band) AS v FROM landpins p JOIN qflat q USING (pixel) GROUP BY p.pin_idx)", "SELECT pixel, round(greatest(0.0, least(1.0, max(list_dot_product(e, v)) / 50)), 8) AS score FROM cells, pv GROUP BY pixel"))
def sim_scan_coarse(spark, d):
    from ..schema import COARSE_DIVISOR

    c, p = _float_rows(spark, d)
    return S.scan_float(c, p, divisor=COARSE_DIVISOR).select("pixel", F.round("score", 8).alias("score"))


@query(sql(cte.CELLS + cte.PINS_ONLY, "SELECT DISTINCT c.pixel FROM cells c JOIN placed p ON abs(c.row - p.row) <= 1 AND abs(c.col - p.col) <= 1"))
def excluded_pixels(spark, d):
    """The union of the pins' boxes: every box cell is made from its pin, then looked up by its number."""
    m = fx.meta(spark, d)
    k = max(1, m.cells_of_km(100))
    near = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    c = fx.pins(spark, d).select(row_col(F.col("lat"), F.col("lng"), m).alias("c")).where("c is not null").withColumn("dr", near).withColumn("dc", near)
    boxes = c.select((F.col("c.row") + F.col("dr")).alias("row"), (F.col("c.col") + F.col("dc")).alias("col")).distinct()
    return fx.cells(spark, d).join(boxes, ["row", "col"]).select("pixel")


@query(sql(cte.CELLS, "SELECT pixel FROM cells, grid WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(70.0 - (row + 0.5) * ch - 10.0) / 2), 2) + cos(radians(70.0 - (row + 0.5) * ch)) * cos(radians(10.0)) * pow(sin(radians(-180.0 + (col + 0.5) * cw - 20.0) / 2), 2))) <= 2500"))
def buffer_cells(spark, d):
    from ..operators.zonal import in_buffer

    m = fx.meta(spark, d)
    return fx.cells(spark, d).where(in_buffer(centre_lat(F.col("row"), m), centre_lng(F.col("col"), m), 10.0, 20.0, 2500.0)).select("pixel")
