"""Shared common table expressions of the oracle SQL (DuckDB)."""

CELLS = """
cells AS (SELECT vec_id AS pixel, CAST(vec_id // 50 AS INTEGER) AS row, CAST(vec_id % 50 AS INTEGER) AS col, label, label <> 0 AS is_land,
  CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
grid AS (SELECT 50 AS w, CAST(ceil(count(*) / 50.0) AS INTEGER) AS h, CAST(7.2 AS DOUBLE) AS cw, CAST(130.0 / ceil(count(*) / 50.0) AS DOUBLE) AS ch FROM embeddings)"""

BANDS = (
    CELLS
    + """,
flat AS (SELECT pixel, is_land, unnest(range(0, 64)) AS band, unnest(e) AS v FROM cells),
bands AS (SELECT CAST(band AS INTEGER) AS band, min(v) AS lo, max(v) AS hi, CASE WHEN min(v) = max(v) THEN 1.0 ELSE (max(v) - min(v)) / CAST(254 AS DOUBLE) END AS scale FROM flat WHERE is_land GROUP BY band),
scaled AS (SELECT *, CASE WHEN lo = hi THEN lo ELSE lo + CAST(127 AS DOUBLE) * scale END AS off FROM bands)"""
)

QUANT = (
    BANDS
    + """,
qflat AS (SELECT f.pixel, f.band, f.v, s.scale, s.off, CASE WHEN s.lo = s.hi THEN 0 ELSE CAST(greatest(-127, least(127, round_even((f.v - s.off) / s.scale, 0))) AS INTEGER) END AS q
  FROM flat f JOIN scaled s USING (band) WHERE f.is_land),
quant AS (SELECT pixel, list(q ORDER BY band) AS q FROM qflat GROUP BY pixel)"""
)

PINS_ONLY = """,
pins AS (SELECT CAST(CASE WHEN label = 0 THEN 5 ELSE label - 1 END AS INTEGER) AS pin_idx, 70.0 - (min(pixel) // 50 + 0.5) * any_value(ch) AS lat, -180.0 + (min(pixel) % 50 + 0.5) * any_value(cw) AS lng,
    CASE WHEN label % 2 = 1 THEN 'place ' || label ELSE '' END AS label FROM cells, grid WHERE label <= 5 GROUP BY cells.label
  UNION ALL SELECT 6, 85.0, 0.0, NULL),
placed AS (SELECT pin_idx, lat, lng, label, CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) AS INTEGER) AS row, CAST(greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS INTEGER) AS col
  FROM pins, grid WHERE lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180)"""

PINS = (
    QUANT
    + PINS_ONLY
    + """,
landpins AS (SELECT p.pin_idx, p.lat, p.lng, p.row, p.col, c.pixel, k.q FROM placed p JOIN cells c ON c.row = p.row AND c.col = p.col AND c.is_land JOIN quant k ON k.pixel = c.pixel)"""
)

SCORES = (
    PINS
    + """,
dots AS (SELECT k.pixel, p.pin_idx, CAST(list_dot_product(CAST(k.q AS DOUBLE[]), CAST(p.q AS DOUBLE[])) AS INTEGER) AS d FROM quant k, landpins p),
best AS (SELECT pixel, max(d) AS dot, min(pin_idx) FILTER (WHERE d = m) AS best_pin FROM (SELECT *, max(d) OVER (PARTITION BY pixel) AS m FROM dots) GROUP BY pixel),
scores AS (SELECT pixel, dot, best_pin, greatest(0.0, least(1.0, dot / CAST(105000 AS DOUBLE))) AS score FROM best)"""
)

CANDIDATES = (
    SCORES
    + """,
cand AS (SELECT s.pixel, s.dot, s.best_pin, s.score, CAST(s.pixel // 50 AS INTEGER) AS row, CAST(s.pixel % 50 AS INTEGER) AS col FROM scores s, grid
  WHERE s.score >= 0.3 AND NOT EXISTS (SELECT 1 FROM placed p, grid g WHERE abs(s.pixel // 50 - p.row) <= greatest(1, CAST(trunc(100 / (g.cw * 111.0)) AS INTEGER)) AND abs(s.pixel % 50 - p.col) <= greatest(1, CAST(trunc(100 / (g.cw * 111.0)) AS INTEGER))))"""
)

#: One step a candidate in order; `acc` holds the accepted ones.
MATCHES = (
    CANDIDATES
    + """,
ordered AS (SELECT row_number() OVER (ORDER BY score DESC, pixel) AS i, c.*, 70.0 - (c.row + 0.5) * ch AS lat, -180.0 + (c.col + 0.5) * cw AS lng,
  CAST((floor((70.0 - (c.row + 0.5) * ch) / 30) + 3) * 12 + floor((-180.0 + (c.col + 0.5) * cw) / 30) + 6 AS INTEGER) AS region FROM cand c, grid),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(pixel BIGINT, r INTEGER, c INTEGER, pin INTEGER, region INTEGER)[]) AS acc
  UNION ALL
  SELECT o.i, CASE WHEN len(w.acc) < 10 AND len(list_filter(w.acc, lambda a: abs(a.r - o.row) + abs(a.c - o.col) < 2)) = 0
      AND len(list_filter(w.acc, lambda a: a.pin = o.best_pin)) < 2 AND len(list_filter(w.acc, lambda a: a.region = o.region)) < 3
    THEN list_append(w.acc, {'pixel': o.pixel, 'r': o.row, 'c': o.col, 'pin': o.best_pin, 'region': o.region}) ELSE w.acc END
  FROM walk w JOIN ordered o ON o.i = w.i + 1),
final AS (SELECT acc FROM walk ORDER BY i DESC LIMIT 1),
chosen AS (SELECT unnest(acc).pixel AS pixel, unnest(range(1, len(acc) + 1)) AS rank FROM final),
matches AS (SELECT CAST(rank AS INTEGER) AS rank, o.pixel, round(o.lat, 4) AS lat, round(o.lng, 4) AS lng, round(o.score, 4) AS score, o.best_pin FROM chosen JOIN ordered o USING (pixel))"""
)

TILES = """,
tl AS (SELECT CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest([0, 1, 2]) AS z), range(0, 4) a(x), range(0, 4) b(y) WHERE x < pow(2, z) AND y < pow(2, z)),
tb AS (SELECT z, x, y, x / pow(2, z) * 360.0 - 180.0 AS west, (x + 1) / pow(2, z) * 360.0 - 180.0 AS east,
  degrees(atan(sinh(pi() - 2 * pi() * y / pow(2, z)))) AS north, degrees(atan(sinh(pi() - 2 * pi() * (y + 1) / pow(2, z)))) AS south FROM tl)"""

TILE_PIXELS = (
    SCORES
    + TILES
    + """,
tp AS (SELECT z, x, y, CAST(py AS INTEGER) AS py, CAST(px AS INTEGER) AS px, north - (py + 0.5) * ((north - south) / 256.0) AS lat, west + (px + 0.5) * ((east - west) / 256.0) AS lng
  FROM tb, range(0, 256) a(py), range(0, 256) b(px) WHERE west < 180 AND east > -180 AND south < 70 AND north > -60),
tc AS (SELECT z, x, y, py, px, CASE WHEN lat BETWEEN -60 AND 70 AND lng BETWEEN -180 AND 180 THEN
  CAST(greatest(0, least(trunc((70.0 - lat) / ch), h - 1)) * w + greatest(0, least(trunc((lng + 180.0) / cw), w - 1)) AS BIGINT) END AS pixel FROM tp, grid),
ts AS (SELECT z, x, y, py, px, CASE WHEN tc.pixel IS NOT NULL THEN coalesce(s.score, 0.0) END AS score FROM tc LEFT JOIN scores s ON s.pixel = tc.pixel)"""
)

MAPS = """
maps AS (SELECT p_partkey AS id, p_name AS title, ['Crops', 'Climate', 'Land', 'Odd'][p_partkey % 4 + 1] AS category, CAST(p_size * 3 % 17 AS BIGINT) AS stars, p_partkey % 10 = 0 AS is_featured, p_partkey % 3 = 0 AS has_tiles,
  o_orderdate AS created_at, coalesce(CAST(floor(o_totalprice) AS BIGINT), 0) AS views FROM part LEFT JOIN orders ON o_orderkey = p_partkey)"""


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
