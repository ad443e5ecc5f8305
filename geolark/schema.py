"""Constants and schemas shared by sources and operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DIMS = 64
#: Divisor of the integer dot product, of the float one at 10 m, and of the 5 km variant.
SCORE_DIVISOR, FLOAT_DIVISOR, COARSE_DIVISOR = 105000.0, 0.9, 50.0
MATCH_THRESHOLD, VISIBLE_THRESHOLD = 0.5, 0.55
KM_PER_DEGREE = 111.0
MAX_PINS = 50
#: Pins of all layers of one scan: a hundred layers with all the pins they may have.
MAX_LAYER_PINS = 5000
Q_MIN, Q_MAX, Q_STEPS = -127, 127, 254.0

CELL = T.StructType(
    [
        T.StructField("pixel", T.LongType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("is_land", T.BooleanType()),
        T.StructField("q", T.ArrayType(T.ByteType())),
    ]
)
PIN = T.StructType([T.StructField("pin_idx", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("label", T.StringType())])
LAYERS_JSON = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("featured", T.BooleanType()),
            T.StructField("pins", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("label", T.StringType())]))),
            T.StructField(
                "top_matches",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("lat", T.DoubleType()),
                            T.StructField("lng", T.DoubleType()),
                            T.StructField("score", T.DoubleType()),
                            T.StructField("best_pin_index", T.IntegerType()),
                            T.StructField("name", T.StringType()),
                            T.StructField("similar_to", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    ),
)
FARMS_CSV = T.StructType([T.StructField(n, T.DoubleType() if n in ("latitude", "longitude") else T.StringType()) for n in ("crop", "farm_name", "latitude", "longitude", "region", "country")])
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


@dataclass(frozen=True)
class GridMeta:
    """Placement of a raster: cell (row, col) counts from the north-west corner."""

    width: int
    height: int
    west: float = -180.0
    south: float = -60.0
    east: float = 180.0
    north: float = 70.0

    @property
    def cell_w(self) -> float:
        return (self.east - self.west) / self.width

    @property
    def cell_h(self) -> float:
        return (self.north - self.south) / self.height

    def cells_of_km(self, km: float) -> int:
        """Cells that a distance spans at the equator, truncated."""
        return int(km / (self.cell_w * KM_PER_DEGREE))
