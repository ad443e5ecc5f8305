"""The named queries' inputs, derived from the given tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import centre_lat, centre_lng
from ..operators.raster import band_ranges, kept_ranges, lookup_pins, quantize
from ..schema import GridMeta

WIDTH = 50
#: Threshold of the match queries; the raster is too small for the usual one.
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meta(spark: SparkSession, sf_dir: str) -> GridMeta:
    return GridMeta(WIDTH, -(-table(spark, sf_dir, "embeddings").count() // WIDTH))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, row, col, label, is_land, e): one cell a vector, row by row; label 0 is water."""
    p = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        p.alias("pixel"), F.expr(f"cast(vec_id div {WIDTH} as int)").alias("row"), (p % WIDTH).cast("int").alias("col"), "label", (F.col("label") != 0).alias("is_land"), F.col("embedding").cast("array<double>").alias("e")
    )


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return quantize(c, kept_ranges(band_ranges(c)))


def scan_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The quantised cells and the pins on land, with the bands' ranges computed once for both; only the pins' cells are quantised for the latter."""
    c = cells(spark, sf_dir)
    ranges = kept_ranges(band_ranges(c))
    return quantize(c, ranges), quantized_pins(spark, sf_dir, c, ranges)


def quantized_pins(spark: SparkSession, sf_dir: str, c: DataFrame, ranges: DataFrame) -> DataFrame:
    placed = lookup_pins(pins(spark, sf_dir), c.withColumn("q", F.col("e")), meta(spark, sf_dir))
    return quantize(placed.withColumn("is_land", F.lit(True)), ranges, "q").drop("is_land")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pin_idx, lat, lng, label): the first cell of labels 1 to 5, then a water cell and a point north of the raster."""
    m = meta(spark, sf_dir)
    first = cells(spark, sf_dir).where("label <= 5").groupBy("label").agg(F.min("pixel").alias("p"))
    row, col = F.expr(f"p div {WIDTH}"), F.col("p") % WIDTH
    idx = F.when(F.col("label") == 0, 5).otherwise(F.col("label") - 1).cast("int")
    on = first.select(idx.alias("pin_idx"), centre_lat(row, m).alias("lat"), centre_lng(col, m).alias("lng"), F.when(F.col("label") % 2 == 1, F.concat(F.lit("place "), F.col("label").cast("string"))).otherwise("").alias("label"))
    return on.unionByName(spark.createDataFrame([(6, 85.0, 0.0, None)], "pin_idx int, lat double, lng double, label string"))


def land_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return quantized_pins(spark, sf_dir, c, kept_ranges(band_ranges(c)))


def layer_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The quantised cells, and (layer_id, pin_idx, q): label L is a layer whose pins are its three first cells."""
    from pyspark.sql import Window

    c = cells(spark, sf_dir)
    ranges = kept_ranges(band_ranges(c))
    n = F.row_number().over(Window.partitionBy("label").orderBy("pixel"))
    first = c.where("is_land").select("pixel", "label").withColumn("n", n).where("n <= 3").select("pixel", "n")
    few = quantize(c.join(first, "pixel"), ranges)
    return quantize(c, ranges), few.select(F.concat(F.lit("layer"), F.col("label").cast("string")).alias("layer_id"), (F.col("n") - 1).cast("int").alias("pin_idx"), "q")


def farms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, crop, embedding, yields): label as crop."""
    y = (F.lit(1) + F.col("vec_id") % 7).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("farm"), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("Crop"), F.col("label").cast("string")).alias("crop"), "embedding",
        (y - 1).alias("yield_min"), y.alias("yield_typical"), (y + 2).alias("yield_max"),
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("loc"), (F.lit(2022) + F.col("vec_id") % 3).cast("int").alias("year"), "embedding")


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of maps out of `part`, dated and counted by the orders of the same key."""
    category = F.element_at(F.array(*[F.lit(x) for x in ("Crops", "Climate", "Land", "Odd")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").cast("long").alias("views"))
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), category.alias("category"), (F.col("p_size") * 3 % 17).cast("long").alias("stars"),
        (F.col("p_partkey") % 10 == 0).alias("is_featured"), (F.col("p_partkey") % 3 == 0).alias("has_tiles"),
    )
    return p.join(o, p["id"] == o["o_orderkey"], "left").drop("o_orderkey").withColumn("views", F.coalesce("views", F.lit(0).cast("long")))
