"""Layer and map catalogues: listing, search, upsert, merge, counters and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


def layer_list(layers: DataFrame, meta: DataFrame) -> DataFrame:
    """(rank, id, name, category, featured, has_tiles): featured, then with tiles, then by name; a layer without metadata is named by its id."""
    from pyspark.sql import Window

    j = layers.join(meta, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("featured", F.lit(False)).alias("featured"), "has_tiles")
    order = Window.orderBy(F.desc("featured"), F.desc("has_tiles"), "name", "id")  # one row a layer
    return j.withColumn("rank", F.row_number().over(order))


def map_page(maps: DataFrame, sort: str = "newest", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of maps: featured first, then by stars, views or date, newest first; ties by id. Pages have 1 to MAX_PAGE rows."""
    keys = {"stars": [F.desc("stars")], "views": [F.desc("views")]}.get(sort, [])
    limit = limit if 1 <= limit <= MAX_PAGE else 20 if limit < 1 else MAX_PAGE
    return maps.orderBy(F.desc("is_featured"), *keys, F.desc("created_at"), "id").offset(max(0, offset)).limit(limit)


def search(maps: DataFrame, text: str) -> DataFrame:
    """Maps with the text in title or category, whatever the case."""
    q = F.lit(text.lower())
    return maps.where(F.contains(F.lower("title"), q) | F.contains(F.lower("category"), q))


def gallery_groups(maps: DataFrame, order: list[str]) -> DataFrame:
    """(position, category, n): maps per category in the given order, unknown ones as Other."""
    names = F.array(*[F.lit(c) for c in order])
    known = F.when(F.array_contains(names, F.col("category")), F.col("category")).otherwise("Other")
    return maps.groupBy(known.alias("category")).agg(F.count("*").alias("n")).withColumn("position", F.array_position(names, F.col("category")).cast("int"))


def gallery(maps: DataFrame, order: list[str], sort: str = "stars") -> DataFrame:
    """Featured maps with their category's position, each category's maps by stars and views, views and stars, or newest first."""
    from pyspark.sql import Window

    names = F.array(*[F.lit(c) for c in order])
    category = F.when(F.array_contains(names, F.col("category")), F.col("category")).otherwise("Other")
    keys = {"stars": ["stars", "views"], "views": ["views", "stars"]}.get(sort, ["created_at"])
    w = Window.partitionBy("category").orderBy(*[F.desc(k) for k in keys], "id")
    shown = maps.where("is_featured").withColumn("category", category).withColumn("rank", F.row_number().over(w))
    return shown.withColumn("position", F.array_position(names, F.col("category")).cast("int"))


def _one_a_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    known = rows.dropna(subset=keys)
    return known.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max(F.struct(*rows.columns)).alias("_whole")).select("_whole.*")


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`current` with the rows of `new` in place of those with the same key; the featured flag of an existing row stays.

    Rows of `new` without a key are left out; of several with one key one is taken, the largest in the order of their columns.
    """
    new = _one_a_key(new, [key])
    kept = current.join(new.select(key), key, "left_anti")
    old = current.select(key, F.col("is_featured").alias("_old"))
    fresh = new.join(old, key, "left").withColumn("is_featured", F.coalesce("_old", "is_featured")).select(*current.columns)
    return kept.unionByName(fresh)


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`current` and the rows of `new` whose keys it lacks, one a key; rows of `new` with a null in their keys are left out."""
    new = _one_a_key(new, keys)
    return current.unionByName(new.join(current, keys, "left_anti").select(*current.columns))


def merge_keyed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union of two keyed tables of the same columns: a record of the right one stands in place of the whole left one, its nulls too. Null keys match nothing."""
    return left.join(right.select(key), key, "left_anti").unionByName(right)


def counters(events: DataFrame, key: str) -> DataFrame:
    """(key, views, stars) from an event log."""
    return events.groupBy(key).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "star").alias("stars"))


def latest_status(log: DataFrame, key: str = "id") -> DataFrame:
    """Current status of each query from an append-only log of (id, ts, status)."""
    return log.groupBy(key).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def geojson(rows: DataFrame, lat: str, lng: str, properties: list[str]) -> DataFrame:
    """(feature): one GeoJSON feature a row."""
    point: Column = F.struct(F.lit("Point").alias("type"), F.array(F.col(lng), F.col(lat)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV with a header, or GeoJSON features as lines of text."""
    if kind == "csv":
        rows.write.option("header", True).csv(path)
    elif kind == "geojson":
        rows.select("feature").write.text(path)
    else:
        raise ValueError(f"unknown export {kind}")
