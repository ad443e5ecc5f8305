"""Names, slugs, coordinates and request checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_PINS

# What counts as a pair of coordinates and as a slug.
COORDINATES = r"^\s*(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)\s*$"
SLUG = r"^[a-zA-Z0-9_-]+$"


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def two_decimals(x: Column) -> Column:
    """x to two decimals as C's printf gives it: the double's exact value is rounded, ties to even, where format_string rounds its shortest decimal half up."""
    size, one = F.abs(x), 1 << 60
    whole = F.floor(size)
    part = ((size - whole) * float(one)).cast("long").cast("decimal(19,0)") * 100  # exact: below 1/256, where bits are lost, nothing is near a tie
    rest = part % one
    cents = ((part - rest) / one).cast("long")
    up = (rest > one // 2) | ((rest == one // 2) & (cents % 2 == 1))
    exact = F.signum(x) * ((whole * 100 + cents + up.cast("long")) / 100.0)  # keeps the sign of what becomes zero
    return F.when(x.isNotNull(), F.format_string("%.2f", F.when(size < 1e13, exact).otherwise(x)))


def place_name(local: list[Column], region: list[Column], country: Column, display: Column, lat: Column, lng: Column) -> Column:
    """The first non-empty local name and the country, else region and country, country, two parts of the display name, or the coordinates."""
    first_local, first_region, land = F.coalesce(*map(_some, local)), F.coalesce(*map(_some, region)), _some(country)
    parts = F.split(display, ",", 3)
    two = F.when(F.size(parts) >= 2, F.concat(F.trim(F.get(parts, F.lit(0))), F.lit(","), F.trim(F.get(parts, F.lit(1))))).otherwise(display)
    return F.coalesce(F.concat(first_local, F.lit(", "), land), F.concat(first_region, F.lit(", "), land), land, F.when(_some(display).isNotNull(), two), F.concat(two_decimals(lat), F.lit(", "), two_decimals(lng)))


def coordinates(q: Column) -> Column:
    """struct(lat, lng) of "5.77, -75.77" or "5.77 -75.77"; null for other text and values out of range."""
    lat, lng = F.regexp_extract(q, COORDINATES, 1).try_cast("double"), F.regexp_extract(q, COORDINATES, 2).try_cast("double")
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def pins_problem(pins: Column) -> Column:
    """Why a request's array of (lat, lng) is refused; null if it is fine."""
    return (
        F.when(F.coalesce(F.size(pins), F.lit(0)) < 1, "no pins")
        .when(F.size(pins) > MAX_PINS, "too many pins")
        .when(F.exists(pins, lambda p: ~p["lat"].between(-90, 90)), "latitude out of range")
        .when(F.exists(pins, lambda p: ~p["lng"].between(-180, 180)), "longitude out of range")
    )


def map_text(title: Column, description: Column, author: Column) -> Column:
    """struct(ok, author): title of 1..255 characters, description up to 2000; authors default to anonymous and end after 100."""
    return sized_text(title, F.length(F.coalesce(description, F.lit(""))), author)


def sized_text(title: Column, described: Column, author: Column) -> Column:
    """map_text() of a description that has `described` characters, for those whose length is known without the text."""
    ok = F.length(F.coalesce(title, F.lit(""))).between(1, 255) & (described <= 2000)
    return F.struct(ok.alias("ok"), F.substring(F.coalesce(_some(author), F.lit("anonymous")), 1, 100).alias("author"))


def is_slug(text: Column, longest: int = 100) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(SLUG)) & (F.length(text) <= longest), F.lit(False))


def stable_uuid(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a name; the default namespace is that of domain names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    # one name for the hash, so that it is computed once
    whole = F.transform(F.array(h), lambda x: F.concat(F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-5"), F.substring(x, 14, 3), F.lit("-"), _variant(x), F.substring(x, 18, 3), F.lit("-"), F.substring(x, 21, 12)))
    return F.element_at(whole, 1)


def _variant(x: Column) -> Column:
    return F.element_at(F.split(F.lit("8 9 a b"), " "), F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4 + 1)


def distinct_pins(pins: Column, near: float = 0.01, most: int = MAX_PINS) -> Column:
    """A request's pins (an array of structs with lat and lng) in order, without those within `near` degrees in both directions of an accepted one; `most` at most."""

    def close(p: Column, q: Column) -> Column:
        return (F.abs(p["lat"] - q["lat"]) < near) & (F.abs(p["lng"] - q["lng"]) < near)

    # the accepted ones' places, not the pins, are carried along: their type is known without the column's
    order = F.transform(pins, lambda p, i: F.struct(i.alias("i"), p["lat"].cast("double").alias("lat"), p["lng"].cast("double").alias("lng")))
    none = F.array().cast("array<struct<i:int,lat:double,lng:double>>")
    kept = F.aggregate(order, none, lambda acc, p: F.when((F.size(acc) < most) & ~F.exists(acc, lambda q: close(p, q)), F.concat(acc, F.array(p))).otherwise(acc))
    return F.transform(kept, lambda x: F.get(pins, x["i"]))


def score_band(score: Column) -> Column:
    """strong above 0.8, good above 0.65, else fair: the colour classes of a list of matches."""
    return F.when(score > 0.8, "strong").when(score > 0.65, "good").otherwise("fair")
