"""Column helpers: keys, casts, distances, similarity, formatting. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Earth's radius in miles, as the great-circle formula uses it.
EARTH_MILES = 3961.0
#: Fixed value: metres in one degree of latitude, for radius searches in degrees.
METRES_PER_DEGREE = 111139.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text as a double, null where it isn't one."""
    return col(c).try_cast("double")


def whole(c: Column | str) -> Column:
    """Text or number as a whole number, halves away from zero, null where it isn't one."""
    return F.round(number(c)).try_cast("bigint")


def lot_key(area: Column | str, block: Column | str, lot: Column | str) -> Column:
    """Ten-digit parcel key of one area digit, five block digits and four lot digits."""
    return F.concat(col(area).cast("string"), F.lpad(col(block).cast("string"), 5, "0"), F.lpad(col(lot).cast("string"), 4, "0"))


def lot_key_of(c: Column | str) -> Column:
    """The ten-digit key from a number in any spelling ("1000010001", "1000010001.0"), null where it isn't one."""
    return F.lpad(number(c).try_cast("bigint").cast("string"), 10, "0")


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    inside = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(inside, F.lit(1.0))))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in degrees on the plane."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lng1 - lng2, 2))


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def month_number(c: Column) -> Column:
    """Months since year 0, for differences by calendar month."""
    return (F.year(c) * 12 + F.month(c)).cast("long")


def uuid_text(md5_hex: Column) -> Column:
    """32 hex digits in the grouping of a UUID."""
    return F.regexp_replace(md5_hex, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    n = c.cast("long")
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)
