"""Geodesic and geohash expressions, all within generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Mean Earth radius, metres in a degree, the geohash alphabet.
EARTH_M = 6_371_008.8
DEGREE_M = 111_320.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: The alphabet by the three bits of one coordinate, then the two of the other.
_BY_AXIS = "".join(BASE32[(k >> 4 & 1) * 16 + (k >> 1 & 1) * 8 + (k >> 3 & 1) * 4 + (k & 1) * 2 + (k >> 2 & 1)] for k in range(32))


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(1, a): that would take an unknown place for the far side of the Earth
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def bbox_around(lat, lon, radius_m) -> Column:
    """Struct of min_lat, max_lat, min_lon, max_lon that holds the circle; a point for a
    radius of zero or less, all longitudes near a pole."""
    lat, lon, r = map(_c, (lat, lon, radius_m))
    r = F.greatest(r, F.lit(0.0))
    dlat = F.degrees(r / EARTH_M)
    cos = F.cos(F.radians(lat))
    dlon = F.when(cos > 1e-9, F.least(F.degrees(r / (EARTH_M * F.greatest(cos, F.lit(1e-9)))), F.lit(180.0))).otherwise(F.lit(180.0))
    return F.struct((lat - dlat).alias("min_lat"), (lat + dlat).alias("max_lat"), (lon - dlon).alias("min_lon"), (lon + dlon).alias("max_lon"))


def valid_coordinates(lat, lon) -> Column:
    return _c(lat).between(-90.0, 90.0) & _c(lon).between(-180.0, 180.0)


def _bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude in a geohash."""
    total = 5 * precision
    return (total + 1) // 2, total // 2


def geohash(lat, lon, precision: int) -> Column:
    """Geohash of 1 to 12 characters; a point on a border belongs to the upper cell.
    Each coordinate's bits come from one division; a character has three bits of one and two
    of the other."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    lon_bits, lat_bits = _bits(precision)
    scaled = lambda x, low, width, bits: F.least(F.floor((_c(x) - low) / width * float(1 << bits)), F.lit((1 << bits) - 1)).cast("bigint")
    x, y = scaled(lon, -180.0, 360.0, lon_bits), scaled(lat, -90.0, 180.0, lat_bits)

    def text(x: Column, y: Column) -> Column:
        chars = []
        for k in range(precision):
            three, two = (x, y) if k % 2 == 0 else (y, x)
            left = {id(x): lon_bits - (5 * k + 6) // 2, id(y): lat_bits - (5 * k + 5) // 2}
            part = lambda v, mask, left=left: F.shiftright(v, left[id(v)]).bitwiseAND(F.lit(mask))
            chars.append(F.substring(F.lit(_BY_AXIS), (part(three, 7) * 4 + part(two, 3) + 1).cast("int"), F.lit(1)))
        return F.concat(*chars)

    plain = isinstance(lat, str) and isinstance(lon, str)
    found = text(x, y) if plain else _let(F.struct(x.alias("x"), y.alias("y")), lambda q: text(q["x"], q["y"]))
    return F.when(valid_coordinates(lat, lon), found)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` written out, and so computed, once. Plain columns
    do without, as generated code shares what they have in common."""
    return F.transform(F.array(value), use)[0]


def cell_size_deg(precision: int) -> tuple[float, float]:
    """(height, width) of a cell in degrees."""
    lon_bits, lat_bits = _bits(precision)
    return 180.0 / (1 << lat_bits), 360.0 / (1 << lon_bits)


def cell_size_m(precision: int, lat: Column | float = 0.0) -> tuple[Column, Column]:
    height, width = cell_size_deg(precision)
    return F.lit(height * DEGREE_M), F.lit(width * DEGREE_M) * F.cos(F.radians(_c(lat)))


def geohash_box(cell: str | Column, precision: int) -> Column:
    """Struct min_lat, max_lat, min_lon, max_lon of a cell of ``precision`` characters. From a
    column's name it stays within generated code; other expressions are computed once."""
    height, width = cell_size_deg(precision)

    def box(cell: Column) -> Column:
        x = y = F.lit(0).cast("bigint")
        for k in range(precision):
            value = F.instr(F.lit(_BY_AXIS), F.substring(cell, k + 1, 1)).cast("bigint") - 1
            three, two = F.shiftright(value, 2).bitwiseAND(F.lit(7)), value.bitwiseAND(F.lit(3))
            if k % 2 == 0:
                x, y = x * 8 + three, y * 4 + two
            else:
                x, y = x * 4 + two, y * 8 + three
        lat, lon = F.lit(-90.0) + y * height, F.lit(-180.0) + x * width
        return F.struct(lat.alias("min_lat"), (lat + height).alias("max_lat"), lon.alias("min_lon"), (lon + width).alias("max_lon"))

    return box(F.col(cell)) if isinstance(cell, str) else _let(cell, box)


def geohash_center(cell: str | Column, precision: int) -> Column:
    height, width = cell_size_deg(precision)
    centre = lambda b: F.struct((b["min_lat"] + height / 2).alias("lat"), (b["min_lon"] + width / 2).alias("lon"))
    box = geohash_box(cell, precision)
    return centre(box) if isinstance(cell, str) else _let(box, centre)


def cell_polygon(cell: str | Column, precision: int) -> Column:
    """The closed ring of a cell as [lon, lat] pairs, rounded to seven places."""

    def ring(b: Column) -> Column:
        corner = lambda lon, lat: F.array(F.round(b[lon], 7), F.round(b[lat], 7))
        return F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat"), corner("min_lon", "min_lat"))

    return _let(geohash_box(cell, precision), ring)


def circle_ring(lat, lon, radius_m, points: int = 48) -> Column:
    """A closed ring of ``points`` + 1 [lon, lat] pairs around a centre."""
    lat, lon, r = map(_c, (lat, lon, radius_m))
    angle = lambda k: k * (2 * 3.141592653589793 / points)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points)),
        lambda k: F.array(F.round(lon + r * F.cos(angle(k % points)) / (F.lit(DEGREE_M) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))), 7), F.round(lat + r * F.sin(angle(k % points)) / DEGREE_M, 7)),
    )


def closed_ring(ring: Column) -> Column:
    """``ring`` with its first point at the end, if it is not there."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def cells_in_box(min_lat, max_lat, min_lon, max_lon, precision: int) -> Column:
    """Distinct cells that a box touches."""
    height, width = cell_size_deg(precision)
    lats = F.sequence(F.floor((_c(min_lat) + 90) / height), F.floor((_c(max_lat) + 90) / height))
    lons = F.sequence(F.floor((_c(min_lon) + 180) / width), F.floor((_c(max_lon) + 180) / width))
    return F.array_distinct(F.flatten(F.transform(lats, lambda y: F.transform(lons, lambda x: geohash((y + 0.5) * height - 90, (x + 0.5) * width - 180, precision)))))


def parse_bbox(text: str | Column) -> Column:
    """``min_lon,min_lat,max_lon,max_lat`` to a struct; null where it is malformed."""
    p = F.transform(F.split(_c(text), ","), lambda x: F.trim(x).try_cast("double"))
    ok = (F.size(p) == 4) & (F.try_element_at(p, F.lit(1)) <= F.try_element_at(p, F.lit(3))) & (F.try_element_at(p, F.lit(2)) <= F.try_element_at(p, F.lit(4)))
    part = lambda k: F.try_element_at(p, F.lit(k))
    return F.when(ok, F.struct(part(1).alias("min_lon"), part(2).alias("min_lat"), part(3).alias("max_lon"), part(4).alias("max_lat")))


def format_bbox(min_lon, min_lat, max_lon, max_lat) -> Column:
    return F.format_string("%.6f,%.6f,%.6f,%.6f", *map(_c, (min_lon, min_lat, max_lon, max_lat)))
