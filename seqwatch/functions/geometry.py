"""Areas as nested arrays: polygons of rings of points, and what can be computed from them row by row.

A polygon's first ring is its border, the others are holes, as in GeoJSON. Rings are closed; one that isn't is taken as if it were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from seqwatch.functions.crs import WGS84_ELLIPSOID, Ellipsoid

POINT = "struct<x:double,y:double>"
POLYGONS = f"array<array<array<{POINT}>>>"

_POSITIONS = "array<array<array<double>>>"
_SHAPE = "type string, coordinates string, geometries array<struct<type:string,coordinates:string>>"


def polygons_of(geometry: Column) -> Column:
    """The polygons of a GeoJSON geometry's text: of a Polygon, a MultiPolygon, or those in a collection.

    Other kinds have none (an empty array). NULL for NULL and for what is no geometry. Heights are left out.
    """

    def positions(kind: Column, coordinates: Column) -> Column:
        one = F.from_json(coordinates, _POSITIONS)
        many = F.from_json(coordinates, f"array<{_POSITIONS}>")
        return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).otherwise(F.array().cast(f"array<{_POSITIONS}>"))

    # In an array of one, the text is read once.
    shape = F.array(F.from_json(geometry, _SHAPE))
    found = F.transform(shape, lambda s: F.when(
        s["type"] == "GeometryCollection", F.flatten(F.transform(s["geometries"], lambda g: positions(g["type"], g["coordinates"])))
    ).when(s["type"].isNotNull(), positions(s["type"], s["coordinates"])))[0]
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(found, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def each_ring(polygons: Column, change: Callable[[Column], Column]) -> Column:
    return F.transform(polygons, lambda polygon: F.transform(polygon, change))


def rings(polygons: Column) -> Column:
    return F.flatten(polygons)


def points(polygons: Column) -> Column:
    return F.flatten(F.flatten(polygons))


def ring_area(ring: Column) -> Column:
    """Of a ring on a plane, by the trapezoids between its points and the first one's level. Positive if it runs against the clock."""
    first, following = ring[0], F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pieces = F.zip_with(ring, following, lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))
    return F.when(F.size(ring) > 0, F.aggregate(pieces, F.lit(0.0), lambda total, piece: total + piece) / 2).otherwise(0.0)


def geographic_ring_area(ring: Column, ellipsoid: Ellipsoid = WGS84_ELLIPSOID) -> Column:
    """Of a ring of longitudes and latitudes, in square metres: its area in the cylindrical projection that keeps areas."""
    return ring_area(_equal_area(ring, ellipsoid))


def _equal_area(ring: Column, ellipsoid: Ellipsoid) -> Column:
    e = ellipsoid.e2**0.5

    def height(latitude: Column) -> Column:
        s = F.sin(F.radians(latitude))
        return ellipsoid.a * (1 - ellipsoid.e2) / 2 * (s / (1 - ellipsoid.e2 * s * s) + F.atanh(e * s) / e)

    return F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * ellipsoid.a).alias("x"), height(p["y"]).alias("y")))


def area(polygons: Column, of_ring: Callable[[Column], Column] = ring_area) -> Column:
    """The polygons' borders' areas less those of their holes; NULL for NULL, 0 for none."""
    sizes = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.abs(of_ring(ring))))
    # Twice the border less all rings is the border less the holes.
    parts = F.transform(sizes, lambda s: F.aggregate(s, F.coalesce(2 * F.get(s, F.lit(0)), F.lit(0.0)), lambda total, ring: total - ring))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def extent(polygons: Column) -> Column:
    """Struct of xmin, ymin, xmax, ymax; of NULLs where there are no points."""
    every = points(polygons)
    xs, ys = F.transform(every, lambda p: p["x"]), F.transform(every, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def degree_of_longitude(latitude: Column, ellipsoid: Ellipsoid = WGS84_ELLIPSOID) -> Column:
    """How many metres along the parallel a degree is."""
    s = F.sin(F.radians(latitude))
    return F.radians(F.lit(1.0)) * ellipsoid.a * F.cos(F.radians(latitude)) / F.sqrt(1 - ellipsoid.e2 * s * s)
