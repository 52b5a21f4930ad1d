"""Coordinate reference systems as columns: their parameters, and the way from their coordinates to WGS 84.

A transverse Mercator projection is undone by Krüger's series to the fourth order (under a millimetre within a zone's width), a
datum by three geocentric shifts. All steps are expressions, so a table may hold boundaries in several systems.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

WGS84 = 4326


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def rectifying_radius(self) -> float:
        return self.a / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)

    @property
    def authalic_radius(self) -> float:
        """Of the sphere with the same surface."""
        e = math.sqrt(self.e2)
        return self.a * math.sqrt(0.5 + (1 - self.e2) / (2 * e) * math.atanh(e))


# Ellipsoids (semi-major axis in metres, inverse flattening).
GRS80 = Ellipsoid(6378137.0, 298.257222101)
WGS84_ELLIPSOID = Ellipsoid(6378137.0, 298.257223563)
INTERNATIONAL_1924 = Ellipsoid(6378388.0, 297.0)


@dataclass(frozen=True)
class System:
    """A reference system: ``kind`` is geographic, transverse (Mercator) or mercator (of a sphere). Angles in degrees, lengths in metres.

    ``shift`` leads from the system's geocentric coordinates to those of WGS 84.
    """

    kind: str = "geographic"
    ellipsoid: Ellipsoid = GRS80
    latitude: float = 0.0
    longitude: float = 0.0
    scale: float = 1.0
    easting: float = 0.0
    northing: float = 0.0
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)


def _zone(longitude: float) -> System:
    return System("transverse", GRS80, 4.596200416666666, longitude, 1.0, 1e6, 1e6)


def _old_zone(longitude: float) -> System:
    return System("transverse", INTERNATIONAL_1924, 4.599047222222222, longitude, 1.0, 1e6, 1e6, _BOGOTA_SHIFT)


# Systems of the EPSG registry in use for Colombia, with WGS 84 and the web maps' Mercator. UTM zones follow a rule, below.
_BOGOTA_SHIFT = (307.0, 304.0, -318.0)
SYSTEMS: dict[int, System] = {
    4326: System(ellipsoid=WGS84_ELLIPSOID),
    4686: System(),
    4218: System(ellipsoid=INTERNATIONAL_1924, shift=_BOGOTA_SHIFT),
    3857: System("mercator", WGS84_ELLIPSOID),
    9377: System("transverse", GRS80, 4.0, -73.0, 0.9992, 5e6, 2e6),
    3114: _zone(-80.07750791666666),
    3115: _zone(-77.07750791666666),
    3116: _zone(-74.07750791666666),
    3117: _zone(-71.07750791666666),
    3118: _zone(-68.07750791666666),
    21896: _old_zone(-77.08091666666667),
    21897: _old_zone(-74.08091666666667),
    21898: _old_zone(-71.08091666666667),
    21899: _old_zone(-68.08091666666667),
}
# The first codes of the UTM zones of WGS 84, north and south, and their false northings.
UTM = ((32600, 0.0), (32700, 1e7))

_EPSG_NAME = r"(?i)EPSG:(?:[0-9.]*:)?([0-9]+)$"


def epsg_code(name: Column) -> Column:
    """The number in the name of a system, as GeoJSON's ``crs`` has it; WGS 84 for its CRS84 and for no name, NULL for what isn't understood."""
    code = F.nullif(F.regexp_extract(name, _EPSG_NAME, 1), F.lit("")).try_cast("int")
    return F.when(name.isNull() | name.rlike(r"(?i)CRS:?84$"), WGS84).otherwise(code)


# Krüger's series


def _to_sphere(n: float) -> list[float]:
    """From rectifying to conformal coordinates."""
    return [
        n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
        17 / 480 * n**3 - 37 / 840 * n**4,
        4397 / 161280 * n**4,
    ]


def _from_sphere(n: float) -> list[float]:
    """From conformal to rectifying coordinates."""
    return [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ]


def _to_latitude(n: float) -> list[float]:
    """From conformal to geographic latitude."""
    return [
        2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
        7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
        56 / 15 * n**3 - 136 / 35 * n**4,
        4279 / 630 * n**4,
    ]


def _northing_of_origin(system: System) -> float:
    """How far the origin of a projection is from the equator."""
    phi, e = math.radians(system.latitude), math.sqrt(system.ellipsoid.e2)
    chi = math.atan(math.sinh(math.asinh(math.tan(phi)) - e * math.atanh(e * math.sin(phi))))
    xi = chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(_from_sphere(system.ellipsoid.n), 1))
    return system.scale * system.ellipsoid.rectifying_radius * xi


def _parameters(system: System, longitude: Column | None = None) -> Column:
    n = system.ellipsoid.n
    numbers = {
        "a": system.ellipsoid.a,
        "e2": system.ellipsoid.e2,
        "radius": system.scale * system.ellipsoid.rectifying_radius,
        "easting": system.easting,
        "northing": system.northing - _northing_of_origin(system),
        "dx": system.shift[0],
        "dy": system.shift[1],
        "dz": system.shift[2],
    }
    return F.struct(
        F.lit(system.kind).alias("kind"),
        F.radians(F.lit(system.longitude) if longitude is None else longitude.cast("double")).alias("longitude"),
        *[F.lit(value).alias(name) for name, value in numbers.items()],
        F.array(*map(F.lit, _to_sphere(n))).alias("to_sphere"),
        F.array(*map(F.lit, _to_latitude(n))).alias("to_latitude"),
    )


def parameters(epsg: Column, systems: Mapping[int, System] = SYSTEMS) -> Column:
    """What leads from a system to WGS 84, as a struct; NULL for an unknown code."""
    known = F.create_map(*[x for code, system in systems.items() for x in (F.lit(code), _parameters(system))])
    found = F.try_element_at(known, epsg.cast("int"))
    for first, northing in UTM:
        zone = System("transverse", WGS84_ELLIPSOID, 0.0, 0.0, 0.9996, 5e5, northing)
        found = F.when(epsg.between(first + 1, first + 60), _parameters(zone, 6 * (epsg - first) - 183)).otherwise(found)
    return found


# Points


def to_wgs84(points: Column, system: Column) -> Column:
    """An array of structs x, y of the system (as ``parameters`` gives it) as longitudes and latitudes in degrees, under the same names."""
    geographic = _degrees_of(points)
    mercator = _each(points, lambda p: {"lon": p["x"] / system["a"], "lat": F.atan(F.sinh(p["y"] / system["a"]))})
    angles = F.when(system["kind"] == "transverse", _undo_transverse(points, system)).when(system["kind"] == "mercator", mercator).otherwise(geographic)
    shifted = (system["dx"] != 0) | (system["dy"] != 0) | (system["dz"] != 0)
    in_degrees = {"x": lambda p: F.degrees(p["lon"]), "y": lambda p: F.degrees(p["lat"])}
    moved = _each(_shift(angles, system), lambda p: {name: part(p) for name, part in in_degrees.items()})
    unmoved = _each(angles, lambda p: {name: part(p) for name, part in in_degrees.items()})
    as_given = (system["kind"] == "geographic") & ~shifted
    return F.when(as_given, points).when(shifted, moved).otherwise(unmoved)


def _each(points: Column, parts: Callable[[Column], dict[str, Column]]) -> Column:
    """A struct for each point. What later steps use more than once is a field of an earlier one, so nothing is computed twice."""
    return F.transform(points, lambda p: F.struct(*[part.alias(name) for name, part in parts(p).items()]))


def _degrees_of(points: Column) -> Column:
    return _each(points, lambda p: {"lon": F.radians(p["x"]), "lat": F.radians(p["y"])})


def _series(coefficients: Column, term: Callable[[int], Column]) -> Column:
    total = coefficients[0] * term(1)
    for j in range(2, 5):
        total = total + coefficients[j - 1] * term(j)
    return total


def _undo_transverse(points: Column, system: Column) -> Column:
    plane = _each(points, lambda p: {"xi": (p["y"] - system["northing"]) / system["radius"], "eta": (p["x"] - system["easting"]) / system["radius"]})
    terms = system["to_sphere"]
    sphere = _each(plane, lambda p: {
        "xi": p["xi"] - _series(terms, lambda j: F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])),
        "eta": p["eta"] - _series(terms, lambda j: F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])),
    })
    conformal = _each(sphere, lambda p: {
        "lon": system["longitude"] + F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])), "chi": F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])),
    })
    return _each(conformal, lambda p: {"lon": p["lon"], "lat": p["chi"] + _series(system["to_latitude"], lambda j: F.sin(2 * j * p["chi"]))})


def _shift(angles: Column, system: Column) -> Column:
    """Longitudes and latitudes of another datum as those of WGS 84, at height 0, through geocentric coordinates."""
    target = WGS84_ELLIPSOID
    b, second = target.a * (1 - target.f), target.e2 / (1 - target.e2)
    normal = _each(angles, lambda p: {"lon": p["lon"], "lat": p["lat"], "v": system["a"] / F.sqrt(1 - system["e2"] * F.sin(p["lat"]) * F.sin(p["lat"]))})
    placed = _each(normal, lambda p: {
        "x": p["v"] * F.cos(p["lat"]) * F.cos(p["lon"]) + system["dx"], "y": p["v"] * F.cos(p["lat"]) * F.sin(p["lon"]) + system["dy"],
        "z": p["v"] * (1 - system["e2"]) * F.sin(p["lat"]) + system["dz"],
    })
    away = _each(placed, lambda p: {"lon": F.atan2(p["y"], p["x"]), "z": p["z"], "r": F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])})
    turned = _each(away, lambda p: {"lon": p["lon"], "z": p["z"], "r": p["r"], "t": F.atan2(p["z"] * target.a, p["r"] * b)})
    return _each(turned, lambda p: {
        "lon": p["lon"],
        "lat": F.atan2(p["z"] + second * b * F.pow(F.sin(p["t"]), F.lit(3)), p["r"] - target.e2 * target.a * F.pow(F.cos(p["t"]), F.lit(3))),
    })
