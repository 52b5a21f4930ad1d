import json
import math

import pytest
from pyspark.sql import functions as F

from seqwatch.functions import crs, geometry as geo
from seqwatch.operators import geometry
from seqwatch.sources.regions import read_regions

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]

#: A published example: the national grid of Great Britain, and the same for a UTM zone.
AIRY = crs.Ellipsoid(6377563.396, 299.3249646)
GRID = crs.System("transverse", AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)


def polygons_of(spark, shapes):
    texts = [None if s is None else s if isinstance(s, str) else json.dumps(s) for s in shapes]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, geometry string")
    return geometry.with_polygons(frame)


def test_shapes(spark):
    shapes = [
        {"type": "Polygon", "coordinates": [SQUARE, HOLE]},
        {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[9, 9, 5], [10, 9, 5], [9, 10, 5], [9, 9, 5]]]]},
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [SQUARE]}]},
        {"type": "Polygon", "coordinates": []},
        None,
        "no json",
        {"type": "Polygon", "coordinates": [SQUARE[:-1]]},
        {"type": "Polygon", "coordinates": [[]]},
    ]
    rows = geometry.measured(polygons_of(spark, shapes)).orderBy("i").collect()
    assert [(r.n_polygons, r.n_rings, r.n_points, r.area) for r in rows] == [
        (1, 2, 10, 15.0), (2, 2, 9, 16.5), (0, 0, 0, 0.0), (1, 1, 5, 16.0), (1, 0, 0, 0.0), (None,) * 4, (None,) * 4, (1, 1, 4, 16.0), (1, 1, 0, 0.0),
    ]
    assert [(r.xmin, r.ymin, r.xmax, r.ymax) for r in rows[:3]] == [(0, 0, 4, 4), (0, 0, 10, 10), (None,) * 4]
    whole = geometry.map_extent(polygons_of(spark, shapes)).first()
    assert (whole.xmin, whole.ymin, whole.xmax, whole.ymax) == (0, 0, 10, 10)


def as_wgs84(spark, rows, **more):
    frame = spark.createDataFrame([(i, epsg, [[[point]]]) for i, (epsg, point) in enumerate(rows)], f"i int, epsg int, polygons {geo.POLYGONS}")
    out = geometry.to_wgs84(frame, **more).orderBy("i").collect()
    return [(r.epsg, tuple(r.polygons[0][0][0])) if r.polygons else (r.epsg, None) for r in out]


def test_published_points(spark):
    rows = [(27700, (577274.99, 69740.50)), (32617, (630084.3, 4833438.55)), (4326, (-74.0, 4.5)), (4686, (-74.0, 4.5)), (9377, (5e6, 2e6)), (3116, (1e6, 1e6))]
    expected = [(0.5, 50.5), (-79.387139, 43.642567), (-74.0, 4.5), (-74.0, 4.5), (-73.0, 4.0), (-74.07750791666666, 4.596200416666666)]
    for (code, found), point in zip(as_wgs84(spark, rows, systems={**crs.SYSTEMS, 27700: GRID}), expected):
        assert code == 4326 and found == pytest.approx(point, abs=2e-6)
    (_, found), = as_wgs84(spark, [(3857, (-8246000.0, 518000.0))])
    assert found == pytest.approx((math.degrees(-8246000 / 6378137), math.degrees(math.atan(math.sinh(518000 / 6378137)))))


def test_datum_shift(spark):
    """The published example of a geocentric translation, backwards; its height of 73 m moves less than 0.1 m."""
    european = crs.System(ellipsoid=crs.INTERNATIONAL_1924, shift=(-84.87, -96.49, -116.95))
    at = (2 + 7 / 60 + 51.477 / 3600, 53 + 48 / 60 + 36.563 / 3600)
    (_, found), = as_wgs84(spark, [(4230, at)], systems={4230: european})
    assert found == pytest.approx((2 + 7 / 60 + 46.38 / 3600, 53 + 48 / 60 + 33.82 / 3600), abs=3e-6)


def forward(system, longitude, latitude):
    """The projection by numbers: the meridian's length by summing small steps, the rest by the textbook's series."""
    a, e2, k = system.ellipsoid.a, system.ellipsoid.e2, system.scale

    def meridian(to):
        n = 20_000
        step = to / n
        return sum(a * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * step) ** 2) ** 1.5 for i in range(n)) * step

    phi, lam = math.radians(latitude), math.radians(longitude - system.longitude)
    second, t = e2 / (1 - e2), math.tan(phi) ** 2
    c, big_a, v = second * math.cos(phi) ** 2, lam * math.cos(phi), a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    x = k * v * (big_a + (1 - t + c) * big_a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * big_a**5 / 120)
    y = k * (meridian(phi) - meridian(math.radians(system.latitude)) + v * math.tan(phi) * (
        big_a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * big_a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * big_a**6 / 720))
    return system.easting + x, system.northing + y


@pytest.mark.parametrize("epsg", [3116, 9377, 3118])
def test_against_the_textbook_series(spark, epsg):
    system = crs.SYSTEMS[epsg]
    places = [(system.longitude + dx, lat) for dx in (-1.5, 0.3, 1.0) for lat in (-4.0, 0.0, 7.5, 12.0)]
    found = as_wgs84(spark, [(epsg, forward(system, *place)) for place in places])
    assert all(point == pytest.approx(place, abs=1e-8) for (_, point), place in zip(found, places))


def test_unknown_systems(spark):
    with pytest.raises(Exception, match="no way from EPSG:99 to WGS 84"):
        as_wgs84(spark, [(99, (1.0, 2.0))])
    assert as_wgs84(spark, [(99, (1.0, 2.0)), (None, (1.0, 2.0)), (4326, (1.0, 2.0))], unknown="null") == [(99, None), (None, None), (4326, (1.0, 2.0))]
    # A feature without geometry needs no system.
    frame = spark.createDataFrame([(None, None)], f"epsg int, polygons {geo.POLYGONS}")
    assert geometry.to_wgs84(frame).collect() == [(None, None)]


def test_names_of_systems(values):
    names = [None, "urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:3116", "urn:ogc:def:crs:EPSG::9377", "urn:ogc:def:crs:EPSG:9.1:32618", "epsg:4686", "something", "EPSG:99999999999"]
    assert values(names, "string", crs.epsg_code) == [4326, 4326, 3116, 9377, 32618, 4686, None, None]


def test_area_on_the_ellipsoid(spark):
    """A half of the earth's surface, a degree at the equator, and a ring's direction."""
    half = [[-180.0, 0.0], [180.0, 0.0], [180.0, 90.0], [-180.0, 90.0]]
    one = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    shapes = [{"type": "Polygon", "coordinates": [ring]} for ring in (half, one, one[::-1])]
    areas = [r.area for r in geometry.measured(polygons_of(spark, shapes), geographic=True).orderBy("i").collect()]
    assert areas[0] == pytest.approx(2 * math.pi * crs.WGS84_ELLIPSOID.authalic_radius**2, rel=1e-12)
    a, e2, step = 6378137.0, crs.WGS84_ELLIPSOID.e2, math.radians(1) / 1000
    bands = ((i + 0.5) * step for i in range(1000))
    expected = math.radians(1) * sum(a * a * (1 - e2) * math.cos(phi) / (1 - e2 * math.sin(phi) ** 2) ** 2 for phi in bands) * step
    assert areas[1] == pytest.approx(expected, rel=1e-7) and areas[2] == areas[1]


def test_collections_keep_their_system(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"DPTO_CNMBR": "x"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}
    named = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3116"}}
    for name, member in (("a", {}), ("b", {"crs": named}), ("c", {"crs": {"type": "EPSG", "properties": {"code": 9377}}}), ("d", {"crs": None})):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", **member, "features": [feature, feature]}))
    rows = read_regions(spark, str(tmp_path), with_epsg=True).groupBy("epsg").count().orderBy("epsg").collect()
    assert [tuple(r) for r in rows] == [(3116, 2), (4326, 4), (9377, 2)]
    assert read_regions(spark, str(tmp_path)).columns == ["DPTO_CNMBR", "geometry"]


def test_nothing_is_shuffled(spark):
    frame = geometry.measured(geometry.to_wgs84(geometry.with_polygons(spark.createDataFrame([(4326, "{}")], "epsg int, geometry string"))))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert frame.select(F.count("*")).first()[0] == 1
