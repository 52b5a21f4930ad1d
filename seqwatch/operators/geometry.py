"""Boundaries with geometry: read from their text, brought to longitude and latitude, measured."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from seqwatch.functions import crs, geometry as geo
from seqwatch.operators.derived import computed_once


def with_polygons(regions: DataFrame, geometry: str = "geometry", polygons: str = "polygons") -> DataFrame:
    """Adds the polygons in a column of GeoJSON text, read once however often they are used."""
    return computed_once(regions.withColumn(polygons, geo.polygons_of(F.col(geometry))), polygons)


def to_wgs84(
    regions: DataFrame,
    polygons: str = "polygons",
    epsg: str = "epsg",
    unknown: str = "error",
    systems: Mapping[int, crs.System] = crs.SYSTEMS,
) -> DataFrame:
    """Polygons as longitudes and latitudes of WGS 84, each row from the system its code names; ``epsg`` becomes 4326.

    Rows of a system that isn't known fail the query, or, with ``unknown="null"``, lose their polygons. Rows without polygons are left as they are.
    """
    if unknown not in ("error", "null"):
        raise ValueError("unknown is 'error' or 'null'")
    system = crs.parameters(F.col(epsg), systems)
    if unknown == "error":
        refused = F.raise_error(F.concat(F.lit("no way from EPSG:"), F.coalesce(F.col(epsg).cast("string"), F.lit("?")), F.lit(" to WGS 84")))
        system = F.when(F.col(polygons).isNotNull(), F.coalesce(system, refused.cast(regions.select(system.alias("s")).schema["s"].dataType)))
    known = computed_once(regions.withColumn("_system", system), "_system")
    moved = geo.each_ring(F.col(polygons), lambda ring: crs.to_wgs84(ring, F.col("_system")))
    found = F.col("_system").isNotNull()
    code = F.when(found & F.col(polygons).isNotNull(), crs.WGS84).otherwise(F.col(epsg))
    changed = known.withColumns({polygons: F.when(found, moved), epsg: code})
    return computed_once(changed.drop("_system"), polygons).select(*regions.columns)


def measured(regions: DataFrame, polygons: str = "polygons", geographic: bool = False) -> DataFrame:
    """Adds n_polygons, n_rings, n_points, area, xmin, ymin, xmax, ymax. Areas are in the system's units, or in square metres if ``geographic``."""
    shape = F.col(polygons)
    of_ring = geo.geographic_ring_area if geographic else geo.ring_area
    found = regions.withColumns({
        "n_polygons": F.when(shape.isNotNull(), F.size(shape)), "n_rings": F.when(shape.isNotNull(), F.size(geo.rings(shape))),
        "n_points": F.when(shape.isNotNull(), F.size(geo.points(shape))), "area": geo.area(shape, of_ring), "_extent": geo.extent(shape),
    })
    return computed_once(found, "_extent").select("*", "_extent.*").drop("_extent")


def map_extent(regions: DataFrame, by: Sequence[str] = (), polygons: str = "polygons") -> DataFrame:
    """The corners of each map: of all rows, or of those with equal ``by``."""
    corners = computed_once(regions.select(*by, geo.extent(F.col(polygons)).alias("_extent")), "_extent")
    sides = [side(f"_extent.{name}").alias(name) for side, name in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    return corners.groupBy(*by).agg(*sides)
