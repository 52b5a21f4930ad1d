"""Region boundaries in GeoJSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqwatch.functions.crs import epsg_code

CRS = "crs struct<type:string,properties:struct<name:string,code:int>>"

# Fixed value: the attribute that names a region.
REGION_ATTRIBUTES = {"DPTO_CNMBR": "string"}


def read_regions(
    spark: SparkSession,
    path: str | list[str],
    attributes: Mapping[str, str] = REGION_ATTRIBUTES,
    multi_line: bool = True,
    with_epsg: bool = False,
) -> DataFrame:
    """One row per feature: the named attributes and the geometry as its JSON text, unchanged.

    ``with_epsg`` adds the code of the reference system that the feature's collection names: 4326 if it names none, NULL if the
    name isn't understood.

    A feature collection is one JSON document and is read whole, as boundary files are. With
    ``multi_line=False`` every line is a document of its own (a feature or a collection), and a large
    file is read by many tasks.
    """
    properties = ",".join(f"`{name}`:{kind}" for name, kind in attributes.items())
    feature = f"properties:struct<{properties}>,geometry:string"
    documents = spark.read.json(
        path,
        schema=f"type string, features array<struct<{feature}>>, properties struct<{properties}>, geometry string, {CRS}",
        multiLine=multi_line,
    )
    single = F.when(F.col("type") == "Feature", F.array(F.struct("properties", "geometry")))
    named = F.col("crs.properties")
    epsg = F.when(named["name"].isNull() & named["code"].isNotNull(), named["code"]).otherwise(epsg_code(named["name"])).alias("epsg")
    features = documents.select(epsg, F.explode(F.coalesce("features", single)).alias("feature"))
    return features.select(
        *[F.col(f"feature.properties.`{name}`").alias(name) for name in attributes],
        F.col("feature.geometry").alias("geometry"),
        *(["epsg"] if with_epsg else []),
    )
