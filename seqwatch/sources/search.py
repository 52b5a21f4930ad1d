"""Landed responses of a paged id search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: where the ids stand in a response.
RESPONSE_SCHEMA = "esearchresult struct<idlist:array<string>>"


def listed_ids(body: Column) -> Column:
    """The array of ids in a response; NULL when the response is missing or no such document."""
    return F.from_json(body, RESPONSE_SCHEMA)["esearchresult"]["idlist"]


def count_ids(body: Column) -> Column:
    """Number of ids in a response; a response that cannot be read has none."""
    return F.coalesce(F.array_size(listed_ids(body)), F.lit(0))


def listed_pages(responses: DataFrame, offset: str = "retstart", body: str = "body") -> DataFrame:
    """The offset and the ids of each response."""
    return responses.select(offset, listed_ids(F.col(body)).alias("ids"))


def explode_ids(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per listed id, with its ``rank`` in the response, next to the other columns."""
    others = [name for name in responses.columns if name != body]
    return responses.select(*others, F.posexplode(listed_ids(F.col(body))).alias("rank", "id"))
