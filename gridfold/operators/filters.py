"""Filters on map elements, areas and rows, and the constructors that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.geometry import centroid, meets_box, ring_of_four, way_ring
from gridfold.functions.text import match_key, present, tag

BUILDING_TAGS = ("building", "addr:housenumber", "addr:street")


def tagged_nodes(elements: DataFrame, tags: tuple[str, ...], south: float, west: float, north: float, east: float) -> DataFrame:
    """Nodes that carry all the tags and lie in the box, bounds included."""
    held = F.lit(True)
    for t in tags:
        held = held & F.coalesce(F.map_contains_key("tags", F.lit(t)), F.lit(False))
    return elements.where(held & F.col("lat").between(south, north) & F.col("lon").between(west, east))


def tagged_ways(elements: DataFrame, south: float, west: float, north: float, east: float, tags: tuple[str, ...] = BUILDING_TAGS) -> DataFrame:
    """Ways of three or more nodes that carry all the tags and whose envelope meets the box."""
    held = (F.col("type") == "way") & (F.size("geometry") >= 3)
    for t in tags:
        held = held & F.coalesce(F.map_contains_key("tags", F.lit(t)), F.lit(False))
    xs, ys = F.transform("geometry", lambda g: g["lon"]), F.transform("geometry", lambda g: g["lat"])
    meets = (F.array_min(xs) <= east) & (F.array_max(xs) >= west) & (F.array_min(ys) <= north) & (F.array_max(ys) >= south)
    return elements.where(held & meets)


def buildings(ways: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Buildings, and the ways rejected for a ring of fewer than four points.

    A building has ``ord``, address parts, match key, ring and centroid.
    """
    # Told before rings are made, so that a filter does not make them once more.
    whole = ring_of_four(F.col("geometry"))
    ringed = lambda rows: rows.withColumn("ring", way_ring(F.col("geometry")))
    part = lambda n: tag(F.col("tags"), n)
    good = ringed(ways.where(whole)).select(F.col(order).alias("ord"), part("addr:housenumber").alias("addr_housenumber"), part("addr:street").alias("addr_street"), part("addr:postcode").alias("addr_postcode"), "ring", centroid(F.col("ring")).alias("c"))
    good = good.select("ord", "addr_housenumber", "addr_street", "addr_postcode", match_key(F.col("addr_housenumber"), F.col("addr_street")).alias("match_key"), "ring", F.col("c.lat").alias("centroid_lat"), F.col("c.lon").alias("centroid_lon"))
    return good, ringed(ways.where(~whole))


def areas_in_box(areas: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Areas (column ``edges``) that share a point with the box."""
    return areas.where(meets_box(F.col("edges"), west, south, east, north))


def areas_by_prefix(areas: DataFrame, prefix: str, name: str = "area_name") -> DataFrame:
    """Areas whose name starts with the prefix; a missing name is empty."""
    return areas.where(F.startswith(F.coalesce(F.col(name), F.lit("")), F.lit(prefix)))


def not_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column holds more than white space."""
    return df.where(F.rlike(present(F.col(column)), F.lit(r"(?U)\S")))


def with_key(df: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't empty."""
    return df.where(present(F.col(column)) != "")
