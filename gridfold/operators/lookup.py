"""Building and postcode indexes, the postcode lookup, and its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.functions.text import normalise_postcode
from gridfold.operators.filters import not_blank, with_key
from gridfold.operators.spatial import points_left_areas
from gridfold.sources.staging import stage_keyed


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``, which tells the rows of a key apart; each task keeps one row a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(order)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``, as in :func:`first_by`."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def building_index(buildings: DataFrame, order: str = "ord") -> DataFrame:
    """Buildings by match key; the first of each key stands for it, empty keys are left out."""
    return first_by(with_key(buildings, "match_key"), "match_key", order)


def postcode_index(lookup: DataFrame, order: str = "ord") -> DataFrame:
    """The postcode lookup by normalised postcode; the last row of each stands for it."""
    rows = lookup.withColumn("postcode", normalise_postcode(F.col("postcode")))
    return last_by(with_key(rows, "postcode"), "postcode", order)


def keyed_buildings(buildings: DataFrame) -> DataFrame:
    """``(match_key, building_ord)``: the first building of each key, with its ``building_postcode`` where ``buildings`` have ``addr_postcode``."""
    rows = with_key(buildings, "match_key").select("match_key", F.col("ord").alias("building_ord"), *(normalise_postcode(F.col(c)).alias("building_postcode") for c in buildings.columns if c == "addr_postcode"))
    return first_by(rows, "match_key", "building_ord")


def keyed_postcodes(lookup: DataFrame) -> DataFrame:
    """``(postcode, area, pc_lat, pc_lon)``: the last row of each normalised postcode."""
    return postcode_index(lookup).select("postcode", F.col("lsoa").alias("area"), F.col("centroid_lat").alias("pc_lat"), F.col("centroid_lon").alias("pc_lon"))


def stage_lookups(buildings: DataFrame, lookup: DataFrame, name: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """What registers are matched with, reduced once and kept as the tables ``{name}_buildings`` and ``{name}_postcodes`` in buckets by key.

    Later registers neither read buildings again nor reduce or shuffle them: see :func:`staged_lookups`.
    """
    stage_keyed(keyed_buildings(buildings), f"{name}_buildings", "match_key", buckets)
    stage_keyed(keyed_postcodes(lookup), f"{name}_postcodes", "postcode", buckets)
    return staged_lookups(buildings.sparkSession, name)


def staged_lookups(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """The tables that :func:`stage_lookups` wrote, for :func:`gridfold.operators.register.match_keyed`."""
    return spark.table(f"{name}_buildings"), spark.table(f"{name}_postcodes")


def postcode_lookup(buildings: DataFrame, areas: DataFrame, order: str = "ord", cell: float | None = None) -> DataFrame:
    """``(postcode, lsoa, centroid_lat, centroid_lon)``: the area at the first building of each postcode.

    Blank postcodes are left out; an area that isn't found is the empty string. Containment is tested
    once for each postcode, after the reduction.
    """
    rows = not_blank(buildings, "addr_postcode").select(F.col("addr_postcode").alias("postcode"), F.col(order).alias("ord"), "centroid_lon", "centroid_lat")
    # Numbers alone are carried, so the reduction is by hash.
    first = rows.groupBy("postcode").agg(*(F.min_by(c, "ord").alias(c) for c in ("centroid_lon", "centroid_lat")))
    placed = points_left_areas(first.select("postcode", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat")), areas, cell, point_id="postcode")
    return placed.select("postcode", F.col("area_name").alias("lsoa"), F.col("lat").alias("centroid_lat"), F.col("lon").alias("centroid_lon"))


def lookup_coverage(lookup: DataFrame) -> DataFrame:
    """One row: postcodes with and without an area."""
    return lookup.agg(F.count_if(F.col("lsoa") != "").alias("with_area"), F.count_if(F.col("lsoa") == "").alias("without_area"))
