"""The registered queries of the area and register operators, over the views on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions import geometry as G
from gridfold.functions import text as T
from gridfold.operators import density, filters, lookup, register, spatial
from gridfold.plans import views as V
from gridfold.sources.staging import checkpointed

BOX = (1.0, 1.0, 4.0, 4.0)


def points_in_areas(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_areas(V.points(spark, d), V.areas(spark, d)).select("point_id", "area_name")


def points_left_areas(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_left_areas(V.points(spark, d), V.areas(spark, d)).select("point_id", "area_name")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return density.point_counts(spatial.points_in_areas(V.points(spark, d), V.areas(spark, d)))


def area_point_counts(spark: SparkSession, d: str) -> DataFrame:
    return density.metric_on_areas(V.areas(spark, d), _counts(spark, d)).orderBy("area_ord").select("area_ord", "area_name", "value")


def area_rank(spark: SparkSession, d: str) -> DataFrame:
    return density.rank_areas(_counts(spark, d), 10)


def quantile_breaks(spark: SparkSession, d: str) -> DataFrame:
    return density.quantile_breaks(area_point_counts(spark, d))


def event_value_breaks(spark: SparkSession, d: str) -> DataFrame:
    return density.quantile_breaks(V.read(spark, d, "events"), 10)


def value_range(spark: SparkSession, d: str) -> DataFrame:
    return density.value_range(area_point_counts(spark, d))


def choropleth_classes(spark: SparkSession, d: str) -> DataFrame:
    counted = checkpointed(area_point_counts(spark, d))  # one row an area
    return density.choropleth_classes(counted).select("area_name", "value", "class_index")


def legend_ranges(spark: SparkSession, d: str) -> DataFrame:
    return density.legend_ranges(quantile_breaks(spark, d))


def normalised_name_counts(spark: SparkSession, d: str) -> DataFrame:
    return density.name_counts(V.view(spark, d, V.NAMES), "neighbourhood", "ord")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return register.parse_register(V.register(spark, d))


def strip_sub_unit(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("ord", "sub_unit", "core")


def extract_postcode(spark: SparkSession, d: str) -> DataFrame:
    rows = V.register(spark, d)
    return rows.select("ord", T.find_postcode(T.core_address(F.col("address")), F.col("address")).alias("found"))


def normalise_postcode(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("ord", "postcode")


def housenumber(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("ord", "house_number")


def street_for_match(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("ord", "match_street")


def match_key(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("ord", "match_key")


def tag_bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.tagged_nodes(V.nodes(spark, d), ("amenity",), *BOX)
    return kept.select("id", "lon", "lat", T.tag(F.col("tags"), "name").alias("name"))


def ways_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.tagged_ways(V.ways(spark, d), *BOX).select("id")


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    return filters.buildings(filters.tagged_ways(V.ways(spark, d), -1.0, -1.0, 7.0, 7.0))[0]


def ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _buildings(spark, d).select("ord", F.size("ring").cast("long").alias("n_points"), "centroid_lon", "centroid_lat", "match_key")


def areas_envelope_prefix(spark: SparkSession, d: str) -> DataFrame:
    near = filters.areas_in_box(spatial.area_edges(V.areas(spark, d)), 1.3, 0.9, 2.9, 3.1)
    return filters.areas_by_prefix(near, "NATION_1").select("area_ord", "area_name")


def building_index(spark: SparkSession, d: str) -> DataFrame:
    return lookup.building_index(_buildings(spark, d)).select("match_key", "ord", "addr_postcode")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.postcode_lookup(_buildings(spark, d), V.areas(spark, d))


def postcode_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d).orderBy("postcode")


def postcode_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _buildings(spark, d).select(F.lower("addr_postcode").alias("postcode"), "ord", "centroid_lon", "centroid_lat")
    return lookup.postcode_index(rows)


def lookup_coverage(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_coverage(_lookup(spark, d))


def _matched(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    made = _buildings(spark, d) if made is None else made
    places = lookup.postcode_lookup(made, V.areas(spark, d)).withColumn("ord", F.lit(0))
    return register.match_register(V.register(spark, d), made, places)


def register_rows(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("ord", "kind", "lsoa", "match_key", "postcode", "building_ord", "pc_lat", "pc_lon")


def register_area_counts(spark: SparkSession, d: str) -> DataFrame:
    return density.metric_on_areas(V.areas(spark, d), register.area_counts(_matched(spark, d))).select("area_name", "value")


def building_groups(spark: SparkSession, d: str) -> DataFrame:
    return register.building_groups(_matched(spark, d))


def fallback_groups(spark: SparkSession, d: str) -> DataFrame:
    return register.fallback_groups(_matched(spark, d))


def match_funnel(spark: SparkSession, d: str) -> DataFrame:
    return register.match_funnel(_matched(spark, d))


def metric_join(spark: SparkSession, d: str) -> DataFrame:
    held = V.read(spark, d, "customer").where("c_nationkey % 4 <> 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    metric = held.select(F.concat(F.lit("NATION_"), "c_nationkey").alias("area_name"), "cents")
    named = V.areas(spark, d).withColumn("area_name", F.when(F.col("area_ord") % 7 == 0, F.lit("")).otherwise(F.col("area_name")))
    return density.labelled(density.metric_on_areas(named, metric, value="cents")).select("area_ord", "label", "value")


def point_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).select("point_id", T.point_label(F.col("name"), F.col("amenity")).alias("label"))


def feature_details(spark: SparkSession, d: str) -> DataFrame:
    groups = register.building_groups(_matched(spark, d))
    names = ("address", "sub_units", "entry_count", "hmo_id", "licence_start", "licence_end")
    return groups.select("match_key", T.feature_details({n: F.col(n) for n in names}).alias("details"))


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    made = _buildings(spark, d)
    properties = {n: F.col(n) for n in ("addr_housenumber", "addr_street", "addr_postcode", "match_key", "centroid_lat", "centroid_lon")}
    return made.select("ord", G.feature("Polygon", F.array("ring"), **properties).alias("feature"))


def building_features(spark: SparkSession, d: str) -> DataFrame:
    made = _buildings(spark, d)
    return register.building_features(register.building_groups(_matched(spark, d, made)), made)


def fallback_features(spark: SparkSession, d: str) -> DataFrame:
    return register.fallback_features(register.fallback_groups(_matched(spark, d)))


def register_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = V.register(spark, d).select("ord", F.col("id").alias("Register ID"), F.col("address").alias(" Full Address "), F.col("licence_start").alias("Start date"), F.col("licence_end").alias("Gender"), F.lit("x").alias("Notes"))
    return T.with_roles(rows, "ord")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        points_in_areas, points_left_areas, area_point_counts, area_rank, quantile_breaks, event_value_breaks, value_range, choropleth_classes, legend_ranges,
        normalised_name_counts, strip_sub_unit, extract_postcode, normalise_postcode, housenumber, street_for_match, match_key, tag_bbox_filter, ways_filter,
        ring_centroid, areas_envelope_prefix, building_index, postcode_index, postcode_lookup, lookup_coverage, register_rows, register_area_counts,
        building_groups, fallback_groups, match_funnel, metric_join, point_labels, feature_details, geojson_features, building_features, fallback_features, register_roles,
    ]
    return {f.__name__: f for f in listed}
