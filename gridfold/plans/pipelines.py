"""The four entry points as plans: area density, lookup build, register to classes, and pre-aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.geometry import feature
from gridfold.functions.text import point_label, tag, with_roles
from gridfold.operators import density, filters, lookup, register, spatial
from gridfold.sources import readers, writers
from gridfold.sources.readers import require_columns, require_rows

#: The box of the city, south, west, north, east.
BOX = (51.71, -1.33, 51.80, -1.17)


def area_density(elements: DataFrame, areas: DataFrame, tags: tuple[str, ...] = ("amenity",), box: tuple[float, float, float, float] = BOX, cell: float | None = None, label: Callable[[Column, Column], Column] = point_label) -> tuple[DataFrame, DataFrame]:
    """Placed points with name, kind and ``label`` (of name and kind), and areas with their number of points."""
    nodes = filters.tagged_nodes(elements, tags, *box)
    points = nodes.select(F.col("ord").alias("point_id"), "lon", "lat", tag(F.col("tags"), "name").alias("name"), tag(F.col("tags"), tags[0]).alias("amenity"))
    placed = spatial.points_in_areas(points, areas, cell).withColumn("label", label(F.col("name"), F.col("amenity")))
    return placed, density.metric_on_areas(areas, density.point_counts(placed))


#: Fixed value: the label of the counts of the area density.
COUNT_LABEL = "OSM amenity count (placeholder)"


def area_density_outputs(placed: DataFrame, counted: DataFrame, label: str = COUNT_LABEL, name: str = "LSOA21NM") -> dict[str, DataFrame]:
    """What the results of :func:`area_density` are written as.

    ``amenities`` and ``neighbourhoods`` are features with an ``ord``, the latter with the properties they came with, if
    any, and ``amenity_count``; ``metric`` has ``neighbourhood, value, value_label``, a row for each area in the order of areas.
    """
    text = F.col("area_name")
    points = placed.select(F.col("point_id").alias("ord"), feature("Point", F.array("lon", "lat"), name=F.col("name"), amenity=F.col("amenity"), lsoa=text).alias("feature"))
    held = F.col("properties") if "properties" in counted.columns else F.create_map(F.lit(name), text)
    properties = F.map_concat(F.map_filter(held, lambda k, _: k != "amenity_count"), F.create_map(F.lit("amenity_count"), F.col("value").cast("string")))
    # Rings of several polygons stay one list: even-odd containment does not tell them apart.
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    whole = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    counts = F.regexp_replace(whole, r'"amenity_count":"([0-9]+)"', r'"amenity_count":$1')
    shapes = counted.select(F.col("area_ord").alias("ord"), counts.alias("feature"))
    metric = counted.orderBy("area_ord").select(text.alias("neighbourhood"), "value", F.lit(label).alias("value_label"))
    return {"amenities": points, "neighbourhoods": shapes, "metric": metric}


def area_density_files(spark: SparkSession, elements: str, areas: str, out: str, tags: tuple[str, ...] = ("amenity",), box: tuple[float, float, float, float] = BOX, name: str = "LSOA21NM", prefix: str = "", lines: bool = False) -> dict[str, int]:
    """From a map response and area polygons to ``amenities``, ``neighbourhoods`` (features a line) and ``metric`` (CSV) under ``out``.

    Only areas whose name begins with ``prefix`` take part. Returns the number of rows written of each; names an earlier
    step's missing file in ``FileNotFoundError``.
    """
    shapes = readers.geojson(spark, areas, lines).where("rings is not null")
    named = shapes.select(F.col("ord").alias("area_ord"), F.coalesce(F.col("properties")[name], F.lit("")).alias("area_name"), "rings", "properties")
    kept = filters.areas_by_prefix(named, prefix) if prefix else named
    placed, counted = area_density(readers.map_elements(spark, elements, lines), kept, tags, box)
    made = area_density_outputs(placed, counted, name=name)
    return {
        "amenities": writers.write_geojson_lines(made["amenities"], f"{out}/amenities"),
        "neighbourhoods": writers.write_geojson_lines(made["neighbourhoods"].orderBy("ord"), f"{out}/neighbourhoods"),
        "metric": writers.write_csv(made["metric"], f"{out}/metric"),
    }


def build_lookup(elements: DataFrame, areas: DataFrame, box: tuple[float, float, float, float] = BOX, cell: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buildings, the postcode lookup sorted by postcode, and the ways rejected for their ring."""
    made, rejected = filters.buildings(filters.tagged_ways(elements, *box))
    return made, lookup.postcode_lookup(made, areas, cell=cell).orderBy("postcode"), rejected


def preaggregate_files(spark: SparkSession, register_path: str, out: str, label: str = "HMO count") -> int:
    """From a register file or folder to a metric CSV under ``out``; the number of neighbourhoods written."""
    return writers.write_csv(preaggregate(readers.register_csv(spark, register_path), label=label), out)


def register_to_classes(rows: DataFrame, buildings: DataFrame, postcodes: DataFrame, areas: DataFrame, n: int = 4, order: str = "ord") -> dict[str, DataFrame]:
    """All results of a register: matched rows, groups and their features, counts, funnel, classes and legend.

    Raises ``ValueError`` for a register without rows or without an address column. ``matched`` feeds all others; callers that write several of them should persist it.
    """
    matched = register.match_register(with_roles(require_rows(rows), order).withColumnRenamed(order, "ord"), buildings, postcodes)
    on_areas = density.metric_on_areas(areas, register.area_counts(matched))
    groups, others = register.building_groups(matched), register.fallback_groups(matched)
    features = {"building_features": register.building_features(groups, buildings)} if "ring" in buildings.columns else {}
    return features | {
        "matched": matched,
        "building_groups": groups,
        "fallback_groups": others,
        "fallback_features": register.fallback_features(others),
        "areas": density.choropleth_classes(on_areas, n),
        "legend": density.legend_ranges(density.quantile_breaks(on_areas, n)),
        "funnel": register.match_funnel(matched),
    }


def preaggregate(rows: DataFrame, order: str = "ord", label: str = "HMO count") -> DataFrame:
    """Register rows by normalised ``neighbourhood``, sorted by it; raises ``ValueError`` without that column."""
    return density.name_counts(require_columns(rows, "neighbourhood"), "neighbourhood", order, label)
