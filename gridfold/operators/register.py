"""Register matching: parse addresses, meet buildings and postcodes, consolidate, count, and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridfold.functions import text as T
from gridfold.functions.geometry import feature
from gridfold.operators.filters import not_blank, with_key
from gridfold.operators.lookup import keyed_buildings, keyed_postcodes

#: Rows whose ``ord`` agrees but for so many low bits are joined together first.
RUN_BITS = 16


def parse_register(register: DataFrame) -> DataFrame:
    """Address parts of every row with an address; ``register`` has ``ord`` and the role columns."""
    rows = not_blank(register, "address")
    rows = rows.withColumns({"sub_unit": T.sub_unit(F.col("address")), "core": T.core_address(F.col("address"))})
    rows = rows.withColumn("found", T.find_postcode(F.col("core"), F.col("address")))
    rows = rows.withColumns({"postcode": T.normalise_postcode(F.col("found")), "house_number": T.house_number(F.col("core")), "match_street": T.street_for_match(F.col("street"), F.col("core"), F.col("found"))})
    key = F.when(F.col("postcode") != "", T.match_key(F.col("house_number"), F.col("match_street"))).otherwise("")
    return rows.withColumn("match_key", key).drop("found")


def match_register(register: DataFrame, buildings: DataFrame, lookup: DataFrame, require_postcode: bool = False) -> DataFrame:
    """One row for each register row with an address, with its area, building and postcode centroid.

    ``buildings`` and ``lookup`` need not be unique: the first building of a key and the last row of a postcode
    count, by ``ord``. ``kind`` is building, fallback, unplaced or no_postcode. ``require_postcode`` lets a
    building match only rows of its own postcode.
    """
    return match_keyed(register, keyed_buildings(buildings), keyed_postcodes(lookup), require_postcode)


def match_keyed(register: DataFrame, keyed: DataFrame, places: DataFrame, require_postcode: bool = False) -> DataFrame:
    """:func:`match_register` with lookups that hold one row a key, such as the tables of ``staged_lookups``."""
    # Rows without a postcode or key meet nothing; a key of their own spreads them over all tasks of a join.
    apart = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.concat(F.lit("\0"), F.xxhash64("ord").cast("string")))
    rows = parse_register(register).withColumns({"postcode_met": apart("postcode"), "key_met": apart("match_key")})
    rows = rows.join(places.withColumnRenamed("postcode", "postcode_met").withColumn("pc_known", F.lit(True)), "postcode_met", "left")
    rows = rows.join(keyed.withColumnRenamed("match_key", "key_met"), "key_met", "left")
    met = F.col("building_ord").isNotNull()
    if require_postcode:
        met = met & F.coalesce(F.col("building_postcode") == F.col("postcode"), F.lit(False))
    kind = F.when(F.col("postcode") == "", "no_postcode").when(met, "building").when(F.coalesce("pc_known", F.lit(False)), "fallback").otherwise("unplaced")
    area = F.when(F.col("postcode") == "", F.lit("")).otherwise(F.coalesce("area", F.lit("")))
    return rows.select("ord", "id", "address", "licence_start", "licence_end", "sub_unit", "core", F.when(F.col("street") != "", F.col("street")).otherwise(F.col("match_street")).alias("street"), "postcode", "match_key", kind.alias("kind"), area.alias("lsoa"), "building_ord", "pc_lat", "pc_lon")


def _joined(column: str, order: str) -> Column:
    """The non-empty values of a column in order, joined by commas."""
    kept = F.collect_list(F.when(F.col(column) != "", F.struct(order, F.col(column).alias("v"))))
    return F.array_join(F.sort_array(kept)["v"], ", ")


def _fold(rows: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """One row for each key: properties of its first row, joined ids and sub-units, and the number of rows if several.

    Rows of a key are joined by runs of ``ord`` first, side by side; what is merged last is a row for each run.
    """
    whole = isinstance(rows.schema["ord"].dataType, IntegralType)
    run = F.shiftright(F.col("ord").cast("long"), RUN_BITS) if whole else F.lit(0)
    first = F.struct("ord", F.struct(F.col("core").alias("address"), "street", "postcode", "lsoa", "licence_start", "licence_end", *extra).alias("f"))
    runs = rows.groupBy(key, run.alias("run")).agg(F.min_by(first, F.col("ord")).alias("first"), _joined("id", "ord").alias("hmo_id"), _joined("sub_unit", "ord").alias("units"), F.count("*").alias("n"))
    folded = runs.groupBy(key).agg(F.min_by("first", "run").alias("first"), _joined("hmo_id", "run").alias("hmo_id"), _joined("units", "run").alias("units"), F.sum("n").alias("n"))
    units = F.when((F.col("n") > 1) | (F.col("units") != ""), F.col("units"))
    return folded.select(key, "first.f.*", "hmo_id", units.alias("sub_units"), F.when(F.col("n") > 1, F.col("n")).alias("entry_count"))


def building_groups(matched: DataFrame) -> DataFrame:
    """One row for each building that register rows meet; absent properties are null."""
    return _fold(matched.where("kind = 'building'"), "match_key", ["building_ord"])


def fallback_groups(matched: DataFrame) -> DataFrame:
    """One row for each group of unmatched rows, at the postcode centroid of its first row."""
    rows = matched.where("kind = 'fallback'").withColumn("group_key", F.when(F.col("match_key") != "", F.col("match_key")).otherwise(F.concat("postcode", F.lit("|"), "core")))
    return _fold(rows, "group_key", ["pc_lon", "pc_lat"])


def area_counts(matched: DataFrame) -> DataFrame:
    """Register rows for each area, whether or not they meet a building."""
    return matched.where("lsoa <> ''").groupBy(F.col("lsoa").alias("area_name")).agg(F.count("*").alias("value"))


def match_funnel(matched: DataFrame) -> DataFrame:
    """One row of counts: rows with an address, without postcode, without area; buildings, fallback groups, groups of several rows.

    All counts come from one pass over groups of the rows.
    """
    key = F.when(F.col("kind") == "building", F.col("match_key")).when(F.col("match_key") != "", F.col("match_key")).otherwise(F.concat("postcode", F.lit("|"), "core"))
    kind, placed = F.col("kind"), F.col("kind").isin("building", "fallback")
    groups = matched.groupBy("kind", F.when(placed, key).alias("group_key")).agg(F.count("*").alias("n"), F.count_if(F.col("lsoa") == "").alias("without"))
    total = lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
    return groups.agg(
        total("n", F.lit(True)).alias("total"), F.count_if(kind == "building").alias("matched"), F.count_if(kind == "fallback").alias("fallback"),
        total("n", kind == "no_postcode").alias("no_postcode"), total("without", kind != "no_postcode").alias("no_lsoa"), F.count_if(placed & (F.col("n") > 1)).alias("multi_household"),
    )


PROPERTIES = ("address", "street", "postcode", "lsoa", "hmo_id", "licence_start", "licence_end", "sub_units", "entry_count")


def building_features(groups: DataFrame, buildings: DataFrame) -> DataFrame:
    """``(match_key, feature)``: a GeoJSON polygon for each of :func:`building_groups`, absent properties left out."""
    rings = buildings.select(F.col("ord").alias("building_ord"), "ring")
    return groups.join(rings, "building_ord").select("match_key", feature("Polygon", F.array("ring"), **{p: F.col(p) for p in PROPERTIES}).alias("feature"))


def fallback_features(groups: DataFrame) -> DataFrame:
    """``(group_key, feature)``: a GeoJSON point at the postcode's centroid for each of :func:`fallback_groups`."""
    return groups.select("group_key", feature("Point", F.array("pc_lon", "pc_lat"), **{p: F.col(p) for p in PROPERTIES}).alias("feature"))
