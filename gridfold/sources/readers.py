"""Readers for registers, map responses, GeoJSON, lookups and metrics.

Rows of CSV files and of JSON files with one value a line get ``ord``: a struct that sorts by file, block and
place within it. Whole JSON documents number their values by position, within ``file_path`` where several are read.
"""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.text import ROLES, normalise_postcode, register_roles

CSV_GLOB = "*.[cC][sS][vV]"
#: A number at the start of a field; what follows it is left aside.
NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
#: Names of the columns by place, while their meaning differs from file to file.
CELL = "_cell{}"
TAGS = "map<string,string>"
ELEMENT = f"id bigint, type string, lat double, lon double, tags {TAGS}, geometry array<struct<lat:double,lon:double>>"
FEATURE = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"


def _existing(read, path: str, step: str) -> DataFrame:
    """Run a reader; where the path is missing, name the earlier step that writes it."""
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} is missing; run the step that writes it first: {step}") from e
        raise


def row_order() -> Column:
    """Order of rows as they stand in files; valid on a DataFrame straight from a file reader."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``; raises ``ValueError`` with the columns found if one is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """``df``; raises ``ValueError`` if it has no rows."""
    if df.isEmpty():
        raise ValueError("the file is empty: it has no data rows")
    return df


def header_names(line: str, file: str) -> list[str]:
    """The names in a header line; raises ``ValueError`` naming the file where a quote stays open."""
    if line.count('"') % 2:
        raise ValueError(f"{file}: the header is longer than its line")
    return next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), [])


def file_headers(spark: SparkSession, path: str, step: str = "register download") -> DataFrame:
    """``(file, header)``: the first line that isn't blank of every ``.csv`` file of a folder, as it stands there.

    Lines, not records, are read, and only from each file's first block on; files without such a line have no row.
    """
    lines = _existing(spark.read.option("pathGlobFilter", CSV_GLOB).text, path, step)
    first = lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim(F.regexp_replace("value", "[\ufeff\r]", "")) != ""))
    placed = first.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    return placed.groupBy("file").agg(F.min_by("value", "place").alias("header"))


def _layouts(headers: DataFrame) -> dict[str, list[str]]:
    """Names by file, in the order of files: a line for each file, whose names the driver's listing holds anyway."""
    return {r["file"]: header_names(r["header"], r["file"]) for r in sorted(headers.collect(), key=lambda r: r["file"])}


def _by_name(spark: SparkSession, path: str, places: dict[str, list[int]], names: list[str], multi_line: bool) -> DataFrame:
    """Rows of all files with ``names`` as columns: ``places`` says for each file where they stand, -1 for nowhere."""
    width = max((p + 1 for own in places.values() for p in own), default=1)
    cells = [CELL.format(i) for i in range(width)]
    read = spark.read.schema(", ".join(f"`{c}` string" for c in cells)).option("header", True).option("quote", '"').option("escape", '"')
    rows = read.option("multiLine", multi_line).option("encoding", "UTF-8").option("pathGlobFilter", CSV_GLOB).csv(path)
    rows = rows.select(row_order().alias("ord"), F.col("_metadata.file_path").alias("file"), *cells)
    known = list(map(list, dict.fromkeys(map(tuple, places.values()))))
    if len(known) == 1:
        return rows.select("ord", *((F.coalesce(cells[p], F.lit("")) if p >= 0 else F.lit("")).alias(n) for n, p in zip(names, known[0], strict=True)))
    layout = spark.createDataFrame(list(places.items()), "file string, places array<int>")
    placed = rows.select("ord", "file", F.array(*cells).alias("cells")).join(F.broadcast(layout), "file")  # a row for each file
    value = lambda i: F.coalesce(F.when(F.col("places")[i] >= 0, F.get("cells", F.col("places")[i])), F.lit(""))
    return placed.select("ord", *(value(i).alias(n) for i, n in enumerate(names)))


def register_csv(spark: SparkSession, path: str, multi_line: bool = True, step: str = "register download") -> DataFrame:
    """A register with a header row, all columns strings, plus ``ord``; a folder's files may differ in their headers.

    A byte order mark is dropped, blank lines are skipped, missing fields are empty. In a folder only names
    that end in ``.csv`` are read, and columns are those of all files, by name, in the order of files; a file
    lacks what it has no column for. Of equal names in a file the first counts. ``multi_line`` allows line breaks
    in quotes and makes files unsplittable. Raises ``ValueError`` naming the file whose header spans lines.
    """
    layouts = _layouts(file_headers(spark, path, step))
    names = list(dict.fromkeys(n for own in layouts.values() for n in own))
    if not names:
        options = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", CSV_GLOB)
        return _existing(options.csv, path, step).select(row_order().alias("ord"), "*")
    places = {file: [own.index(n) if n in own else -1 for n in names] for file, own in layouts.items()}
    return _by_name(spark, path, places, names, multi_line)


def register_roles_csv(spark: SparkSession, path: str, multi_line: bool = True, step: str = "register download") -> DataFrame:
    """``ord`` and the role columns of all registers of a folder, the roles found file by file.

    Files may name and order their columns as they like. Raises ``ValueError`` naming a file without an address column.
    """
    places = {}
    for file, own in _layouts(file_headers(spark, path, step)).items():
        found = register_roles(own)
        if "address" not in found:
            raise ValueError(f"{file} has no address column; found: {', '.join(own)}")
        places[file] = [own.index(found[r]) if r in found else -1 for r in ROLES]
    return _by_name(spark, path, places, list(ROLES), multi_line)


def map_elements(spark: SparkSession, path: str, lines: bool = False, step: str = "map download") -> DataFrame:
    """``(file_path, ord, id, type, lat, lon, tags, geometry)`` of a map response.

    One document with ``elements`` by default; with ``lines`` one element a line, which splits at scale.
    """
    if lines:
        rows = _existing(spark.read.schema(ELEMENT).json, path, step)
        return rows.select(F.col("_metadata.file_path").alias("file_path"), row_order().alias("ord"), "*")
    rows = _existing(spark.read.schema(f"elements array<struct<{ELEMENT}>>").option("multiLine", True).json, path, step)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode("elements").alias("ord", "e")).select("file_path", "ord", "e.*")


def geojson(spark: SparkSession, path: str, lines: bool = False, step: str = "area download") -> DataFrame:
    """``(file_path, ord, kind, lon, lat, rings, properties)`` of GeoJSON features.

    ``rings`` holds all rings of a Polygon or MultiPolygon, ``lon`` and ``lat`` are set for a Point. With
    ``lines`` the input has one feature a line.
    """
    if lines:
        rows = _existing(spark.read.schema(FEATURE).json, path, step).select(F.col("_metadata.file_path").alias("file_path"), row_order().alias("ord"), F.struct("type", "geometry", "properties").alias("f"))
    else:
        rows = _existing(spark.read.schema(f"features array<struct<{FEATURE}>>").option("multiLine", True).json, path, step).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode("features").alias("ord", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    return rows.select("file_path", "ord", kind.alias("kind"), point[0].alias("lon"), point[1].alias("lat"), rings.alias("rings"), F.col("f.properties").alias("properties"))


def postcode_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, postcode, lsoa, centroid_lat, centroid_lon)``: keys normalised, blank ones dropped, numbers as far as they can be read from the left, else 0."""
    rows = require_columns(register_csv(spark, path, multi_line=False, step="postcode lookup"), "postcode", "lsoa", "centroid_lat", "centroid_lon")
    number = lambda c: F.coalesce(F.regexp_extract(c, NUMBER, 1).try_cast("double"), F.lit(0.0)).alias(c)
    return rows.select("ord", normalise_postcode(F.col("postcode")).alias("postcode"), "lsoa", number("centroid_lat"), number("centroid_lon")).where("postcode <> ''")


def area_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(neighbourhood, value, value_label)`` of any number per area, by name; a value that is no number is null."""
    rows = require_columns(register_csv(spark, path, multi_line=False, step="area metric"), "neighbourhood", "value")
    label = F.nullif("value_label", F.lit("")) if "value_label" in rows.columns else F.lit(None).cast("string")
    return rows.select("neighbourhood", F.expr("try_cast(value as double)").alias("value"), label.alias("value_label"))
