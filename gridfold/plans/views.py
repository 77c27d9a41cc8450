"""Area, point, building and register views over the star-schema tables, in SQL that both engines run.

Areas are a lattice of concave pentagons, one for each nation; points come from events, buildings from parts,
register rows from orders. Names in braces stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA_BASE = """select n_nationkey as area_ord, n_name as area_name,
  cast(n_nationkey % 5 as double) as x0, cast(floor(n_nationkey / 5) as double) as y0 from {nation}"""
POINT = """select event_id as point_id, cast(event_id * 7919 % 6000 as double) / 1000 as lon,
  cast(event_id * 104729 % 6000 as double) / 1000 as lat,
  case when event_id % 3 = 0 then '' else concat('place ', cast(event_id as string)) end as name,
  event_type as amenity from {events}"""
BUILDING = """select p_partkey as bid,
  concat(cast(p_partkey % 50 + 1 as string), case when p_partkey % 11 = 0 then 'a' else '' end) as hn,
  concat('St. ', p_name, ' Road') as street,
  case when p_partkey % 13 = 0 then '' else concat('OX', cast(p_partkey % 5 + 1 as string), ' ',
    cast(p_partkey % 9 + 1 as string), chr(cast(65 + p_partkey % 20 as int)), chr(cast(65 + p_partkey % 7 as int))) end as pc,
  cast(p_partkey * 7919 % 6000 as double) / 1000 as lon, cast(p_partkey * 104729 % 6000 as double) / 1000 as lat
from {part}"""
REGISTER = """select o_orderkey as ord, concat('REG-', cast(o_orderkey as string)) as id, concat(
    case o_orderkey % 6 when 0 then 'Flat B, ' when 1 then 'room 3 , ' when 2 then 'Ground Floor, '
      when 3 then 'First Floor Flat, ' else '' end,
    cast(o_orderkey % 50 + 1 as string), case when o_orderkey % 11 = 0 then 'a' else '' end,
    ' St ', coalesce(p_name, 'ghost'), ' road, Oxford',
    case when o_orderkey % 17 = 0 then '' else concat(', ox', cast(o_orderkey % 5 + 1 as string),
      case o_orderkey % 4 when 0 then '  ' when 1 then '' else ' ' end, cast(o_orderkey % 9 + 1 as string),
      chr(cast(65 + o_orderkey % 20 as int)), chr(cast(65 + o_orderkey % 7 as int))) end) as address,
  cast(o_custkey as string) as licence_start, o_orderstatus as licence_end
from {orders} left join {part} on p_partkey = o_orderkey % 2600"""
NAMES = """select p_partkey as ord, case when p_partkey % 50 = 0 then '  ' when p_partkey % 3 = 0 then upper(p_name)
  when p_partkey % 3 = 1 then concat(' ', p_name, '! ') else p_name end as neighbourhood from {part}"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view over the tables that its text names."""
    names = [n for n in ("nation", "events", "part", "orders") if "{" + n + "}" in text]
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows spread over all tasks by a key.

    A file is read by as many tasks as it has row groups, of up to a million such rows, and rings and addresses take far longer than reading does.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(area_ord, area_name, rings)``."""
    base = view(spark, sf_dir, AREA_BASE)
    at = lambda dx, dy: F.array(F.col("x0") + dx, F.col("y0") + dy)
    ring = F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0), at(0.5, 0.25), at(0.0, 1.0), at(0.0, 0.0))
    return base.select("area_ord", "area_name", F.array(ring).alias("rings"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINT)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as map nodes; one in four has no ``amenity`` tag."""
    kept = points(spark, sf_dir)
    tags = F.when(F.col("point_id") % 4 == 0, F.create_map(F.lit("shop"), F.col("amenity"))).otherwise(F.create_map(F.lit("name"), F.col("name"), F.lit("amenity"), F.col("amenity")))
    return kept.select(F.col("point_id").alias("ord"), F.col("point_id").alias("id"), F.lit("node").alias("type"), "lat", "lon", tags.alias("tags"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as map ways: squares of side 0.004; some relations, some of two nodes, some without a street."""
    base = spark.sql(BUILDING, part=dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"))
    at = lambda dx, dy: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    square = F.array(at(-0.002, -0.002), at(0.002, -0.002), at(0.002, 0.002), at(-0.002, 0.002))
    geometry = F.when(F.col("bid") % 19 == 0, F.slice(square, 1, 2)).otherwise(square)
    full = F.create_map(F.lit("building"), F.lit("yes"), F.lit("addr:housenumber"), F.col("hn"), F.lit("addr:street"), F.col("street"), F.lit("addr:postcode"), F.col("pc"))
    tags = F.when(F.col("bid") % 23 == 0, F.create_map(F.lit("building"), F.lit("yes"), F.lit("addr:housenumber"), F.col("hn"))).otherwise(full)
    kind = F.when(F.col("bid") % 29 == 0, "relation").otherwise("way")
    return base.select(F.col("bid").alias("ord"), F.col("bid").alias("id"), kind.alias("type"), tags.alias("tags"), geometry.alias("geometry"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(view(spark, sf_dir, REGISTER), "ord").withColumn("street", F.lit(""))
