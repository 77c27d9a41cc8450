"""Counts by area, metrics on areas, quantile classes and legend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.functions.text import area_label, normalise_name, stripped
from gridfold.operators.filters import not_blank

#: Distinct values up to which the running sum of the quantiles takes one partition.
ONE_PARTITION_VALUES = 100_000
#: Buckets of many distinct values, near equal in their number.
VALUE_BUCKETS = 512


def point_counts(placed: DataFrame) -> DataFrame:
    """Points for each area, with the least ``point_id`` as ``first_ord``."""
    return placed.groupBy("area_name").agg(F.count("*").alias("value"), F.min("point_id").alias("first_ord"))


def rank_areas(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Areas by falling count, ties in the order first counted; the first ``k`` if given."""
    ranked = counts.orderBy(F.desc("value"), "first_ord")
    return ranked.limit(k) if k else ranked


def name_counts(rows: DataFrame, column: str, order: str, label: str = "HMO count") -> DataFrame:
    """Rows for each normalised name, sorted by it: first spelling, count and label. Blank names are left out."""
    raw = not_blank(rows, column).select(stripped(F.col(column)).alias("raw"), F.col(order).alias("o"))
    counted = raw.groupBy(normalise_name(F.col("raw")).alias("key")).agg(F.min_by("raw", F.struct("o", "raw")).alias("neighbourhood"), F.count("*").alias("value"))
    return counted.orderBy("key").select("neighbourhood", "value", F.lit(label).alias("value_label"))


def metric_on_areas(areas: DataFrame, metric: DataFrame, name: str = "area_name", value: str = "value") -> DataFrame:
    """``areas`` with the metric's value by name, 0 where it has none; values of unknown areas vanish."""
    return areas.join(metric.select(name, F.col(value).alias("value")), name, "left").withColumn("value", F.coalesce("value", F.lit(0)))


def labelled(areas: DataFrame) -> DataFrame:
    """``areas`` with ``label``, a stand-in where the name is missing."""
    return areas.withColumn("label", area_label(F.col("area_name")))


def quantile_breaks(values: DataFrame, n: int = 4, value: str = "value") -> DataFrame:
    """``(class_index, break_value)`` for 1 to n - 1: the value at place ``floor(i / n * count)`` of the ascending order.

    Null values count as 0; an empty table has no breaks. Only distinct values are ordered; of many they
    are dealt to buckets of near equal size by rank, whose running sums are carried over by the totals.
    """
    counts = values.groupBy(F.coalesce(F.col(value), F.lit(0)).alias("v")).agg(F.count("*").alias("c"))
    size = counts.agg(F.count("*").alias("d"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    if size["d"] <= ONE_PARTITION_VALUES:
        upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        # Borders at ranks of the distinct values, so that no outlier crowds a bucket; sums of buckets are carried over.
        borders = counts.agg(F.percentile_approx("v", [k / VALUE_BUCKETS for k in range(1, VALUE_BUCKETS)])).first()[0]
        reached = F.filter(F.array(*map(F.lit, sorted(set(borders)))), lambda b: b <= F.col("v"))
        bucketed = counts.withColumn("b", F.size(reached))
        earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = bucketed.groupBy("b").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
        inside = F.sum("c").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        upto = bucketed.withColumn("own", inside).join(F.broadcast(carried.select("b", "before")), "b").withColumn("upto", F.col("own") + F.col("before"))  # a row for each bucket
    picks = [F.min(F.when(F.col("upto") > int((i / n) * size["n"]), F.col("v"))).alias(f"b{i}") for i in range(1, n)]
    wide = upto.agg(*picks).select(F.explode(F.array(*(F.struct(F.lit(i).alias("class_index"), F.col(f"b{i}").alias("break_value")) for i in range(1, n)))).alias("x")) if n > 1 else upto.select(F.struct(F.lit(0).alias("class_index"), F.col("v").alias("break_value")).alias("x")).limit(0)
    return wide.select("x.*").where("break_value is not null")


def restored_metric(areas: DataFrame, baseline: DataFrame, name: str = "area_name", value: str = "value") -> DataFrame:
    """``areas`` with the baseline metric's value in place of another, as after a register is cleared."""
    return metric_on_areas(areas.drop("value", "class_index"), baseline, name, value)


def value_range(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: least and largest value, null as 0."""
    known = F.coalesce(F.col(value), F.lit(0))
    return values.agg(F.min(known).alias("min_value"), F.max(known).alias("max_value"))


def choropleth_classes(areas: DataFrame, n: int = 4, value: str = "value") -> DataFrame:
    """``areas`` with ``class_index`` 0 to n - 1: the number of inner breaks at or below the value.

    The size of the breaks, the breaks and the classes read ``areas`` in turn: callers stage what is dear to compute.
    """
    inner = quantile_breaks(areas, n, value).agg(F.array_sort(F.collect_list("break_value")).alias("_breaks"))  # n - 1 values
    placed = areas.withColumn("_k", F.lit(1)).join(F.broadcast(inner.withColumn("_k", F.lit(1))), "_k")
    known = F.coalesce(F.col(value), F.lit(0))
    return placed.withColumn("class_index", F.size(F.filter("_breaks", lambda b: b <= known))).drop("_k", "_breaks")


def legend_ranges(breaks: DataFrame) -> DataFrame:
    """``(class_index, lo, hi, label)``: the first range starts at 0, the last is open (``hi`` null)."""
    inner = breaks.agg(F.transform(F.array_sort(F.collect_list(F.struct("class_index", "break_value"))), lambda x: x["break_value"].cast("double")).alias("b"))
    ends = inner.select(F.concat(F.array(F.lit(0.0)), "b").alias("lo"), F.concat("b", F.array(F.lit(None).cast("double"))).alias("hi")).where(F.size("lo") > 1)
    rows = ends.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("class_index", "x")).select("class_index", "x.lo", "x.hi")
    plain = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    return rows.withColumn("label", F.concat(plain("lo"), F.lit("–"), F.coalesce(plain("hi"), F.lit("+"))))
