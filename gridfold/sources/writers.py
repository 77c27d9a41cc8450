"""Writers: GeoJSON, CSV with CRLF, and staged responses as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and what observes the number of rows that pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_geojson_lines(features: DataFrame, path: str, column: str = "feature") -> int:
    """One feature a line, written by all tasks side by side; the number of features, counted in the same pass."""
    rows, seen = _counted(features.select(F.col(column).alias("value")))
    rows.write.mode("overwrite").text(path)
    return seen.get["rows"]


def feature_collection(features: DataFrame, order: str = "ord", column: str = "feature") -> DataFrame:
    """One row with a whole FeatureCollection, for results of a known small size such as areas."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("f")))), lambda x: x["f"])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("document"))


def write_feature_collection(features: DataFrame, path: str, order: str = "ord", column: str = "feature") -> int:
    """One FeatureCollection in the order of ``order`` (no two features share one), written by all tasks; the number of features.

    The files of the folder, one after the other by name, are the document: the first begins with the header and the last ends
    with the footer, and no row or task holds more than its own features.
    """
    lines = features.select(F.lit(1).alias("part"), F.col(order).alias("o"), F.col(column).alias("f"))
    first = lines.agg(F.min("o")).first()[0]
    comma = F.when(F.col("o") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    lines = lines.select("part", "o", F.concat(comma, F.col("f")).alias("value"))
    ends = [(0, '{"type":"FeatureCollection","features":['), (2, "]}")]
    frame = features.sparkSession.createDataFrame(ends, "part int, value string").select("part", F.lit(None).cast(lines.schema["o"].dataType).alias("o"), "value")
    # Counted behind the sort, whose sampling reads what lies before it twice.
    rows, seen = _counted(lines.union(frame).orderBy("part", "o").select("value"))
    rows.write.mode("overwrite").text(path)
    return seen.get["rows"] - len(ends)


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header and CRLF line ends; the order of ``df`` is kept. The number of rows, counted in the same pass."""
    rows, seen = _counted(df)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)
    return seen.get["rows"]


def stage(df: DataFrame, path: str, *tags: str) -> None:
    """Keep a response as Parquet, with the named tags as columns of their own so that filters reach the scan."""
    df.select("*", *(F.col("tags")[t].alias(f"tag_{t.replace(':', '_')}") for t in tags)).write.mode("overwrite").parquet(path)
