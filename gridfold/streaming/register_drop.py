"""A watched folder of register files; each file that arrives replaces the results of the one before.

A set of results is written to a folder of its own under ``out``; a row added under ``out/switch`` then makes it
the latest in one step, so a reader of :func:`latest_results` never meets results of two registers. Older
folders stay until :func:`retire` removes them.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfold.functions.text import ROLES, present, register_roles
from gridfold.operators import density, register
from gridfold.sources.readers import CELL, CSV_GLOB

RESULTS = ("building_groups", "fallback_groups", "fallback_features", "areas", "legend", "funnel")
SWITCH = "version long, cause string, folder string"


def _path(spark: SparkSession, path: str):
    """A path and the file system it lies on."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _switches(spark: SparkSession, out: str) -> DataFrame:
    """The sets that were made the latest, one row each; an empty table where ``out`` is new."""
    path, files = _path(spark, f"{out}/switch")
    return spark.read.schema(SWITCH).option("recursiveFileLookup", True).parquet(f"{out}/switch") if files.exists(path) else spark.createDataFrame([], SWITCH)


def _claim(spark: SparkSession, out: str, version: int) -> int:
    """``version`` or the next one that nobody has claimed, by a file that the file system creates for one claimer only.

    Hadoop's local file system looks before it creates, so there the operating system creates the file. A publisher
    that dies after its claim leaves a gap in the versions, which harms nobody.
    """
    while True:
        path, files = _path(spark, f"{out}/claims/{version:012d}")
        try:
            if files.getScheme() == "file":
                files.mkdirs(path.getParent())
                open(path.toUri().getPath(), "x").close()
            else:
                files.create(path, False).close()
            return version
        except FileExistsError:
            version += 1
        except Py4JJavaError as refused:
            if not files.exists(path):
                raise refused
            version += 1


def publish(spark: SparkSession, out: str, results: dict[str, DataFrame], cause: str) -> None:
    """Write a set of results and make it the latest; what was published for the same ``cause`` isn't again.

    Of two publishers at the same moment each gets a version of its own, and the higher one is the latest.
    """
    known = _switches(spark, out)
    if not known.where(F.col("cause") == cause).isEmpty():
        return
    folder = f"{out}/set-{uuid.uuid4().hex}"
    for name, rows in results.items():
        rows.write.parquet(f"{folder}/{name}")
    last = _switches(spark, out).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    version = _claim(spark, out, last + 1)
    # A folder for each version: writers that share one remove each other's unfinished files.
    spark.createDataFrame([(version, cause, folder)], SWITCH).coalesce(1).write.parquet(f"{out}/switch/{version:012d}")


def retire(spark: SparkSession, out: str, keep: int = 2, grace_seconds: float = 3600.0) -> int:
    """Delete sets under ``out`` that are older than the grace period and not among the latest ``keep``; their number.

    A set that a dead publisher left unfinished goes, too; readers of a set have the grace period to finish.
    """
    rows = _switches(spark, out).orderBy(F.desc("version")).limit(keep).collect()  # ``keep`` rows
    held = {r["folder"].rsplit("/", 1)[-1] for r in rows}
    path, files = _path(spark, out)
    old = [s for s in files.listStatus(path) if s.getPath().getName().startswith("set-") and s.getPath().getName() not in held]
    gone = [s.getPath() for s in old if s.getModificationTime() <= (time.time() - grace_seconds) * 1000]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


def latest_results(spark: SparkSession, out: str, names: tuple[str, ...] = RESULTS) -> dict[str, DataFrame]:
    """The tables ``names`` of the latest set under ``out``; raises ``FileNotFoundError`` where there is none."""
    last = _switches(spark, out).orderBy(F.desc("version")).first()
    if last is None:
        raise FileNotFoundError(f"{out} has no results yet")
    return {n: spark.read.parquet(f"{last['folder']}/{n}") for n in names}


def results_of(matched: DataFrame, on_areas: DataFrame, n: int = 4, buildings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of ``RESULTS`` of matched register rows and of areas with their number, and ``building_features`` where ``buildings`` have rings."""
    groups, others = register.building_groups(matched), register.fallback_groups(matched)
    features = {"building_features": register.building_features(groups, buildings)} if buildings is not None and "ring" in buildings.columns else {}
    return features | {
        "building_groups": groups,
        "fallback_groups": others,
        "fallback_features": register.fallback_features(others),
        "areas": density.choropleth_classes(on_areas, n),
        "legend": density.legend_ranges(density.quantile_breaks(on_areas, n)),
        "funnel": register.match_funnel(matched),
    }


def clear_register(spark: SparkSession, out: str, areas: DataFrame, baseline: DataFrame, n: int = 4) -> None:
    """Make results without any register the latest: no groups, an empty funnel, and areas by the ``baseline`` metric."""
    last = latest_results(spark, out)
    restored = density.restored_metric(areas, baseline)
    results = {
        "building_groups": last["building_groups"].limit(0),
        "fallback_groups": last["fallback_groups"].limit(0),
        "fallback_features": last["fallback_features"].limit(0),
        "areas": density.choropleth_classes(restored, n),
        "legend": density.legend_ranges(density.quantile_breaks(restored, n)),
        "funnel": last["funnel"].select(*(F.lit(0).cast(t).alias(c) for c, t in last["funnel"].dtypes)),
    }
    publish(spark, out, results, f"clear {uuid.uuid4().hex}")


def file_rows(batch: DataFrame) -> DataFrame:
    """``ord`` and the role columns of a batch that is one file, whose first row holds the headers.

    Raises ``ValueError`` naming the file where no header is an address's. A file without rows gives none.
    """
    cells = [c for c in batch.columns if c != "file"]
    # Line breaks in quotes keep a file in one task, so ids rise in the order of its rows.
    placed = batch.withColumn("ord", F.monotonically_increasing_id())
    head = placed.orderBy("ord").first()
    names = [(head[c] or "").removeprefix("\ufeff") for c in cells]
    found = {r: cells[names.index(h)] for r, h in register_roles(names).items()}
    if "address" not in found:
        raise ValueError(f"{head['file']} has no address column; found: {', '.join(n for n in names if n)}")
    roles = [(present(F.col(found[r])) if r in found else F.lit("")).alias(r) for r in ROLES]
    return placed.where(F.col("ord") > head["ord"]).select("ord", *roles)


def watch_registers(spark: SparkSession, folder: str, buildings: DataFrame, postcodes: DataFrame, areas: DataFrame, out: str, checkpoint: str, n: int = 4, most_columns: int = 64) -> StreamingQuery:
    """Start a query that turns each new register into results under ``out``, and returns it.

    Every file has headers of its own, in any order; columns beyond ``most_columns`` are left aside, and quoted fields may
    hold line breaks. Files are taken one at a time in the order of their modification; one without rows
    changes nothing. A batch that runs twice is published once; only file names and offsets lie in ``checkpoint``.
    """
    cells = [CELL.format(i) for i in range(most_columns)]
    options = spark.readStream.schema(", ".join(f"`{c}` string" for c in cells)).option("quote", '"').option("escape", '"').option("multiLine", True)
    files = options.option("maxFilesPerTrigger", 1).option("pathGlobFilter", CSV_GLOB).csv(folder).select(*cells, F.col("_metadata.file_path").alias("file"))

    def replace(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        rows = None if held.isEmpty() else file_rows(held).persist()
        if rows is not None and not rows.isEmpty():
            matched = register.match_register(rows, buildings, postcodes).persist()
            on_areas = density.metric_on_areas(areas, register.area_counts(matched)).persist()
            publish(batch.sparkSession, out, results_of(matched, on_areas, n, buildings), f"{checkpoint} {number}")
            on_areas.unpersist()
            matched.unpersist()
        if rows is not None:
            rows.unpersist()
        held.unpersist()

    return files.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).start()
