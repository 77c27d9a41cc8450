"""Point-in-area joins over a grid of cells to which areas are clipped.

An area's edges are dealt to the cells they pass through, so a border cell holds only its own edges; for all
edges to the right of it, it holds whether their number is odd, and the heights at which that changes. Cells
inside an area hold no edges. A point meets its own cell alone and tests what lies in it, with the same outcome,
bit for bit, as if it tested all edges of the area.

Cells double in side from level to level. An area goes to the finest level at which it covers few of them; one of
very many edges to a finer one, where a cell holds few edges. Each level in use is one join. Containment is strict: a point on
a border lies in no area. Of several areas the first in ``area_ord`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.geometry import envelope, inside_given, rings_edges

#: Cells that an area may be long or wide at its level; with many edges, one for each so many of them, up to the finest.
MOST_SIDES, EDGES_A_SIDE, FINEST_SIDES = 32, 64, 1024
#: Cells and their edges together up to which they are broadcast, so that points need no shuffle.
BROADCAST_PARTS = 200_000
#: Tasks that a crowded cell's points are dealt to; a cell is crowded from one point in so many on.
SALTS, CROWDED = 64, 1000
#: A row of cells that no area reaches.
NOWHERE = -(2**62)
#: Widening of a strip against rounding, as a part of a cell's side.
MARGIN = 1e-9


def area_edges(areas: DataFrame) -> DataFrame:
    """``areas`` (``area_ord``, ``area_name``, ``rings``) with ``edges`` and ``box``; areas without edges go."""
    return areas.withColumn("edges", rings_edges(F.col("rings"))).where(F.size("edges") > 0).withColumn("box", envelope(F.col("edges")))


def mean_side(areas: DataFrame) -> float:
    """The mean side of the envelopes, as a cell size; 1 where there is none."""
    side = areas.agg(F.avg((F.col("box.maxx") - F.col("box.minx") + F.col("box.maxy") - F.col("box.miny")) / 2)).first()[0]
    return float(side) if side else 1.0


def levelled(areas: DataFrame, size: float) -> DataFrame:
    """``areas`` of :func:`area_edges` with their ``level`` and the ``side`` of its cells."""
    long = F.greatest(F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny"))
    coarse = F.greatest(F.lit(0), F.ceil(F.log2(long / (size * MOST_SIDES))))
    sides = F.least(F.size("edges") / EDGES_A_SIDE, F.lit(FINEST_SIDES))
    fine = F.when((sides > MOST_SIDES) & (long > 0), F.floor(F.log2(long / (size * sides))))
    level = F.coalesce(F.least(coarse, fine), F.lit(0)).cast("int")
    return areas.withColumn("level", level).withColumn("side", F.lit(size) * F.pow(F.lit(2.0), F.col("level")))


def _strips(areas: DataFrame) -> DataFrame:
    """A row for each edge and row of cells ``cy`` it passes: the columns ``low`` to ``high`` it can pass there, and its ends' rows."""
    shape = ["area_ord", "area_name", "level", "side"]
    rows = areas.select(*shape, F.explode("edges").alias("e")).select(*shape, "e", *(F.col(f"e.{c}") for c in ("x1", "y1", "x2", "y2")))
    row = lambda c: F.floor(c / F.col("side"))
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rows.withColumns({"r1": row(F.col("y1")), "r2": row(F.col("y2"))}).withColumn("cy", F.explode(F.sequence(row(bottom), row(top))))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def passed(y: Column) -> Column:
        """Where the edge passes a height, kept between its ends."""
        at = F.col("x1") + slope * (F.greatest(bottom, F.least(top, y)) - F.col("y1"))
        return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), at))

    under, over = passed((F.col("cy") - MARGIN) * F.col("side")), passed((F.col("cy") + (1 + MARGIN)) * F.col("side"))
    slack = (F.abs("x1") + F.abs("x2")) * 1e-12 + F.col("side") * MARGIN
    whole = (F.col("r1") == F.col("r2")) | under.isNull()
    low = F.when(whole, F.least("x1", "x2")).otherwise(F.least(under, over) - slack)
    high = F.when(whole, F.greatest("x1", "x2")).otherwise(F.greatest(under, over) + slack)
    return rows.select(*shape, "e", "y1", "y2", "r1", "r2", "cy", row(low).alias("low"), row(high).alias("high"))


def _odd_columns(places: Column) -> Column:
    """Columns of cells with an odd number of ``places`` to their right."""
    ordered = F.array_sort(places)
    spans = F.transform(F.sequence(F.lit(0), F.size(ordered) - 2, F.lit(2)), lambda i: F.when(F.get(ordered, i) < F.get(ordered, i + 1), F.sequence(F.get(ordered, i), F.get(ordered, i + 1) - 1)))
    return F.when(F.size(ordered) >= 2, F.flatten(F.filter(spans, lambda x: x.isNotNull())))


def covering(areas: DataFrame) -> DataFrame:
    """``(level, cx, cy, shapes)``: every cell that an area of :func:`levelled` covers or passes through.

    A shape has ``area_ord``, ``area_name``, the ``edges`` in the cell, ``odd`` (of edges to the right that pass the cell's row
    from end to end) and ``turns``: heights above which that number changes. A vertex turns it only
    where one of its two edges is to the right and the other isn't, so turns are as few as border cells.
    """
    strips, area = _strips(areas), ["area_ord", "area_name", "level"]
    border = strips.select(*area, F.explode(F.sequence("low", "high")).alias("cx"), "cy", "e", F.lit(None).cast("double").alias("turn"), F.lit(0).alias("odd"))
    ends = strips.select(*area, "cy", "low", F.explode(F.array(F.struct(F.col("y1").alias("y"), F.col("r1").alias("r")), F.struct(F.col("y2").alias("y"), F.col("r2").alias("r")))).alias("v"))
    turns = ends.where("v.r = cy").groupBy(*area, "cy", F.col("v.y").alias("turn")).agg(F.collect_list("low").alias("places"))
    nothing = F.lit(None).cast(areas.schema["edges"].dataType.elementType).alias("e")
    turns = turns.select(*area, F.explode(_odd_columns(F.col("places"))).alias("cx"), "cy", nothing, "turn", F.lit(0).alias("odd"))
    through = strips.where((F.col("r1") > F.col("cy")) != (F.col("r2") > F.col("cy"))).groupBy(*area, "cy").agg(F.collect_list("low").alias("places"))
    inner = through.select(*area, F.explode(_odd_columns(F.col("places"))).alias("cx"), "cy", nothing, F.lit(None).cast("double").alias("turn"), F.lit(1).alias("odd"))
    cells = border.union(turns).union(inner).groupBy(*area, "cx", "cy").agg(F.collect_list("e").alias("edges"), F.collect_list("turn").alias("turns"), (F.max("odd") == 1).alias("odd"))
    return cells.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct("area_ord", "area_name", "edges", "turns", "odd")).alias("shapes"))


def _found(x: Column, y: Column) -> Column:
    """The first of a cell's shapes that holds a point, as ``(area_ord, area_name)``; null for none."""

    def holds(s: Column) -> Column:
        above = F.size(F.filter(s["turns"], lambda t: t > y)) % 2 == 1
        return inside_given(s["edges"], x, y, s["odd"] != above)

    return F.array_min(F.transform(F.filter("shapes", holds), lambda s: F.struct(s["area_ord"].alias("area_ord"), s["area_name"].alias("area_name"))))


def _salted(dealt: DataFrame, cells: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``, by which a crowded cell's points spread over tasks that each get a copy of the cell."""
    crowded = dealt.groupBy("_cx", "_cy").count().where(F.col("count") * CROWDED > dealt.count())
    crowded = F.broadcast(crowded.select("_cx", "_cy", F.lit(SALTS).alias("_salts")))  # at most CROWDED rows
    salts = F.coalesce("_salts", F.lit(1))
    left = dealt.join(crowded, ["_cx", "_cy"], "left").withColumn("_salt", F.pmod(F.hash(by), salts)).drop("_salts")
    right = cells.join(crowded, ["_cx", "_cy"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left, right


def points_in_areas(points: DataFrame, areas: DataFrame, cell: float | None = None, point_id: str = "point_id", broadcast_parts: int = BROADCAST_PARTS) -> DataFrame:
    """``points`` in an area with its ``area_ord`` and ``area_name``, one row for each point.

    ``points`` have a ``point_id``, ``lon`` and ``lat``; points without finite coordinates match nothing. Rings are closed.
    ``cell`` is the side of the finest cells of ordinary areas, the mean side of the areas if not given. Cells and edges
    of up to ``broadcast_parts`` together are broadcast; beyond it points and cells meet by shuffle, crowded cells salted.
    """
    placed = _first_areas(points, areas, cell, point_id, broadcast_parts, every=False).where("_first is not null")
    return placed.select(*points.columns, "_first.area_ord", "_first.area_name")


def _first_areas(points: DataFrame, areas: DataFrame, cell: float | None, point_id: str, broadcast_parts: int, every: bool) -> DataFrame:
    """``points`` with ``_first``, the first area that holds them; points in none are kept, with null, where ``every`` is set."""
    areas = area_edges(areas)
    size = float(cell) if cell else mean_side(areas)
    areas = levelled(areas, size)
    across = lambda a, b: (F.col(f"box.{b}") - F.col(f"box.{a}")) / F.col("side") + 2
    parts = F.sum(across("minx", "maxx") * across("miny", "maxy") + F.size("edges"))
    told = areas.agg(F.collect_set("level").alias("levels"), F.coalesce(parts, F.lit(0)).alias("parts")).first()
    cells, x, y = covering(areas), F.col("lon"), F.col("lat")
    levels = sorted(told["levels"]) or [0]  # one for each doubling of the side, so a few at most
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    placed = finite(x) & finite(y)
    rows = points if every else points.where(placed)
    for level in levels:
        at = lambda c, level=level: F.floor(c / (size * 2.0**level))
        own = cells.where(F.col("level") == level).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "shapes")
        # Points without a place meet no cell; a key of their own spreads them over all tasks.
        ways = {"_cx": F.when(placed, at(x)).otherwise(F.xxhash64(point_id)), "_cy": F.when(placed, at(y)).otherwise(F.lit(NOWHERE))}
        dealt, keys = rows.withColumns(ways if every else {"_cx": at(x), "_cy": at(y)}), ["_cx", "_cy"]
        if told["parts"] <= broadcast_parts:
            own = F.broadcast(own)
        else:
            dealt, own = _salted(dealt, own, point_id)
            keys.append("_salt")
        met = dealt.join(own, keys, "inner" if len(levels) == 1 and not every else "left")
        rows = met.withColumn(f"_found{level}", _found(x, y)).drop(*keys, "shapes")
    found = [F.col(f"_found{level}") for level in levels]
    return rows.withColumn("_first", F.least(*found) if len(found) > 1 else found[0])


def points_left_areas(points: DataFrame, areas: DataFrame, cell: float | None = None, point_id: str = "point_id") -> DataFrame:
    """All ``points``, with the ``area_name`` of the first area that holds them, or the empty string."""
    placed = _first_areas(points, areas, cell, point_id, BROADCAST_PARTS, every=True)
    return placed.select(*points.columns, F.coalesce("_first.area_name", F.lit("")).alias("area_name"))
