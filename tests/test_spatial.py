"""Containment, centroids and the grid join against a brute-force join."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridfold.functions import geometry as G
from gridfold.operators import filters, lookup, spatial
from gridfold.plans import queries, views

SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
HOLE = [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]
NOTCH = [[1.0, 1.0], [4.0, 1.0], [4.0, 4.0], [2.5, 2.0], [1.0, 4.0], [1.0, 1.0]]


def areas(spark):
    return spark.createDataFrame([(1, "holed", [SQUARE, HOLE]), (2, "notch", [NOTCH]), (3, "none", [])], "area_ord long, area_name string, rings array<array<array<double>>>")


def inside(rings, x, y):
    """By the even-odd rule and off all edges, in rational numbers."""
    x, y = Fraction(x), Fraction(y)
    rings = [[tuple(map(Fraction, p)) for p in r] for r in rings]
    edges = [(*a, *b) for r in rings for a, b in zip(r, r[1:], strict=False)]
    for x1, y1, x2, y2 in edges:
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


@pytest.mark.parametrize("cell", [None, 0.001, 0.3, 1.0, 7.0])
def test_grid_join_is_the_brute_force_join(spark, cell):
    rng = random.Random(4)
    pts = [(i, rng.randrange(-4, 20) / 4, rng.randrange(-4, 20) / 4) for i in range(400)]
    points = spark.createDataFrame([*pts, (900, None, 1.0), (901, math.nan, 1.0), (902, math.inf, 1.0)], "point_id long, lon double, lat double")
    expected = {i: name for i, x, y in pts for name in [next((n for n, r in (("holed", [SQUARE, HOLE]), ("notch", [NOTCH])) if inside(r, x, y)), None)] if name}
    got = spatial.points_in_areas(points.repartition(3), areas(spark), cell)
    assert {r["point_id"]: r["area_name"] for r in got.collect()} == expected
    left = {r["point_id"]: r["area_name"] for r in spatial.points_left_areas(points, areas(spark), cell).collect()}
    assert {k: v for k, v in left.items() if v} == expected and len(left) == 403


def test_large_areas_among_small_ones(spark):
    """Areas of sides from 0.01 to 300 with fine cells: each takes the cells of its own level."""
    rng = random.Random(7)
    made = []
    for i in range(40):
        x, y, side = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.01, 0.5, 3.0, 40.0, 300.0])
        made.append((i, f"a{i}", [[[x, y], [x + side, y], [x + side, y + side], [x + side / 2, y + side / 4], [x, y]]]))
    pts = [(i, rng.uniform(-8, 60), rng.uniform(-8, 60)) for i in range(200)] + [(200 + i, r[0][0][0] + 0.004, r[0][0][1] + 0.0015) for i, _, r in made]
    expected = {i: name for i, x, y in pts for name in [next((n for _, n, r in made if inside(r, x, y)), None)] if name}
    shapes = spark.createDataFrame(made, "area_ord long, area_name string, rings array<array<array<double>>>")
    points = spark.createDataFrame(pts, "point_id long, lon double, lat double")
    for cell in (None, 0.001, 0.5):
        got = spatial.points_in_areas(points, shapes, cell)
        assert {r["point_id"]: r["area_name"] for r in got.collect()} == expected


def star(n, seed, cx=0.0, cy=0.0):
    """A closed ring of n jagged edges around a centre."""
    rng = random.Random(seed)
    ring = [[cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)] for i in range(n) for r in [rng.uniform(2.0, 3.0)]]
    return [*ring, ring[0]]


def test_areas_of_many_edges_are_clipped_to_cells(spark):
    ring, hole = star(6000, 1), star(700, 2)
    hole = [[x / 4, y / 4] for x, y in hole]
    shapes = spark.createDataFrame([(1, "star", [ring, hole]), (2, "other", [star(40, 3, 2.0, 2.0)])], "area_ord long, area_name string, rings array<array<array<double>>>")
    rng = random.Random(5)
    pts = [(rng.uniform(-3.2, 3.2), rng.uniform(-3.2, 3.2)) for _ in range(500)] + [tuple(rng.choice(ring)) for _ in range(30)]
    pts += [(ring[i][0], rng.uniform(-3, 3)) for i in range(0, 600, 20)] + [(rng.uniform(-3, 3), ring[i][1]) for i in range(0, 600, 20)]
    numbered = [(i, x, y) for i, (x, y) in enumerate(pts)]
    kinds = [("star", [ring, hole]), ("other", [star(40, 3, 2.0, 2.0)])]
    expected = {i: name for i, x, y in numbered for name in [next((n for n, r in kinds if inside(r, x, y)), None)] if name}
    points = spark.createDataFrame(numbered, "point_id long, lon double, lat double")
    for cell in (None, 0.5):
        got = spatial.points_in_areas(points, shapes, cell)
        assert {r["point_id"]: r["area_name"] for r in got.collect()} == expected
    held = spatial.covering(spatial.levelled(spatial.area_edges(shapes), 5.0)).select(F.explode("shapes").alias("s")).where("s.area_ord = 1")
    most, every, turns = held.agg(F.max(F.size("s.edges")), F.sum(F.size("s.edges")), F.sum(F.size("s.turns"))).first()
    assert most < 150 and every < 6700 * 20 and turns < 6700 * 20  # an edge here spans a dozen cells; not 6,700 edges in each of 9,000 cells


def test_crowded_cells_are_salted(spark):
    rng = random.Random(6)
    pts = [(i, rng.uniform(0.0, 1.0), rng.uniform(0.0, 1.0)) for i in range(4000)] + [(4000 + i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(200)]
    points = spark.createDataFrame(pts, "point_id long, lon double, lat double")
    plain = {tuple(r) for r in spatial.points_in_areas(points, areas(spark), 2.0).collect()}
    salted = spatial.points_in_areas(points, areas(spark), 2.0, broadcast_parts=0)
    assert {tuple(r) for r in salted.collect()} == plain and plain
    left, right = spatial._salted(points.withColumns({"_cx": F.floor("lon"), "_cy": F.floor("lat")}), spark.createDataFrame([(0, 0), (3, 3)], "_cx long, _cy long"), "point_id")
    shares = [r["count"] for r in left.where("_cx = 0 and _cy = 0").groupBy("_salt").count().collect()]
    assert len(shares) == spatial.SALTS and max(shares) < 3 * 4000 / spatial.SALTS
    assert {(r["_cx"], r["count"]) for r in right.groupBy("_cx").count().collect()} == {(0, spatial.SALTS), (3, 1)}


def test_exact_at_the_border(spark):
    """Points one unit in the last place around edges, against rational arithmetic."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        scale = 10.0 ** rng.randint(-3, 3)
        x1, y1, x2, y2 = (rng.uniform(-1, 1) * scale for _ in range(4))
        t = rng.choice([0.0, 1.0, 0.5, rng.random()])
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        for _ in range(rng.randint(0, 2)):
            x = math.nextafter(x, rng.choice([-1e9, 1e9]))
        rows.append((i, x1, y1, x2, y2, x, y))
    def sign(r):
        x1, y1, x2, y2, x, y = map(Fraction, r[1:])
        d = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        return (d > 0) - (d < 0)
    df = spark.createDataFrame(rows, "i long, x1 double, y1 double, x2 double, y2 double, x double, y double")
    got = df.select("i", G.side_of({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.col("x"), F.col("y")).alias("s"))
    assert {r["i"]: r["s"] for r in got.collect()} == {r[0]: sign(r) for r in rows}
    triangle = [[0.1, 0.1], [0.7, 0.3], [0.2, 0.9], [0.1, 0.1]]
    pts = []
    for (ax, ay), (bx, by) in zip(triangle, triangle[1:], strict=False):
        for k in range(60):
            x, y = ax + (bx - ax) * k / 59, ay + (by - ay) * k / 59
            pts += [(x, y), (math.nextafter(x, 9), y), (math.nextafter(x, -9), y), (x, math.nextafter(y, 9))]
    shape = spark.createDataFrame([(1, "t", [triangle])], "area_ord long, area_name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point_id long, lon double, lat double")
    found = {r["point_id"] for r in spatial.points_in_areas(points, shape, 0.05).collect()}
    assert found == {i for i, (x, y) in enumerate(pts) if inside([triangle], x, y)}


def test_rounding_of_the_binary_value(spark):
    """Near ties at the sixth decimal, one unit in the last place around them, and large and small values."""
    rng = random.Random(9)
    values = [0.0, -1e-7, 2.5e-6, 0.5e-6, 1.5e-6, 1e15, -3e10, 5e-324, 1234567.1234565]
    for _ in range(33_000):
        tie = (rng.randint(-180_000_000, 180_000_000) + 0.5) / 1e6
        values += [tie, math.nextafter(tie, 1e9), math.nextafter(tie, -1e9)]
    values += [(k + 0.5) / 2**20 for k in range(1000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 9) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(4)
    got = {r["i"]: r["r"] for r in df.select("i", G.rounded(F.col("v")).alias("r")).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if math.copysign(1, got[i]) != math.copysign(1, round(v, 6)) or got[i] != round(v, 6)]
    assert not wrong and len(got) > 100_000


def test_no_areas(spark):
    none = areas(spark).where("area_ord = 3")
    assert spatial.points_in_areas(spark.createDataFrame([(1, 1.0, 1.0)], "point_id long, lon double, lat double"), none).count() == 0


def test_ring_and_centroid(spark):
    ways = spark.createDataFrame([(1, "way", {"building": "yes", "addr:housenumber": "1", "addr:street": "A St."}, [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0)]), (2, "way", {}, [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)])], "ord long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    good, bad = filters.buildings(ways)
    row = good.first()
    assert (row["centroid_lon"], row["centroid_lat"], row["match_key"], len(row["ring"])) == (1.0, 1.0, "1 a st", 4)
    assert [r["ord"] for r in bad.collect()] == [2]
    flat = spark.createDataFrame([([[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]],)], "ring array<array<double>>")
    assert flat.select(G.centroid(F.col("ring"))).first()[0][:] == (1.0, 0.0)


def test_box(spark):
    edged = spatial.area_edges(areas(spark))
    hit = lambda *box: sorted(r["area_name"] for r in filters.areas_in_box(edged, *box).collect())
    assert hit(0.7, 0.7, 0.8, 0.8) == []  # within the hole
    assert hit(0.1, 0.1, 0.2, 0.2) == ["holed"]  # within the area
    assert hit(-1, 0.9, 9, 1.1) == ["holed", "notch"]  # edges cross
    assert hit(2.4, 3.0, 2.6, 3.5) == []  # in the notch


def test_first_building_of_a_postcode_counts(spark):
    made = spark.createDataFrame([(2, "P", 9.0, 9.0), (1, "P", 3.5, 1.5), (3, " ", 3.5, 1.5), (4, "Q", 1.0, 1.0)], "ord long, addr_postcode string, centroid_lon double, centroid_lat double")
    got = {r["postcode"]: r["lsoa"] for r in lookup.postcode_lookup(made.repartition(2), areas(spark)).collect()}
    assert got == {"P": "notch", "Q": ""}
    assert lookup.lookup_coverage(lookup.postcode_lookup(made, areas(spark))).first()[:] == (1, 1)


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([(1, "k", "ox1  1aa", "a"), (2, "k", "OX1 1AA", "b"), (3, "", "", "c")], "ord long, match_key string, postcode string, lsoa string")
    assert [(r["match_key"], r["ord"]) for r in lookup.building_index(rows).collect()] == [("k", 1)]
    assert [(r["postcode"], r["lsoa"]) for r in lookup.postcode_index(rows).collect()] == [("OX1 1AA", "b")]


def test_rings_are_made_by_many_tasks_of_one_row_group(spark):
    rows = views.ways(spark, "/root/testdata/sf0.001")
    assert views.read(spark, "/root/testdata/sf0.001", "part").rdd.getNumPartitions() == 1
    assert rows.rdd.getNumPartitions() > 1


def test_ways_are_told_as_buildings_without_their_rings(spark):
    three, near = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 0.0000001
    shapes = [three, [*three[:2], (near, 0.0)], [*three[:2], (0.000001, 0.0)], three[:2], [*three, three[0]], [three[0]] * 4, [(None, 0.0), (1.0, 0.0), (None, 0.0)], [(None, 0.0), (1.0, 0.0), (1.0, 1.0)], None]
    ways = spark.createDataFrame([(i, {"building": "yes"}, s) for i, s in enumerate(shapes)], "ord long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    sized = ways.select("ord", F.size(G.way_ring(F.col("geometry"))).alias("n"), G.ring_of_four(F.col("geometry")).alias("told")).collect()
    assert {r["ord"]: r["told"] for r in sized} == {r["ord"]: None if r["n"] is None else r["n"] >= 4 for r in sized}
    good, rejected = filters.buildings(ways)
    assert sorted(r["ord"] for r in good.collect()) == [0, 2, 4, 5, 7]
    assert sorted(r["ord"] for r in rejected.collect()) == [1, 3, 6]
    filtered = good._jdf.queryExecution().optimizedPlan().toString().split("Filter")[-1]
    assert "transform(geometry" not in filtered


def test_centroid_of_odd_rings_and_of_many_corners(spark):
    def plain(ring):
        (x0, y0), a, x, y, n, lx, ly = ring[0], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            ax, ay, bx, by = x1 - x0, y1 - y0, x2 - x0, y2 - y0
            cross, length = ax * by - bx * ay, math.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
            a, x, y, n, lx, ly = a + cross, x + (ax + bx) * cross, y + (ay + by) * cross, n + length, lx + (ax + bx) / 2 * length, ly + (ay + by) / 2 * length
        dx, dy = (x / (3 * a), y / (3 * a)) if a else (lx / n, ly / n) if n else (0.0, 0.0)
        return round(x0 + dx, 6), round(y0 + dy, 6)

    circle = [(10 + math.cos(t / 50 * math.pi), 50 + math.sin(t / 50 * math.pi)) for t in range(100)]
    rings = [[(0.1, 0.2), (0.7, 0.2), (0.7, 0.9), (0.1, 0.2)], [(0.0, 0.0), (2.0, 1.0), (6.0, 3.0), (0.0, 0.0)], [(1.5, 2.5)] * 4, [(1.5, 2.5)], [*circle, circle[0]]]
    df = spark.createDataFrame([(i, [list(p) for p in r]) for i, r in enumerate(rings)] + [(9, None)], "i int, ring array<array<double>>")
    found = {r["i"]: r["c"] for r in df.select("i", G.centroid(F.col("ring")).alias("c")).collect()}
    assert found.pop(9) is None
    assert {i: tuple(c) for i, c in found.items()} == {i: plain(r) for i, r in enumerate(rings)}


def test_postcode_index_is_computed_by_many_tasks(spark):
    plan = queries.postcode_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # What the file's one task does is to read; rings and centroids come after the rows are dealt.
    assert "REPARTITION_BY_NUM" in plan
    assert plan.index("aggregate(") < plan.index("REPARTITION_BY_NUM")
