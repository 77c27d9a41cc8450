"""Quantiles, classes, legend, name counts; golden values of the two sample files as literals."""

import math
import random

import pytest

from gridfold.operators import density
from gridfold.plans import pipelines


def expected_breaks(values, n):
    ordered = sorted(v or 0 for v in values)
    return [ordered[math.floor((i / n) * len(ordered))] for i in range(1, n)] if ordered else []


@pytest.mark.parametrize("n", [2, 4, 7])
@pytest.mark.parametrize("size", [0, 1, 5, 84, 300])
def test_breaks(spark, n, size, monkeypatch):
    rng = random.Random(size)
    values = [rng.choice([None, rng.randrange(60)]) if rng.random() < 0.2 else rng.randrange(60) for _ in range(size)]
    rows = spark.createDataFrame([(v,) for v in values], "value long")
    for most in (100_000, 3):
        monkeypatch.setattr(density, "ONE_PARTITION_VALUES", most)
        got = [r["break_value"] for r in density.quantile_breaks(rows, n).orderBy("class_index").collect()]
        assert got == expected_breaks(values, n)


def test_breaks_of_outliers(spark, monkeypatch):
    """One value far from all others, infinite ones and ties, in both ways to sum."""
    values = [x / 7 for x in range(900)] * 2 + [1e300, -1e300, math.inf, -math.inf, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "value double")
    for most in (100_000, 3):
        monkeypatch.setattr(density, "ONE_PARTITION_VALUES", most)
        got = [r["break_value"] for r in density.quantile_breaks(rows, 7).orderBy("class_index").collect()]
        assert got == expected_breaks(values, 7)


def test_classes_and_legend(spark):
    rows = spark.createDataFrame([(f"a{i}", v) for i, v in enumerate([2, 3, 12, 13, 24, 30, 49, None])], "area_name string, value long")
    got = {r["area_name"]: r["class_index"] for r in density.choropleth_classes(rows).collect()}
    breaks = expected_breaks([2, 3, 12, 13, 24, 30, 49, None], 4)
    assert got == {f"a{i}": sum(b <= (v or 0) for b in breaks) for i, v in enumerate([2, 3, 12, 13, 24, 30, 49, None])}
    legend = density.legend_ranges(spark.createDataFrame([(1, 12), (2, 24), (3, 49)], "class_index int, break_value long")).orderBy("class_index").collect()
    assert [r["label"] for r in legend] == ["0–12", "12–24", "24–49", "49–+"]
    assert density.value_range(rows).first()[:] == (0, 49)


def test_preaggregation(spark):
    rows = spark.createDataFrame([(3, "Oxford 005A"), (1, " oxford 005a "), (2, "  "), (4, "!!!"), (5, None)], "ord long, neighbourhood string")
    got = [r[:] for r in pipelines.preaggregate(rows).collect()]
    assert got == [("!!!", 1, "HMO count"), ("oxford 005a", 2, "HMO count")]
    one = spark.createDataFrame([(1, "Oxford 005A")], "ord long, neighbourhood string")
    assert pipelines.preaggregate(one).first()[:] == ("Oxford 005A", 1, "HMO count")


def test_rank_and_metric(spark):
    counts = spark.createDataFrame([("a", 3, 9), ("b", 3, 2), ("c", 5, 7), ("ghost", 9, 1)], "area_name string, value long, first_ord long")
    assert [r["area_name"] for r in density.rank_areas(counts, 3).collect()] == ["ghost", "c", "b"]
    areas = spark.createDataFrame([("a",), ("z",)], "area_name string")
    assert {r["area_name"]: r["value"] for r in density.metric_on_areas(areas, counts).collect()} == {"a": 3, "z": 0}
