"""Equalisation and outlines of whole rasters against the versions by pixel; a stack's outlines against those of each label alone."""

import re

import numpy as np
from pyspark.sql import functions as F

from copse.operators import masks
from copse.plans import adapters, canopy, tiles, trees

SMALL = "/root/testdata/sf0.001"


def test_equalised_rasters(spark):
    px = adapters.pixels(spark, SMALL).select("plot_id", "row", "col", "z")
    want = {(x.plot_id, x.row, x.col): x.z for x in masks.equalised(px.withColumn("mask", F.col("z") > 3.5)).collect()}
    got = adapters.by_pixel(masks.equalised_rasters(adapters.rasters(spark, SMALL), 3.5))
    assert {(x.plot_id, x.row, x.col): x.z for x in got.collect()} == want
    odd = spark.createDataFrame([(1, []), (2, [None, 4.0, float("nan"), 5.0, 9.0]), (3, [1.0, 2.0])], "plot_id long, z array<double>")
    made = {x.plot_id: x.z for x in masks.equalised_rasters(odd, 3.5).collect()}
    assert made[1] == [] and made[3] == [1.0, 2.0]
    np.testing.assert_array_equal(made[2], masks.equalised_under(np.array([np.nan, 4.0, np.nan, 5.0, 9.0]), np.array([False, True, False, True, True])))


def test_pixels_are_not_dealt_again(spark):
    """Once made, pixels are neither sent to other tasks nor sorted by plot."""
    for made in (canopy.clahe(spark, SMALL), trees.crown_polygons(spark, SMALL)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("ArrowEvalPython")] and "FlatMapGroups" not in plan


def test_pixels_are_not_broadcast(spark):
    plan = tiles.clip_pixels(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan.split("\n")[1] and tiles.clip_pixels(spark, SMALL).count() > 0


def test_outlines_of_many_labels():
    r = np.random.default_rng(5)
    stack = r.integers(0, 3, (40, 11, 9))
    got = {}
    for k, own, rings in masks.outlines(stack):
        got.setdefault((k, own), []).append(rings)
    assert set(got) == {(k, own) for k in range(40) for own in (1, 2)}
    assert any(len(rings) > 1 for polygons in got.values() for rings in polygons)
    for (k, own), polygons in got.items():
        assert polygons == masks.outline(stack[k] == own)
    assert masks.outlines(np.zeros((2, 3, 3), int)) == []


def test_polygons_of_rasters(spark):
    at = (0.5, 0.0, 500000.0, 0.0, -0.5, 5300000.0)
    key = lambda df: sorted(tuple(x) for x in df.select("plot_id", "tree_id", "part", "wkt").collect())
    got = key(masks.raster_polygons(adapters.label_rasters(spark, SMALL), at))
    assert got == key(masks.crown_polygons(adapters.labels(spark, SMALL), at))
    assert all(re.fullmatch(r"POLYGON \((\((\d+\.\d+ \d+\.\d+(, )?)+\)(, )?)+\)", x[3]) for x in got)
    odd = spark.createDataFrame([(1, 2, [7, None, None, 7]), (2, 1, [3, 3]), (3, 2, []), (4, 2, [None, None])], "plot_id long, width long, tree_id array<long>")
    assert key(masks.raster_polygons(odd, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))) == [
        (1, 7, 0, "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 2.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))"), (2, 3, 0, "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 2.0, 0.0 2.0, 0.0 0.0))"),
    ]
