"""Blobness of whole rasters against the version by pixel, without pixels sent between tasks."""

from pyspark.sql import functions as F

from copse.operators import trees as op
from copse.plans import adapters, trees

SMALL = "/root/testdata/sf0.001"


def test_blobs_are_made_where_the_raster_is(spark):
    plan = trees.hessian_blobness(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ArrowEvalPython")] and "FlatMapGroups" not in plan and "ArrowEvalPython" not in plan[plan.index("Exchange") :]


def test_raster_blobs(spark):
    by = lambda df: {(x.plot_id, x.row, x.col): x.blob for x in df.select("plot_id", "row", "col", "blob").collect()}
    want = by(op.blobs(adapters.pixels(spark, SMALL).select("plot_id", "row", "col", "z"), 0.5))
    got = by(op.raster_blobs(adapters.rasters(spark, SMALL).withColumn("width", F.lit(40).cast("long")), 0.5))
    assert got == want and any(b is None for x in got.values() for b in x) and any(b is not None for x in got.values() for b in x)


def test_raster_blobs_of_odd_rasters(spark):
    """Rasters of several forms in a batch, one pixel, none, null, and a missing height."""
    odd = {1: (3, [4.0, 1.0, 2.0, 3.0, 9.0, 1.0]), 2: (2, [0.0, 5.0, 7.0, 5.0, 1.0, 2.0]), 3: (1, [5.0]), 4: (3, []), 5: (2, None), 6: (2, [1.0, None, 2.0, 3.0]), 7: (3, [1.0, 0.0, 2.0, 8.0, 9.0, 0.0])}
    rasters = spark.createDataFrame([(p, w, z) for p, (w, z) in odd.items()], "plot_id long, width long, z array<double>").coalesce(1)
    px = spark.createDataFrame([(p, k // w, k % w, v) for p, (w, z) in odd.items() for k, v in enumerate(z or [])], "plot_id long, row long, col long, z double")
    made = op.raster_blobs(rasters, 0.5, (0.3, 0.6))
    assert made.dtypes[:3] == [("plot_id", "bigint"), ("row", "bigint"), ("col", "bigint")]
    key = lambda df: sorted((x.plot_id, x.row, x.col, tuple(x.blob)) for x in df.select("plot_id", "row", "col", "blob").collect())
    got = key(made)
    assert got == key(op.blobs(px, 0.5, (0.3, 0.6))) and len(got) == 6 + 6 + 1 + 4 + 6
