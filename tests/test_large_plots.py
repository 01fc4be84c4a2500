"""Plans that hold for many plots: pixels are made by many tasks, and no raster goes to the driver."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """3,000 trees, 250 plots."""
    where = str(tmp_path_factory.mktemp("parts"))
    spark.range(3000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{where}/part.parquet")
    return where


def plan(df):
    """The plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def run(name, spark, where):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, where)


def test_pixels_are_made_by_many_tasks(spark, parts):
    """quick_stats: the trees' few bytes were coalesced to one task, which made all pixels."""
    from copse.plans import adapters

    px = adapters.pixels(spark, parts)
    assert px.count() == 250 * 1600 and px.select(F.spark_partition_id()).distinct().count() > 1
    assert run("quick_stats", spark, parts).count() == 250


@pytest.mark.parametrize("name", ["canopy_mask", "mask_intersection", "clahe", "detect_treetops", "crown_zonal", "tree_nnd", "nnd_stats", "slim_plot_features"])
def test_no_raster_goes_to_the_driver(spark, parts, name):
    """Pixels were joined to what a kernel had made of them, and their few estimated bytes were broadcast."""
    assert "Broadcast" not in plan(run(name, spark, parts))
