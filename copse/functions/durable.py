"""Lineage cuts that outlive executors: checkpoints in the folder that all of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where ``spark.checkpoint.dir`` is unset and Spark runs in one JVM.
LOCAL = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and drops its lineage and its plan."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or LOCAL)
    return df.checkpoint(eager=True)
