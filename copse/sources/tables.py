"""CSV scans: GPS records, plot coordinates, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coordinates import coerce
from ..operators.tiles import plot_name

# Columns of GPS files; easting and Easting are two columns.
GPS = {"vsnplotname": "vsnplotname", "latitude": "latitude", "longitude": "longitude", "easting": "raw_e", "northing": "raw_n", "ASSIGNED_EASTING": "asg_e", "ASSIGNED_NORTHING": "asg_n", "Easting": "cap_e", "Northing": "cap_n", "UTMZONE": "utmzone"}
TARGET = "lichen_presence"


def _csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """All columns as texts, named ``c0`` and so on, as names may differ in case alone; and their names."""
    first = spark.read.option("header", False).csv(path).limit(1).first()
    names = [] if first is None else [(v or "").strip().lstrip("﻿") for v in first]
    schema = ", ".join(f"c{i} string" for i in range(len(names))) or "c0 string"
    df = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    return df, names


def gps_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records of :mod:`coordinates`; names are told apart by case; fails without the required columns."""
    df, names = _csv(spark, path)
    missing = {"vsnplotname", "latitude", "longitude"} - set(names)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}; found {names}")
    at = {n: i for i, n in enumerate(names)}
    return coerce(df.select(*[F.col(f"c{at[n]}").alias(to) for n, to in GPS.items() if n in at]))


def coordinate_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(plot_id, e, n, target_epsg_int, target_epsg, lon, lat)``; names match in any case, the last of equal ones counts.

    Fails without a name, a reference system column and the centre.
    """
    df, names = _csv(spark, path)
    at = {n.lower(): i for i, n in enumerate(names)}
    if "vsnplotname" not in at or not {"target_epsg", "target_epsg_int"} & set(at) or not {"center_e", "center_n"} <= set(at):
        raise ValueError(f"need vsnplotname, TARGET_EPSG or TARGET_EPSG_INT, CENTER_E and CENTER_N; found {names}")
    text = lambda n: F.col(f"c{at[n]}") if n in at else F.lit(None).cast("string")
    number = lambda n: F.nanvl(text(n).try_cast("double"), F.lit(None).cast("double"))
    return df.select(
        plot_name(text("vsnplotname")).alias("plot_id"), number("center_e").alias("e"), number("center_n").alias("n"), number("target_epsg_int").alias("target_epsg_int"),
        text("target_epsg").alias("target_epsg"), number("lon").alias("lon"), number("lat").alias("lat"),
    )


def feature_csv(spark: SparkSession, path: str, target: str = TARGET) -> DataFrame:
    """A feature table with inferred types and an integer target; fails without it."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if target not in df.columns:
        raise ValueError(f"no column {target}; found {df.columns}")
    return df.withColumn(target, F.col(f"`{target}`").cast("int"))


def with_labels(features: DataFrame, labels: DataFrame, key: str = "plot_id", target: str = TARGET) -> DataFrame:
    """Features of the plots that have a label; names of plots match without white space around and in any case."""
    y = labels.select(plot_name(F.col(key).cast("string")).alias("_k"), F.col(target).cast("int").alias(target)).where(f"{target} IS NOT NULL")
    return features.withColumn("_k", plot_name(F.col(key).cast("string"))).join(y, "_k").drop("_k")
