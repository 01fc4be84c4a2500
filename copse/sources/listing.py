"""Recursive file listings and what file names tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN = r"(?i)\.(tif|tiff|las|laz)$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of rasters and point clouds below a folder, hidden copies (``._``) left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(KNOWN) & ~name.startswith("._"))


def parsed(files: DataFrame) -> DataFrame:
    """Adds prefix, kind, res and key (prefix_res) of ``prefix_CHM_RESm.tif`` and ``prefix_LAZ_RESm.laz``; other names drop out; of equal keys the last path stays."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"(?i)^(.+?)_(CHM|LAZ)_([0-9.]+)m\.(tif|laz)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    f = files.where(name.rlike(pattern)).withColumns({"prefix": part(1), "kind": F.upper(part(2)), "res": part(3)}).withColumn("key", F.concat_ws("_", "prefix", "res"))
    best = f.groupBy("key", "kind").agg(F.max("path").alias("path"))
    return f.join(best, ["key", "kind", "path"])


def pairs(files: DataFrame) -> DataFrame:
    """``(id, chm, laz)``: every raster with the point cloud of its id, empty text without one."""
    name = F.element_at(F.split("path", "/"), -1)
    ident = F.regexp_extract(name, r"(?i)^(.+?)_(?:CHM|LAZ)", 1)
    f = files.select(ident.alias("id"), "path", F.lower(name).alias("name")).where("id <> ''")
    chm = f.where(F.col("name").rlike(r"\.tiff?$")).groupBy("id").agg(F.max("path").alias("chm"))
    laz = f.where(F.col("name").endswith(".laz")).groupBy("id").agg(F.max("path").alias("laz"))
    return chm.join(laz, "id", "left").select("id", "chm", F.coalesce("laz", F.lit("")).alias("laz"))
