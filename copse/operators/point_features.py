"""Height, return and intensity features of point clouds, one row per plot in one grouped aggregation.

Heights are above ground.  NaN counts as missing.  Columns of missing
dimensions are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEIGHT = ("z_mean", "z_std", "z_max", "z_min")
PERCENTILES = ("z_iqr", "z_p10", "z_p25", "z_p50", "z_p75", "z_p95")
SHAPE = ("num_points", "z_skew", "z_kurtosis")
RATIOS = ("ratio_below_0p5m", "ratio_below_1m", "mid_story_ratio", "high_canopy_ratio", "canopy_cover_gt3m", "canopy_cover_gt5m")
RETURNS = ("ratio_first_returns", "ratio_last_returns", "ratio_multi_returns", "first_returns_below_2m")
INTENSITY = ("intensity_mean", "intensity_std", "intensity_cv", "intensity_p10", "intensity_p50", "intensity_p90", "intensity_low1m_mean", "intensity_low1m_p90")
BIN = 0.5


def known(c: Column) -> Column:
    """NaN to null, so that aggregates skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count("z")


def aggregates(z: str = "z", intensity: str = "intensity", rn: str = "return_number", nr: str = "number_of_returns") -> dict[str, Column]:
    """Each feature but the height diversity as an aggregate expression."""
    zc, i, first = F.col(z), F.col(intensity), F.col(rn) == 1
    pz = F.percentile(zc, F.array(*[F.lit(p) for p in (0.10, 0.25, 0.50, 0.75, 0.95)]))
    pi = F.percentile(i, F.array(*[F.lit(p) for p in (0.10, 0.50, 0.90)]))
    low = F.when(zc < 1.0, i)
    mean_i, std_i = F.avg(i), F.stddev_pop(i)
    multi = F.count(nr) > 0
    return {
        "z_mean": F.avg(zc), "z_std": F.stddev_pop(zc), "z_max": F.max(zc), "z_min": F.min(zc),
        "z_iqr": pz[3] - pz[1], "z_p10": pz[0], "z_p25": pz[1], "z_p50": pz[2], "z_p75": pz[3], "z_p95": pz[4],
        "ratio_below_0p5m": _share(zc < 0.5), "ratio_below_1m": _share(zc < 1.0), "mid_story_ratio": _share((zc > 0.15) & (zc <= 5.0)),
        "high_canopy_ratio": _share(zc > 5.0), "canopy_cover_gt3m": _share(zc > 3.0), "canopy_cover_gt5m": _share(zc > 5.0),
        "num_points": F.count("z"), "z_skew": F.skewness(zc), "z_kurtosis": F.kurtosis(zc),
        "ratio_first_returns": F.when(F.count(rn) > 0, _share(first)), "ratio_last_returns": F.when(multi, _share(F.col(rn) == F.col(nr))),
        "ratio_multi_returns": F.when(multi, _share(F.col(nr) > 1)), "first_returns_below_2m": F.when(F.count(rn) > 0, F.when(F.count_if(first) > 0, F.count_if(first & (zc < 2.0)) / F.count("z")).otherwise(F.lit(0.0))),
        "intensity_mean": mean_i, "intensity_std": std_i, "intensity_cv": std_i / (mean_i + 1e-9),
        "intensity_p10": pi[0], "intensity_p50": pi[1], "intensity_p90": pi[2], "intensity_low1m_mean": F.avg(low), "intensity_low1m_p90": F.percentile(low, F.lit(0.9)),
    }


def height_diversity(points: DataFrame, key: str = "plot_id", width: float = BIN) -> DataFrame:
    """``(key, fhd_0p5m)``: base-2 entropy of the heights' histogram; 0 where no height is above 0.

    Bins are ``width`` wide from 0, their upper edges below the largest height
    plus one width; the last bin also holds its upper edge, and heights
    below 0 are left out.
    """
    top = points.groupBy(key).agg(F.max("z").alias("top"))
    bins = points.where("z >= 0").groupBy(key, F.floor(F.col("z") / width).alias("bin")).agg(F.count("*").alias("n"))
    last = (F.ceil((F.col("top") + width) / width) - 2).alias("last")
    b = bins.join(top.select(key, "top", last), key).where("top > 0 and last >= 0")
    b = b.groupBy(key, F.least("bin", "last").alias("bin")).agg(F.sum("n").alias("n"))
    per = b.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    entropy = per.select(key, (F.log2("t") - F.col("s") / F.col("t")).alias("h"))
    return top.join(entropy, key, "left").select(key, F.coalesce("h", F.lit(0.0)).alias("fhd_0p5m"))


def point_features(points: DataFrame, key: str = "plot_id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Feature columns of each plot; all of them, or those named."""
    clean = points.withColumn("z", known(F.col("z"))).where("z is not null")
    made = aggregates()
    out = clean.groupBy(key).agg(*[made[c].alias(c) for c in (columns or made)])
    return out if columns else out.join(height_diversity(clean, key), key)
