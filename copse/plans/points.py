"""Queries of the point-cloud features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import point_features as pf
from . import adapters
from .registry import query


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero, for comparison with the oracle."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


_N = "count(z)"
_SQL = {
    "z_mean": "avg(z)", "z_std": "stddev_pop(z)", "z_max": "max(z)", "z_min": "min(z)",
    "z_iqr": "quantile_cont(z, 0.75) - quantile_cont(z, 0.25)", "z_p10": "quantile_cont(z, 0.10)", "z_p25": "quantile_cont(z, 0.25)", "z_p50": "quantile_cont(z, 0.50)", "z_p75": "quantile_cont(z, 0.75)", "z_p95": "quantile_cont(z, 0.95)",
    "ratio_below_0p5m": f"count(*) FILTER (z < 0.5) / {_N}", "ratio_below_1m": f"count(*) FILTER (z < 1) / {_N}", "mid_story_ratio": f"count(*) FILTER (z > 0.15e0 AND z <= 5) / {_N}",
    "high_canopy_ratio": f"count(*) FILTER (z > 5) / {_N}", "canopy_cover_gt3m": f"count(*) FILTER (z > 3) / {_N}", "canopy_cover_gt5m": f"count(*) FILTER (z > 5) / {_N}",
    "num_points": _N,
    "z_skew": "(avg(z*z*z) - 3*avg(z)*avg(z*z) + 2*avg(z)*avg(z)*avg(z)) / pow(stddev_pop(z), 3)", "z_kurtosis": "kurtosis_pop(z)",
    "ratio_first_returns": f"count(*) FILTER (return_number = 1) / {_N}", "ratio_last_returns": f"count(*) FILTER (return_number = number_of_returns) / {_N}",
    "ratio_multi_returns": f"count(*) FILTER (number_of_returns > 1) / {_N}", "first_returns_below_2m": f"count(*) FILTER (return_number = 1 AND z < 2) / {_N}",
    "intensity_mean": "avg(intensity)", "intensity_std": "stddev_pop(intensity)", "intensity_cv": "stddev_pop(intensity) / (avg(intensity) + 1e-9)",
    "intensity_p10": "quantile_cont(CAST(intensity AS DOUBLE), 0.10)", "intensity_p50": "quantile_cont(CAST(intensity AS DOUBLE), 0.50)", "intensity_p90": "quantile_cont(CAST(intensity AS DOUBLE), 0.90)",
    "intensity_low1m_mean": "avg(intensity) FILTER (z < 1)", "intensity_low1m_p90": "quantile_cont(CAST(intensity AS DOUBLE), 0.90) FILTER (z < 1)",
}
_ROUND = lambda c: f"{_SQL[c]} AS {c}" if c == "num_points" else f"round({_SQL[c]}, 6) + 0.0e0 AS {c}"
_FHD = """hb AS (SELECT plot_id, least(floor(z / 0.5e0), ceil((max(z) OVER (PARTITION BY plot_id) + 0.5e0) / 0.5e0) - 2) AS bin FROM a_points WHERE z >= 0),
hn AS (SELECT plot_id, bin, count(*) AS n FROM hb GROUP BY plot_id, bin),
hp AS (SELECT plot_id, n / sum(n) OVER (PARTITION BY plot_id) AS p FROM hn),
fhd AS (SELECT plot_id, round(-sum(p * log2(p)), 6) + 0.0e0 AS fhd_0p5m FROM hp GROUP BY plot_id)"""


def _part(name: str, columns: tuple[str, ...]) -> None:
    sql = f"WITH {adapters.POINTS} SELECT plot_id, {', '.join(map(_ROUND, columns))} FROM a_points GROUP BY plot_id"

    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(pf.point_features(adapters.points(spark, sf_dir), columns=columns))


_part("laz_height_stats", pf.HEIGHT)
_part("laz_percentiles", pf.PERCENTILES)
_part("laz_shape", pf.SHAPE)
_part("laz_ratios", pf.RATIOS)
_part("laz_returns", pf.RETURNS)
_part("laz_intensity", pf.INTENSITY)


@query("laz_fhd", f"WITH {adapters.POINTS}, {_FHD} SELECT plot_id, fhd_0p5m FROM fhd")
def laz_fhd(spark, sf_dir):
    return rounded(pf.height_diversity(adapters.points(spark, sf_dir)))


@query("laz_features", f"WITH {adapters.POINTS}, {_FHD}, f AS (SELECT plot_id, {', '.join(map(_ROUND, _SQL))} FROM a_points GROUP BY plot_id) SELECT f.*, fhd_0p5m FROM f JOIN fhd USING (plot_id)")
def laz_features(spark, sf_dir):
    return rounded(pf.point_features(adapters.points(spark, sf_dir)))
