"""Queries of the canopy raster: masks, statistics, gaps, local deviation, joined features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canopy as op
from ..operators import masks
from ..operators import point_features as pf
from ..operators import stencils as st
from . import adapters
from .adapters import PIXELS, POINTS
from .points import _FHD, _ROUND, _SQL, rounded
from .registry import query

_V = f'{PIXELS}, v AS (SELECT plot_id, "row", col, CASE WHEN NOT nodata THEN z END AS z FROM a_pixels), m AS (SELECT plot_id, quantile_cont(z, 0.5) AS md FROM v GROUP BY plot_id), f AS (SELECT v.*, coalesce(z, md) AS y FROM v JOIN m USING (plot_id))'
_STATS = "avg(z) AS chm_mean, stddev_pop(z) AS chm_std, max(z) AS chm_max, min(z) AS chm_min, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS chm_iqr, count(z) AS chm_num_pixels, (avg(z*z*z) - 3*avg(z)*avg(z*z) + 2*avg(z)*avg(z)*avg(z)) / pow(stddev_pop(z), 3) AS chm_skew, kurtosis_pop(z) AS chm_kurtosis"
_COVER = ", ".join(f"count(*) FILTER (z >= {t}) / count(z) AS canopy_cover_gt{t}m, count(*) FILTER (z < {t}) / count(z) AS gap_fraction_lt{t}m" for t in op.THRESHOLDS)


def _std(k: int) -> str:
    """Local deviation at each pixel: clamped neighbours along columns, then along rows."""
    return f"""(SELECT a.plot_id, a."row", a.col, a.z, sqrt(greatest(avg(b.q) - avg(b.m) * avg(b.m), 0)) AS s FROM f a CROSS JOIN range(-{k}, {k + 1}) dc
  JOIN (SELECT a.plot_id, a."row", a.col, avg(b.y) AS m, avg(b.y * b.y) AS q FROM f a CROSS JOIN range(-{k}, {k + 1}) dr JOIN f b ON b.plot_id = a.plot_id AND b.col = a.col AND b."row" = least(greatest(a."row" + dr.range, 0), 39) GROUP BY ALL) b
  ON b.plot_id = a.plot_id AND b."row" = a."row" AND b.col = least(greatest(a.col + dc.range, 0), 39) GROUP BY a.plot_id, a."row", a.col, a.z)"""


def _gap(t: int) -> str:
    """Components by spreading the numbers of pixels without a gap to the left or above, among which is each component's least."""
    return f"""g{t} AS (SELECT plot_id, "row" AS r, col AS c FROM v WHERE z < {t}),
  s{t} AS (SELECT plot_id, r, c, r * 40 + c AS id FROM g{t} a WHERE NOT EXISTS (SELECT 1 FROM g{t} b WHERE b.plot_id = a.plot_id AND (b.r = a.r AND b.c = a.c - 1 OR b.r = a.r - 1 AND b.c = a.c))),
  w{t} AS (SELECT plot_id, r, c, id FROM s{t} UNION SELECT n.plot_id, n.r, n.c, w.id FROM w{t} w JOIN g{t} n ON n.plot_id = w.plot_id AND abs(n.r - w.r) + abs(n.c - w.c) = 1 AND w.id < n.r * 40 + n.c),
  l{t} AS (SELECT plot_id, r, c, min(id) AS id FROM w{t} GROUP BY ALL), z{t} AS (SELECT plot_id, id, count(*) AS n FROM l{t} GROUP BY ALL), gp{t} AS (SELECT plot_id, count(*) AS gap_count_lt{t}m, max(n) * 0.25e0 AS gap_max_area_lt{t}m FROM z{t} GROUP BY plot_id)"""


_PX = 0.5  # metres a pixel
_GAPS = ", ".join(_gap(t) for t in op.THRESHOLDS)
_GAPCOLS = ", ".join(f"coalesce(gap_count_lt{t}m, 0) AS gap_count_lt{t}m, coalesce(gap_max_area_lt{t}m, 0.0e0) AS gap_max_area_lt{t}m" for t in op.THRESHOLDS)
_R = lambda cols: ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in cols)
_SNAMES = ("chm_mean", "chm_std", "chm_max", "chm_min", "chm_iqr", "chm_skew", "chm_kurtosis")
_CNAMES = tuple(f"{a}{t}m" for t in op.THRESHOLDS for a in ("canopy_cover_gt", "gap_fraction_lt"))


def _px(spark, sf_dir):
    return op.masked(adapters.pixels(spark, sf_dir), F.col("nodata")).select("plot_id", "row", "col", "z")


@query("chm_nodata_mask", f'WITH {_V} SELECT plot_id, "row", col, round(z, 6) AS z FROM v')
def chm_nodata_mask(spark, sf_dir):
    return rounded(_px(spark, sf_dir))


@query("chm_stats", f"WITH {_V}, s AS (SELECT plot_id, {_STATS} FROM v GROUP BY plot_id) SELECT plot_id, chm_num_pixels, {_R(_SNAMES)} FROM s")
def chm_stats(spark, sf_dir):
    return rounded(op.stats(_px(spark, sf_dir)))


@query("chm_cover_gap", f"WITH {_V}, s AS (SELECT plot_id, {_COVER} FROM v GROUP BY plot_id) SELECT plot_id, {_R(_CNAMES)} FROM s")
def chm_cover_gap(spark, sf_dir):
    return rounded(op.cover(_px(spark, sf_dir)))


@query("chm_gap_components", f"WITH RECURSIVE {_V}, {_GAPS} SELECT n.plot_id, {_GAPCOLS} FROM (SELECT DISTINCT plot_id FROM v) n LEFT JOIN gp3 USING (plot_id) LEFT JOIN gp5 USING (plot_id)")
def chm_gap_components(spark, sf_dir):
    return rounded(op.gaps(_px(spark, sf_dir), _PX))


@query("chm_local_std", f"WITH {_V} SELECT plot_id, round(avg(s), 6) AS chm_local_std_3m FROM {_std(3)} WHERE z IS NOT NULL GROUP BY plot_id")
def chm_local_std(spark, sf_dir):
    return rounded(op.local_std(_px(spark, sf_dir), 3.0, _PX, "chm_local_std_3m"))


@query("chm_texture", f"WITH {_V} SELECT plot_id, round(avg(s * s), 6) AS chm_texture_variance FROM {_std(1)} WHERE z IS NOT NULL GROUP BY plot_id")
def chm_texture(spark, sf_dir):
    return rounded(op.texture(_px(spark, sf_dir)))


_CHM = f"""{_V}, {_GAPS}, loc AS (SELECT a.plot_id, avg(a.s) AS chm_local_std_1m, avg(b.s) AS chm_local_std_3m, avg(a.s * a.s) AS chm_texture_variance FROM {_std(1)} a JOIN {_std(3)} b USING (plot_id, "row", col) WHERE a.z IS NOT NULL GROUP BY a.plot_id),
ch AS (SELECT plot_id, {_STATS}, {_COVER} FROM v GROUP BY plot_id), chm AS (SELECT ch.plot_id, chm_num_pixels, {_R((*_SNAMES, *_CNAMES))}, {_GAPCOLS}, {_R(("chm_local_std_1m", "chm_local_std_3m", "chm_texture_variance"))} FROM ch LEFT JOIN gp3 USING (plot_id) LEFT JOIN gp5 USING (plot_id) JOIN loc USING (plot_id))"""


@query("chm_features", f"WITH RECURSIVE {_CHM} SELECT * FROM chm")
def chm_features(spark, sf_dir):
    return rounded(op.features(_px(spark, sf_dir), _PX))


_LAZ = f"{POINTS}, {_FHD}, lz AS (SELECT plot_id, {', '.join(map(_ROUND, _SQL))} FROM a_points GROUP BY plot_id), laz AS (SELECT lz.*, fhd_0p5m FROM lz JOIN fhd USING (plot_id) WHERE plot_id >= 5)"


def _both(spark, sf_dir):
    return op.joined(op.features(_px(spark, sf_dir), _PX), pf.point_features(adapters.points(spark, sf_dir)).where("plot_id >= 5"))


@query(
    "plot_features_full_join",
    f"""WITH RECURSIVE {_CHM}, {_LAZ} SELECT coalesce(c.plot_id, l.plot_id) AS plot_id, c.* EXCLUDE (plot_id, canopy_cover_gt3m, canopy_cover_gt5m), l.* EXCLUDE (plot_id, canopy_cover_gt3m, canopy_cover_gt5m),
  c.canopy_cover_gt3m AS chm_canopy_cover_gt3m, c.canopy_cover_gt5m AS chm_canopy_cover_gt5m, coalesce(l.canopy_cover_gt3m, c.canopy_cover_gt3m) AS canopy_cover_gt3m, coalesce(l.canopy_cover_gt5m, c.canopy_cover_gt5m) AS canopy_cover_gt5m,
  c.plot_id IS NOT NULL AS has_chm, l.plot_id IS NOT NULL AS has_laz FROM chm c FULL JOIN laz l ON c.plot_id = l.plot_id""",
)
def plot_features_full_join(spark, sf_dir):
    return rounded(_both(spark, sf_dir))


@query(
    "scan_counters",
    f"""WITH {PIXELS}, {POINTS}, k AS (SELECT c_custkey AS plot_id FROM customer), c AS (SELECT DISTINCT plot_id, true AS c FROM a_pixels WHERE NOT nodata), l AS (SELECT DISTINCT plot_id, true AS l FROM a_points WHERE plot_id >= 5),
  j AS (SELECT coalesce(c, false) AS c, coalesce(l, false) AS l FROM k LEFT JOIN c USING (plot_id) LEFT JOIN l USING (plot_id))
SELECT count(*) FILTER (c OR l) AS ok, count(*) FILTER (c AND l) AS "both", count(*) FILTER (NOT l) AS only_chm, count(*) FILTER (NOT c) AS only_laz, count(*) FILTER (c AND NOT l) AS only_chm_exact, count(*) FILTER (l AND NOT c) AS only_laz_exact, count(*) FILTER (NOT c AND NOT l) AS both_invalid FROM j""",
)
def scan_counters(spark, sf_dir):
    """Every customer key is a plot that was looked for."""
    keys = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plot_id"))
    return op.counters(_both(spark, sf_dir), keys)


# -- masks and filters of the tree detector ----------------------------------------------------

def _raw(spark, sf_dir):
    return adapters.pixels(spark, sf_dir).select("plot_id", "row", "col", "z")


_PIT = 2


@query(
    "pit_fill",
    f"""WITH {PIXELS}, u AS (SELECT a.plot_id, a."row", a.col, a.z, max(b.z) AS up FROM a_pixels a JOIN a_pixels b ON b.plot_id = a.plot_id AND abs(b."row" - a."row") <= {_PIT} AND abs(b.col - a.col) <= {_PIT} GROUP BY ALL),
c AS (SELECT a.plot_id, a."row", a.col, a.z, min(b.up) AS cl FROM u a JOIN u b ON b.plot_id = a.plot_id AND abs(b."row" - a."row") <= {_PIT} AND abs(b.col - a.col) <= {_PIT} GROUP BY ALL)
SELECT plot_id, "row", col, round(CASE WHEN cl - z <= 0.8e0 THEN cl ELSE z + 0.8e0 END, 6) AS filled FROM c""",
)
def pit_fill(spark, sf_dir):
    return rounded(st.fill_pits(_raw(spark, sf_dir), _PIT, 0.8).select("plot_id", "row", "col", "filled"))


_DISK = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in st.disk(3)) + ") o(dr, dc)"


def _closed(cond: str) -> str:
    """b2: pixels of a condition, closed."""
    return f"""b0 AS (SELECT plot_id, "row", col, {cond} AS m FROM a_pixels), b1 AS (SELECT a.plot_id, a."row", a.col, bool_or(b.m) AS m FROM b0 a CROSS JOIN {_DISK} JOIN b0 b ON b.plot_id = a.plot_id AND b."row" = a."row" + dr AND b.col = a.col + dc GROUP BY ALL),
b2 AS (SELECT a.plot_id, a."row", a.col, bool_and(b.m) AS m FROM b1 a CROSS JOIN {_DISK} JOIN b1 b ON b.plot_id = a.plot_id AND b."row" = a."row" + dr AND b.col = a.col + dc GROUP BY ALL)"""


@query("height_mask_close", f'WITH {PIXELS}, {_closed("z > 3.5e0")} SELECT plot_id, "row", col, m AS mask FROM b2')
def height_mask_close(spark, sf_dir):
    return st.closing(_raw(spark, sf_dir).withColumn("m", F.col("z") > 3.5), "m", 3, "mask").select("plot_id", "row", "col", "mask")


_ROUGH = """(SELECT a.plot_id, a."row", a.col, sqrt(greatest(avg(b.z * b.z) - avg(b.z) * avg(b.z), 0)) AS s FROM a_pixels a CROSS JOIN range(-2, 2) dr CROSS JOIN range(-2, 2) dc
  JOIN a_pixels b ON b.plot_id = a.plot_id AND b."row" = least(greatest(a."row" + dr.range, 0), 39) AND b.col = least(greatest(a.col + dc.range, 0), 39) GROUP BY ALL)"""


@query("roughness_mask", f'WITH {PIXELS} SELECT plot_id, "row", col, s >= 0.28e0 AS rough FROM {_ROUGH}')
def roughness_mask(spark, sf_dir):
    return masks.roughness_mask(_raw(spark, sf_dir), _PX).select("plot_id", "row", "col", "rough")


_CANOPY = f"""{_closed("z >= 3.5e0")}, g AS (SELECT plot_id, "row" AS r, col AS c FROM b2 WHERE m),
s0 AS (SELECT plot_id, r, c, r * 40 + c AS id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.plot_id = a.plot_id AND (b.r = a.r AND b.c = a.c - 1 OR b.r = a.r - 1 AND b.c = a.c))),
sp AS (SELECT plot_id, r, c, id FROM s0 UNION SELECT n.plot_id, n.r, n.c, w.id FROM sp w JOIN g n ON n.plot_id = w.plot_id AND abs(n.r - w.r) + abs(n.c - w.c) = 1 AND w.id < n.r * 40 + n.c),
lb AS (SELECT plot_id, r, c, min(id) AS id FROM sp GROUP BY ALL), big AS (SELECT plot_id, id FROM lb GROUP BY ALL HAVING count(*) >= 64),
cm AS (SELECT p.plot_id, p."row", p.col, big.id IS NOT NULL AS canopy FROM a_pixels p LEFT JOIN lb ON lb.plot_id = p.plot_id AND r = "row" AND c = p.col LEFT JOIN big ON big.plot_id = lb.plot_id AND big.id = lb.id)"""


@query("canopy_mask", f"WITH RECURSIVE {PIXELS}, {_CANOPY} SELECT * FROM cm")
def canopy_mask(spark, sf_dir):
    return masks.canopy_mask(_raw(spark, sf_dir), _PX).select("plot_id", "row", "col", "canopy")


@query("mask_intersection", f'WITH RECURSIVE {PIXELS}, {_CANOPY}, {_closed("z > 3.5e0").replace("b0", "h0").replace("b1", "h1").replace("b2", "h2")} SELECT cm.plot_id, cm."row", cm.col, canopy AND m AND s >= 0.28e0 AS mask FROM cm JOIN h2 USING (plot_id, "row", col) JOIN {_ROUGH} r USING (plot_id, "row", col)')
def mask_intersection(spark, sf_dir):
    return masks.mask_intersection(_raw(spark, sf_dir), _PX).select("plot_id", "row", "col", "mask")


@query("quick_stats", f"WITH {PIXELS} SELECT plot_id, count(z) AS n, round(min(z), 6) AS min, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.95), 6) AS p95, round(max(z), 6) AS max FROM a_pixels WHERE NOT nodata GROUP BY plot_id")
def quick_stats(spark, sf_dir):
    return rounded(masks.quick_stats(adapters.pixels(spark, sf_dir), mask=~F.col("nodata")))


@query("clahe")
def clahe(spark, sf_dir):
    return rounded(adapters.by_pixel(masks.equalised_rasters(adapters.rasters(spark, sf_dir), 3.5)))
