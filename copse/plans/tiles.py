"""Queries of tile names, coverage and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import nested, reprojection
from ..operators import tiles as op
from . import adapters
from .adapters import PIXELS, PLOTS, POINTS, TILES
from .points import rounded
from .registry import query

_STEM = "regexp_replace(regexp_replace(replace(lower(split_part(path, '/', -1)), '.copc', ''), '\\.[^.]*$', ''), '[\\s\\-_]+', '', 'g')"
_KEY = "lower(regexp_replace(plot_id, '[\\s\\-_]+', '', 'g'))"
_CAND = f"cd AS (SELECT plot_id, e, n, t.* FROM a_plots JOIN (SELECT *, {_STEM} AS stem FROM a_tiles) t ON contains(stem, {_KEY}))"
_PTS = "(VALUES " + ", ".join(f"({i}, {10 * dx}.0e0, {10 * dy}.0e0)" for i, (dx, dy) in enumerate(op.SAMPLES)) + ") s(idx, dx, dy)"
_TO = reprojection("px", "py", "own", "epsg", "q")
_AT = nested(f"SELECT k.plot_id, k.kind, c.path, k.own, c.epsg, xmin, ymin, xmax, ymax, idx, k.e + dx AS px, k.n + dy AS py FROM k LEFT JOIN (SELECT * FROM cd WHERE epsg IS NOT NULL) c ON c.plot_id = k.plot_id AND c.kind = k.kind CROSS JOIN {_PTS}", _TO)
_RECT = nested("SELECT plot_id, own, epsg, px, py FROM (SELECT plot_id, epsg AS own, e, n FROM a_plots WHERE epsg IS NOT NULL) CROSS JOIN (SELECT DISTINCT epsg FROM a_tiles WHERE epsg IS NOT NULL) CROSS JOIN (VALUES (1.0e0), (-1.0e0)) v(d) CROSS JOIN LATERAL (SELECT e + 10.0e0 * d AS px, n + 10.0e0 * d AS py)", _TO)
_RECTS = f"rc AS MATERIALIZED (SELECT plot_id, epsg, min(qe) AS x0, min(qn) AS y0, max(qe) AS x1, max(qn) AS y1 FROM ({_RECT}) GROUP BY ALL)"
_COV = f"""{_CAND}, {_RECTS}, k AS (SELECT plot_id, e, n, epsg AS own, kind FROM a_plots, (VALUES ('CHM'), ('LAZ')) v(kind)),
hits AS MATERIALIZED (SELECT plot_id, kind, path, idx, coalesce(qe BETWEEN xmin - 2 AND xmax + 2 AND qn BETWEEN ymin - 2 AND ymax + 2, false) AS h FROM ({_AT})),
pt AS (SELECT plot_id, kind, path, bool_and(h) FILTER (idx < 4) AS all4, bool_or(h) AS anyh FROM hits GROUP BY ALL),
ix AS (SELECT plot_id, kind, list(idx ORDER BY idx) AS miss FROM (SELECT plot_id, kind, idx, bool_or(h) AS h FROM hits GROUP BY ALL) WHERE NOT h GROUP BY ALL),
cv0 AS (SELECT plot_id, kind, bool_or(all4) AS single, count(path) AS n_tiles, coalesce(list(path ORDER BY path) FILTER (all4 AND path IS NOT NULL), []) AS single_tiles,
  coalesce(list(path ORDER BY path) FILTER (anyh AND path IS NOT NULL), []) AS union_tiles, coalesce(list(path ORDER BY path) FILTER (path IS NOT NULL), []) AS all_tiles FROM pt GROUP BY ALL),
cv AS (SELECT cv0.*, CASE WHEN single THEN 'single' WHEN miss IS NULL THEN 'union' ELSE 'none' END AS mode, CASE WHEN single OR miss IS NULL THEN [] ELSE miss END AS missing FROM cv0 LEFT JOIN ix USING (plot_id, kind)),
us AS (SELECT *, CASE WHEN len(CASE WHEN mode = 'single' THEN single_tiles ELSE union_tiles END) > 0 THEN CASE WHEN mode = 'single' THEN single_tiles ELSE union_tiles END ELSE all_tiles END AS use FROM cv),
cl AS (SELECT u.plot_id, u.kind, list(t.path ORDER BY t.path) AS clipped FROM (SELECT plot_id, kind, unnest(use) AS path FROM us) u JOIN a_tiles t USING (path) JOIN rc ON rc.plot_id = u.plot_id AND rc.epsg = t.epsg
  AND x0 <= t.xmax AND x1 >= t.xmin AND y0 <= t.ymax AND y1 >= t.ymin GROUP BY ALL),
st AS (SELECT us.*, coalesce(clipped, []) AS clipped, CASE WHEN n_tiles = 0 THEN 'Missing' WHEN clipped IS NULL THEN 'NoOverlap' WHEN CASE WHEN kind = 'CHM' THEN len(clipped) ELSE len(use) END = 1 THEN 'Single' ELSE 'Merged' END AS status FROM us LEFT JOIN cl USING (plot_id, kind))"""
_STATUS = f"""{TILES}, {PLOTS}, {_COV}, w AS (SELECT c.plot_id AS "PlotID", c.mode AS "CHM_MODE", c.status AS "CHM_STATUS", array_to_string(c.missing, ',') AS "CHM_MISSING_IDX", l.mode AS "LAZ_MODE", l.status AS "LAZ_STATUS", array_to_string(l.missing, ',') AS "LAZ_MISSING_IDX",
  c.mode = 'none' OR c.status IN ('Missing', 'NoOverlap') AS cb, l.mode = 'none' OR l.status IN ('Missing', 'NoOverlap') AS lb FROM st c JOIN st l ON c.plot_id = l.plot_id AND c.kind = 'CHM' AND l.kind = 'LAZ'),
stt AS (SELECT * EXCLUDE (cb, lb), CASE WHEN cb OR lb THEN 'YES' ELSE 'NO' END AS "NEED_DOWNLOAD", concat_ws('|', CASE WHEN cb THEN 'CHM_INCOMPLETE' END, CASE WHEN lb THEN 'LAZ_INCOMPLETE' END) AS "REASON" FROM w)"""


def _pt(spark, sf_dir):
    return adapters.plots(spark, sf_dir).select("plot_id", "e", "n", "epsg"), adapters.tiles(spark, sf_dir)


@query("tile_name_key", f"WITH {TILES} SELECT path, {_STEM} AS stem, CASE WHEN path LIKE '%.tif' THEN 'CHM' ELSE 'LAZ' END AS kind FROM a_tiles")
def tile_name_key(spark, sf_dir):
    return adapters.tiles(spark, sf_dir).select("path", op.stem_key(F.col("path")).alias("stem"), op.kind_of(F.col("path")).alias("kind"))


@query("tile_substring_join", f"WITH {TILES}, {PLOTS}, {_CAND} SELECT plot_id, path FROM cd")
def tile_substring_join(spark, sf_dir):
    p, t = _pt(spark, sf_dir)
    return op.candidates(p.select("plot_id"), t).select("plot_id", "path")


@query("tile_sibling_crs", f"WITH {TILES} SELECT t.path, coalesce(t.epsg, s.epsg) AS epsg FROM a_tiles t LEFT JOIN (SELECT dir, arg_min(epsg, path) AS epsg FROM a_tiles WHERE kind = 'CHM' AND epsg IS NOT NULL GROUP BY dir) s USING (dir)")
def tile_sibling_crs(spark, sf_dir):
    return op.sibling_epsg(adapters.tiles(spark, sf_dir)).select("path", "epsg")


@query("tile_bbox_join", f"WITH {TILES}, {PLOTS}, {_RECTS} SELECT plot_id, path FROM rc JOIN a_tiles USING (epsg) WHERE x0 <= xmax + 2 AND x1 >= xmin - 2 AND y0 <= ymax + 2 AND y1 >= ymin - 2")
def tile_bbox_join(spark, sf_dir):
    return op.overlap(*_pt(spark, sf_dir))


@query("coverage_samples", f"WITH {PLOTS} SELECT plot_id, CAST(idx AS INTEGER) AS idx, e + dx AS x, n + dy AS y FROM a_plots, {_PTS}")
def coverage_samples(spark, sf_dir):
    return op.samples(adapters.plots(spark, sf_dir))


@query("coverage_diagnose", f"WITH {TILES}, {PLOTS}, {_COV} SELECT plot_id, kind, mode, array_to_string(single_tiles, ';') AS single_tiles, array_to_string(union_tiles, ';') AS union_tiles, array_to_string(missing, ',') AS missing FROM cv")
def coverage_diagnose(spark, sf_dir):
    c = op.coverage(*_pt(spark, sf_dir))
    return c.select("plot_id", "kind", "mode", F.concat_ws(";", "single_tiles").alias("single_tiles"), F.concat_ws(";", "union_tiles").alias("union_tiles"), F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"))


@query("clip_status", f"WITH {_STATUS} SELECT * FROM stt")
def clip_status(spark, sf_dir):
    return op.status_table(*_pt(spark, sf_dir))


@query("clip_needs", f"WITH {_STATUS} SELECT * FROM stt WHERE \"NEED_DOWNLOAD\" = 'YES'")
def clip_needs(spark, sf_dir):
    return op.status_table(*_pt(spark, sf_dir)).where("NEED_DOWNLOAD = 'YES'")


@query("clip_log", f"WITH {TILES}, {PLOTS}, {_COV} SELECT plot_id AS \"PlotID\", kind AS \"Type\", array_to_string(CASE WHEN kind = 'CHM' THEN clipped ELSE use END, ';') AS \"UsedFiles\" FROM st WHERE status IN ('Single', 'Merged')")
def clip_log(spark, sf_dir):
    return op.log_table(*_pt(spark, sf_dir))


@query("epsg_parse", f"WITH {PLOTS} SELECT plot_id, coalesce(CAST(target_epsg_int AS INTEGER), TRY_CAST(split_part(target_epsg, ':', 2) AS INTEGER), CASE WHEN lon IS NOT NULL THEN 32600 + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 END) AS epsg, CASE WHEN target_epsg_int IS NOT NULL OR target_epsg IS NOT NULL THEN 'GIVEN' WHEN lon IS NOT NULL THEN 'FROM_LONLAT' ELSE 'NO_CRS' END AS crs_status FROM a_plots")
def epsg_parse(spark, sf_dir):
    return op.plot_system(adapters.plots(spark, sf_dir).drop("epsg")).select("plot_id", "epsg", "crs_status")


_BOXES = "a_boxes AS (SELECT CAST(n_nationkey AS BIGINT) AS box, (n_nationkey % 5) * 8.0e0 + 0.05e0 AS xmin, (n_nationkey // 5) * 8.0e0 + 0.05e0 AS ymin, (n_nationkey % 5) * 8.0e0 + 20.05e0 AS xmax, (n_nationkey // 5) * 8.0e0 + 20.05e0 AS ymax FROM nation)"
_IN = "x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"


def _boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    x, y = (k % 5) * 8.0 + 0.05, F.floor(k / 5) * 8.0 + 0.05
    return adapters.table(spark, sf_dir, "nation").select(k.cast("long").alias("plot_id"), x.alias("xmin"), y.alias("ymin"), (x + 20.0).alias("xmax"), (y + 20.0).alias("ymax"))


@query("clip_points", f"WITH {POINTS}, {_BOXES} SELECT box, count(*) AS n, round(sum(z), 3) AS z_sum, min(x) AS x_min, max(y) AS y_max FROM a_points JOIN a_boxes ON {_IN} GROUP BY box")
def clip_points(spark, sf_dir):
    c = op.clip_points(adapters.points(spark, sf_dir), _boxes(spark, sf_dir))
    return c.groupBy("box").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z_sum"), F.min("x").alias("x_min"), F.max("y").alias("y_max"))


@query("merge_points", f"WITH {POINTS}, {_BOXES}, c AS (SELECT box, z, point_format, first_value(point_format) OVER (PARTITION BY box ORDER BY -plot_id, point_format DESC) AS f FROM a_points JOIN a_boxes ON {_IN}) SELECT box, count(*) AS n, round(sum(z), 3) AS z_sum FROM c WHERE point_format = f GROUP BY box")
def merge_points(spark, sf_dir):
    """Plots stand for files, the last one first; a file holds several formats here, of which its greatest counts."""
    c = op.clip_points(adapters.points(spark, sf_dir), _boxes(spark, sf_dir))
    c = op.merge_points(c.withColumn("file", F.struct(-F.col("plot_id"), -F.col("point_format"))), order="file")
    return c.groupBy("box").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z_sum"))


_RASTERS = "a_rasters AS (SELECT path, epsg AS tile_epsg, xmin AS x0, ymax AS y0, 0.5e0 + (CAST(round(ymin) AS BIGINT) % 3) * 0.25e0 AS px_x, 0.5e0 + (CAST(round(ymin) AS BIGINT) % 3) * 0.25e0 AS px_y, CAST(40 AS BIGINT) AS width, CAST(30 AS BIGINT) AS height FROM {t} WHERE kind = 'CHM' AND epsg IS NOT NULL)"
_WIN = nested("SELECT p.plot_id, p.e, p.n, p.epsg, r.* FROM a_plots p JOIN cd USING (plot_id) JOIN a_rasters r ON r.path = cd.path", reprojection("e", "n", "epsg", "tile_epsg", "q"))
_SPAN = "greatest(2, CAST(round_even(20.0e0 / px_x, 0) AS BIGINT) + CAST(round_even(20.0e0 / px_x, 0) AS BIGINT) % 2)"
_WINDOWS = f"""{_RASTERS.format(t="a_tiles")}, {_CAND}, wn AS (SELECT plot_id, path, CAST(floor((qe - x0) / px_x) AS BIGINT) - w // 2 AS c0, CAST(floor((y0 - qn) / px_y) AS BIGINT) - w // 2 AS r0, w, width, height FROM (SELECT *, {_SPAN} AS w FROM ({_WIN})) WHERE qe IS NOT NULL),
ww AS (SELECT plot_id, path, greatest(r0, 0) AS row0, least(r0 + w, height) AS row1, greatest(c0, 0) AS col0, least(c0 + w, width) AS col1 FROM wn)"""


def _windows(spark, sf_dir):
    plots, tiles = _pt(spark, sf_dir)
    r = spark.sql("SELECT * FROM (WITH " + _RASTERS.format(t="{tiles}") + " SELECT * FROM a_rasters)", tiles=tiles)
    pairs = op.candidates(plots.select("plot_id"), tiles.select("path", "kind")).select("plot_id", "path").join(plots.hint("merge"), "plot_id").join(r.hint("merge"), "path")
    return op.clip_windows(pairs)


@query("clip_windows", f"WITH {TILES}, {PLOTS}, {_WINDOWS} SELECT * FROM ww WHERE row0 < row1 AND col0 < col1")
def clip_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


_CELL = "((r.range * 7 + c.range * 3 + length(path)) % 50) / 4.0e0"


@query("clip_pixels", f'WITH {TILES}, {PLOTS}, {_WINDOWS} SELECT plot_id, path, CAST(r.range AS BIGINT) AS "row", CAST(c.range AS BIGINT) AS col, {_CELL} AS z FROM ww, range(30) r, range(40) c WHERE r.range >= row0 AND r.range < row1 AND c.range >= col0 AND c.range < col1')
def clip_pixels(spark, sf_dir):
    paths = adapters.tiles(spark, sf_dir).where("kind = 'CHM' AND epsg IS NOT NULL").select("path")
    px = paths.selectExpr("path", "explode(sequence(0L, 29L)) AS row").selectExpr("path", "row", "explode(sequence(0L, 39L)) AS col").selectExpr("*", "((row * 7 + col * 3 + length(path)) % 50) / 4.0e0 AS z")
    return op.clip_pixels(px, _windows(spark, sf_dir))


@query("mosaic_first", f'WITH {PIXELS} SELECT "row", col, round(arg_min(z, plot_id), 6) AS z FROM a_pixels WHERE NOT nodata GROUP BY "row", col')
def mosaic_first(spark, sf_dir):
    return rounded(op.mosaic(adapters.pixels(spark, sf_dir).select("row", "col", F.col("plot_id").alias("ord"), F.when(~F.col("nodata"), F.col("z")).alias("z"))))


@query("pair_left_join", "WITH f AS (SELECT 'P' || n_nationkey || '_CHM_1m.tif' AS path FROM nation UNION ALL SELECT 'P' || n_nationkey || '_LAZ_1m.laz' FROM nation WHERE n_nationkey % 3 > 0) SELECT c.id, c.path AS chm, coalesce(l.path, '') AS laz FROM (SELECT split_part(path, '_', 1) AS id, path FROM f WHERE path LIKE '%.tif') c LEFT JOIN (SELECT split_part(path, '_', 1) AS id, path FROM f WHERE path LIKE '%.laz') l USING (id)")
def pair_left_join(spark, sf_dir):
    from ..sources.listing import pairs

    n = adapters.table(spark, sf_dir, "nation")
    f = n.select(F.format_string("P%d_CHM_1m.tif", "n_nationkey").alias("path")).unionAll(n.where("n_nationkey % 3 > 0").select(F.format_string("P%d_LAZ_1m.laz", "n_nationkey").alias("path")))
    return pairs(f)


@query("filename_parse", "SELECT n_name || '_CHM_0.5m.tif' AS path, n_name AS prefix, '0.5' AS res, 'CHM' AS kind, n_name || '_0.5' AS key FROM nation UNION ALL SELECT n_name || '_LAZ_2m.LAZ', n_name, '2', 'LAZ', n_name || '_2' FROM nation")
def filename_parse(spark, sf_dir):
    from ..sources.listing import parsed

    n = adapters.table(spark, sf_dir, "nation")
    f = n.select(F.concat("n_name", F.lit("_CHM_0.5m.tif")).alias("path")).unionAll(n.select(F.concat("n_name", F.lit("_LAZ_2m.LAZ")).alias("path")))
    return parsed(f).select("path", "prefix", "res", "kind", "key")
