"""Tile catalogue, coverage diagnosis and clipping of plots.

Tiles: path, dir, kind (CHM or LAZ), epsg, xmin, ymin, xmax, ymax.  Plots:
plot_id, e, n, epsg.  A plot's sample points and corners are projected to the
system of each tile they are compared with; tiles and plots without a system
take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import placed, reprojection

BUFFER, HALF, CELL = 2.0, 10.0, 64.0
#: Sample points: four corners from the lower left, then the middles of the south, east, north and west sides.
SAMPLES = ((-1, -1), (1, -1), (1, 1), (-1, 1), (0, -1), (1, 0), (0, 1), (-1, 0))


def plot_name(name: Column) -> Column:
    """Plot ids of the clip: without white space around, in capitals."""
    return F.upper(F.trim(name))


def norm_key(name: Column) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"[\s\-_]+", ""))


def stem_key(path: Column) -> Column:
    """Key of a file name: last part of the path, lower case, ``.copc`` and the extension dropped."""
    name = F.replace(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit(".copc"), F.lit(""))
    return norm_key(F.regexp_replace(name, r"\.[^.]*$", ""))


def kind_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.tiff?$"), "CHM").when(p.rlike(r"\.(las|laz)$"), "LAZ")


def epsg_of(number: Column, text: Column) -> Column:
    """The numeric code first, else what follows ``EPSG:``."""
    return F.coalesce(number.try_cast("int"), F.regexp_extract(F.upper(text), r"^EPSG:\s*([0-9]+)$", 1).try_cast("int"))


def plot_system(plots: DataFrame) -> DataFrame:
    """Adds epsg and crs_status: given, from longitude and latitude (WGS84 UTM), or NO_CRS; no plot stops the others."""
    given = epsg_of(F.col("target_epsg_int"), F.col("target_epsg"))
    zone = (F.floor((F.col("lon") + 180.0) / 6.0) + 1).cast("int")
    utm = F.when(F.col("lat") >= 0, 32600 + zone).otherwise(32700 + zone)
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return plots.withColumns({"epsg": F.coalesce(given, F.when(known, utm)), "crs_status": F.when(given.isNotNull(), "GIVEN").when(known, "FROM_LONLAT").otherwise("NO_CRS")})


def candidates(plots: DataFrame, tiles: DataFrame, whole: bool = False) -> DataFrame:
    """Plots with the tiles whose normalised name contains the plot's; ``whole``: and no further digit follows it.

    Both sides are catalogues of names; a contained string cannot be an equal
    key, so each key of a tile is cut into its substrings as long as a plot
    key, and those join on equality.
    """
    p = plots.withColumn("key", norm_key("plot_id")).where(F.length("key") > 0).withColumn("len", F.length("key"))
    lengths = F.array_sort(F.collect_set("len"))
    sizes = p.agg(lengths.alias("lens"))  # one row
    t = tiles.select(F.struct(*tiles.columns).alias("tile"), stem_key(F.col("path")).alias("stem")).crossJoin(F.broadcast(sizes))
    t = t.select("tile", "stem", F.explode("lens").alias("len")).where(F.length("stem") >= F.col("len"))
    t = t.select("tile", "stem", "len", F.explode(F.sequence(F.lit(1), F.length("stem") - F.col("len") + 1)).alias("at"))
    t = t.select("tile", F.substring("stem", F.col("at"), F.col("len")).alias("key"), F.substring("stem", F.col("at") + F.col("len"), F.lit(1)).alias("next"))
    if whole:
        t = t.where(~F.col("next").rlike("[0-9]"))
    own = p.select(*[F.col(c) for c in plots.columns], "key").join(t.select("tile", "key").distinct(), "key")
    return own.select(*[f"{c}" for c in plots.columns], *[F.col(f"tile.{c}").alias(c if c not in plots.columns else f"tile_{c}") for c in tiles.columns])


def sibling_epsg(tiles: DataFrame) -> DataFrame:
    """Tiles without a system take that of the first raster of their folder that has one."""
    rasters = tiles.where("kind = 'CHM' AND epsg IS NOT NULL").groupBy("dir").agg(F.min_by("epsg", "path").alias("of_dir"))
    return tiles.join(rasters, "dir", "left").withColumn("epsg", F.coalesce("epsg", "of_dir")).drop("of_dir")


def samples(plots: DataFrame, half: float = HALF) -> DataFrame:
    """``(plot_id, idx, x, y)``: corners and side middles of each square."""
    at = F.array(*[F.struct((F.col("e") + half * dx).alias("x"), (F.col("n") + half * dy).alias("y")) for dx, dy in SAMPLES])
    return plots.select("plot_id", F.posexplode(at).alias("idx", "p")).select("plot_id", "idx", "p.x", "p.y")


def inside(x: Column, y: Column, buffer: float = BUFFER) -> Column:
    return x.between(F.col("xmin") - buffer, F.col("xmax") + buffer) & y.between(F.col("ymin") - buffer, F.col("ymax") + buffer)


def rectangles(plots: DataFrame, systems: DataFrame, half: float = HALF) -> DataFrame:
    """``(plot_id, epsg, x0, y0, x1, y1)``: each square's lower left and upper right corner in each system, as a rectangle there.

    ``systems``: one column ``epsg`` of distinct codes; the known ones are fewer than 150, so it is broadcast.
    """
    at = plots.where("epsg IS NOT NULL").select("plot_id", "e", "n", F.col("epsg").alias("own")).crossJoin(F.broadcast(systems.where("epsg IS NOT NULL").limit(150)))
    at = at.select("plot_id", "own", "epsg", "e", "n", F.explode(F.array(F.lit(-half), F.lit(half))).alias("d")).selectExpr("plot_id", "own", "epsg", "e + d AS x", "n + d AS y")
    at = placed(at, reprojection("x", "y", "own", "epsg", "q"), "qe", "qn").where("qe IS NOT NULL")
    return at.groupBy("plot_id", "epsg").agg(F.min("qe").alias("x0"), F.min("qn").alias("y0"), F.max("qe").alias("x1"), F.max("qn").alias("y1"))


def overlap(plots: DataFrame, tiles: DataFrame, half: float = HALF, buffer: float = BUFFER) -> DataFrame:
    """``(plot_id, path)`` whose square meets the tile's bounds, buffered: an equi-join on system and grid cells, then the exact test."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(b / CELL)))
    p = rectangles(plots, tiles.select("epsg").distinct(), half)
    p = p.select("*", cells(F.col("x0") - buffer, F.col("x1") + buffer).alias("cx")).select("*", cells(F.col("y0") - buffer, F.col("y1") + buffer).alias("cy"))
    t = tiles.select("epsg", "path", "xmin", "ymin", "xmax", "ymax", cells(F.col("xmin"), F.col("xmax")).alias("cx")).select("*", cells(F.col("ymin"), F.col("ymax")).alias("cy"))
    meet = (F.col("x0") <= F.col("xmax") + buffer) & (F.col("x1") >= F.col("xmin") - buffer) & (F.col("y0") <= F.col("ymax") + buffer) & (F.col("y1") >= F.col("ymin") - buffer)
    return p.join(t, ["epsg", "cx", "cy"]).where(meet).select("plot_id", "path").distinct()


def coverage(plots: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per plot and kind: mode (single, union or none), tiles that hold all corners, tiles that hold any point, points missing.

    Tiles without a system or bounds take no part; a plot without any tile of
    a kind has mode none and all points missing.
    """
    kinds = plots.select("plot_id", "e", "n", F.col("epsg").alias("own"), F.explode(F.array(F.lit("CHM"), F.lit("LAZ"))).alias("kind"))
    cand = candidates(plots.select("plot_id"), tiles.where("epsg IS NOT NULL AND xmin IS NOT NULL")).select("plot_id", "path", "kind", "epsg", "xmin", "ymin", "xmax", "ymax")
    at = F.array(*[F.struct((F.col("e") + HALF * dx).alias("x"), (F.col("n") + HALF * dy).alias("y")) for dx, dy in SAMPLES])
    points = kinds.join(cand, ["plot_id", "kind"], "left").select("*", F.posexplode(at).alias("idx", "p")).select("plot_id", "kind", "path", "own", "epsg", "xmin", "ymin", "xmax", "ymax", "idx", "p.x", "p.y")
    points = placed(points, reprojection("x", "y", "own", "epsg", "q"), "qe", "qn")
    hit = F.coalesce(inside(F.col("qe"), F.col("qn")), F.lit(False))
    per = points.withColumn("hit", hit).groupBy("plot_id", "kind", "path").agg(F.bool_and(F.when(F.col("idx") < 4, F.col("hit"))).alias("all4"), F.bool_or("hit").alias("any"), F.collect_set(F.when(F.col("hit"), F.col("idx"))).alias("held"))
    agg = per.groupBy("plot_id", "kind").agg(
        F.bool_or("all4").alias("single"), F.count("path").alias("n_tiles"),
        F.array_sort(F.collect_set(F.when(F.col("all4"), F.col("path")))).alias("single_tiles"), F.array_sort(F.collect_set(F.when(F.col("any"), F.col("path")))).alias("union_tiles"),
        F.array_sort(F.collect_set("path")).alias("all_tiles"), F.flatten(F.collect_list("held")).alias("held"),
    )
    missing = F.array_except(F.sequence(F.lit(0), F.lit(7)), "held")
    mode = F.when(F.col("single"), "single").when(F.size(missing) == 0, "union").otherwise("none")
    return agg.select("plot_id", "kind", "n_tiles", mode.alias("mode"), "single_tiles", "union_tiles", "all_tiles", F.when(mode == "none", missing).otherwise(F.array().cast("array<int>")).alias("missing"))


def to_use(c: DataFrame) -> DataFrame:
    """Adds ``use``: the tiles to clip: those that hold the square alone, else those that hold any of it, else all."""
    pick = F.when(F.col("mode") == "single", F.col("single_tiles")).otherwise(F.col("union_tiles"))
    return c.withColumn("use", F.when(F.size(pick) > 0, pick).otherwise(F.col("all_tiles")))


def clip_status(plots: DataFrame, tiles: DataFrame) -> DataFrame:
    """Status per plot and kind: Missing without tiles, NoOverlap if none meets the square, Single or Merged.

    Rasters count the tiles that were clipped, point clouds those that were
    asked for.
    """
    c = to_use(coverage(plots, tiles))
    used = c.select("plot_id", "kind", F.explode("use").alias("path")).join(overlap(plots, tiles.where("xmin IS NOT NULL"), buffer=0.0), ["plot_id", "path"]).groupBy("plot_id", "kind").agg(F.array_sort(F.collect_set("path")).alias("clipped"))
    c = c.join(used, ["plot_id", "kind"], "left").withColumn("clipped", F.coalesce("clipped", F.array().cast("array<string>")))
    count = F.when(F.col("kind") == "CHM", F.size("clipped")).otherwise(F.size("use"))
    status = F.when(F.col("n_tiles") == 0, "Missing").when(F.size("clipped") == 0, "NoOverlap").when(count == 1, "Single").otherwise("Merged")
    return c.withColumn("status", status)


def status_table(plots: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row per plot: modes, statuses, missing points, what has to be downloaded and why."""
    s = clip_status(plots, tiles)
    part = lambda kind: s.where(F.col("kind") == kind).select(F.col("plot_id").alias("PlotID"), F.col("mode").alias(f"{kind}_MODE"), F.col("status").alias(f"{kind}_STATUS"), F.concat_ws(",", F.col("missing").cast("array<string>")).alias(f"{kind}_MISSING_IDX"))
    both = part("CHM").join(part("LAZ"), "PlotID")
    bad = lambda kind: (F.col(f"{kind}_MODE") == "none") | F.col(f"{kind}_STATUS").isin("Missing", "NoOverlap")
    reason = F.concat_ws("|", F.when(bad("CHM"), "CHM_INCOMPLETE"), F.when(bad("LAZ"), "LAZ_INCOMPLETE"))
    return both.withColumns({"NEED_DOWNLOAD": F.when(bad("CHM") | bad("LAZ"), "YES").otherwise("NO"), "REASON": reason})


def log_table(plots: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles used, for each plot and kind that has a clip."""
    s = clip_status(plots, tiles).where("status IN ('Single', 'Merged')")
    files = F.when(F.col("kind") == "CHM", F.col("clipped")).otherwise(F.col("use"))
    return s.select(F.col("plot_id").alias("PlotID"), F.col("kind").alias("Type"), F.concat_ws(";", files).alias("UsedFiles"))


def clip_points(points: DataFrame, boxes: DataFrame, cell: float = 20.0) -> DataFrame:
    """Points inside each closed box (plot_id, xmin, ymin, xmax, ymax), by grid cells and the exact test."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    b = boxes.select(F.col("plot_id").alias("box"), "xmin", "ymin", "xmax", "ymax", cells(F.col("xmin"), F.col("xmax")).alias("cx")).select("*", cells(F.col("ymin"), F.col("ymax")).alias("cy"))
    p = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    hit = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return p.join(b, ["cx", "cy"]).where(hit).drop("cx", "cy", "xmin", "ymin", "xmax", "ymax")


def merge_points(points: DataFrame, by: str = "box", part: str = "point_format", order: str = "path") -> DataFrame:
    """Only points in the format of the first file of each clip."""
    first = points.groupBy(by).agg(F.min_by(part, order).alias("_first"))
    return points.join(first, by).where(F.col(part) == F.col("_first")).drop("_first")


def clip_windows(pairs: DataFrame, size: float = 2 * HALF) -> DataFrame:
    """``(plot_id, path, row0, row1, col0, col1)``: pixel-aligned windows around plots, ends excluded; pairs without any pixel drop out.

    ``pairs``: plot_id, e, n, epsg and the raster's path, tile_epsg, x0 and y0 (upper left corner), px_x, px_y, width and
    height.  A side is the size in pixels rounded half to even, then up to even, 2 at least, cut at the raster's edge.
    """
    at = placed(pairs, reprojection("e", "n", "epsg", "tile_epsg", "q"), "qe", "qn").where("qe IS NOT NULL AND px_x > 0 AND px_y > 0")
    span = lambda px: F.greatest(F.lit(2), F.bround(F.lit(size) / F.col(px)).cast("long") + F.pmod(F.bround(F.lit(size) / F.col(px)).cast("long"), F.lit(2)))
    at = at.withColumns({"_w": span("px_x"), "_h": span("px_y"), "_c": F.floor((F.col("qe") - F.col("x0")) / F.col("px_x")), "_r": F.floor((F.col("y0") - F.col("qn")) / F.col("px_y"))})
    first = lambda c, n: F.col(c) - F.floor(F.col(n) / 2)
    at = at.select(
        "plot_id", "path", F.greatest(first("_r", "_h"), F.lit(0)).alias("row0"), F.least(first("_r", "_h") + F.col("_h"), F.col("height")).alias("row1"),
        F.greatest(first("_c", "_w"), F.lit(0)).alias("col0"), F.least(first("_c", "_w") + F.col("_w"), F.col("width")).alias("col1"),
    )
    return at.where("row0 < row1 AND col0 < col1")


def clip_pixels(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """``(plot_id, path, row, col, ...)``: pixels (path, row, col, ...) of each window, rows and columns as in the raster.

    Spark may know the size of the pixels badly, as of their tiles, and would send all of them through the driver; so the join is by merge.
    """
    hit = (F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row1")) & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col1"))
    return pixels.hint("merge").join(windows, "path").where(hit).select("plot_id", *pixels.columns)


def mosaic(pixels: DataFrame, order: str = "ord") -> DataFrame:
    """The first valid value of each cell in tile order."""
    return pixels.where("z IS NOT NULL").groupBy("row", "col").agg(F.min_by("z", order).alias("z"))
