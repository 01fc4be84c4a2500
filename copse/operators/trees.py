"""Tree detection and crowns: scale-space responses, suppression, watershed crowns, plot metrics."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import cut
from . import masks, stencils
from .components import PLOT_PIXELS, label, plotwise, rasters, refuse_large

# Detector parameters.
SIGMAS_M = (0.6, 0.9, 1.3, 1.8, 2.6, 3.2)
PCTL_SMALL, PCTL_LARGE, SMALL_M = 93.0, 96.0, 1.0
SUPPORT, RELAX = 5000, 2.0
MIN_H, LHD_MIN, BLOB_MIN, NMS_K = 4.0, 0.9, 0.50, 2.2
COMPACTNESS, MIN_AREA = 8.0, 2.0
PLATEAU, LHD_PLATEAU = 30, 0.8
PIT_RADIUS_M, PIT_DEPTH_M = 1.2, 0.8


def local_height(px: DataFrame, pixel: float, radius: float = 5.0) -> DataFrame:
    """Adds ``lhd``: height over a Gaussian background."""
    k = stencils.gauss(max(radius / pixel / 2.355, 0.2))
    return stencils.convolved(px, "z", {"_bg": [(k, k)]}).withColumn("lhd", F.col("z") - F.col("_bg")).drop("_bg")


def log_responses(px: DataFrame, pixel: float, sigmas: tuple[float, ...] = SIGMAS_M) -> DataFrame:
    """Adds array ``resp``: scale-normalised negative Laplacian of Gaussian at each scale."""
    kernels = {}
    for i, s in enumerate(sigmas):
        width = max(s / pixel, 0.5)
        g, d = stencils.gauss(width), [(at, -(width**2) * w) for at, w in stencils.gauss(width, 2)]
        kernels[f"r{i}"] = [(d, g), (g, d)]
    df = stencils.convolved(px, "z", kernels)
    return df.select(*px.columns, F.array(*kernels).alias("resp"))


def best_scale() -> Column:
    """Index of the first largest response."""
    return (F.array_position("resp", F.array_max("resp")) - 1).cast("int")


def scale_thresholds(resp: DataFrame, mask: str = "mask", sigmas: tuple[float, ...] = SIGMAS_M) -> DataFrame:
    """``(plot_id, scale, threshold)``: percentile of positive masked responses, relaxed where they are few."""
    rows = resp.where(mask).select("plot_id", F.posexplode("resp").alias("scale", "r")).where("r > 0")
    small = [i for i, s in enumerate(sigmas) if s <= SMALL_M]
    pct = lambda relax: F.when(F.col("scale").isin(small), max(50.0, PCTL_SMALL - relax) / 100).otherwise(max(50.0, PCTL_LARGE - relax) / 100)
    q = sorted({(p - r) / 100 for p in (PCTL_SMALL, PCTL_LARGE) for r in (0.0, RELAX)})
    agg = rows.groupBy("plot_id", "scale").agg(F.percentile("r", F.array(*[F.lit(x) for x in q])).alias("q"), F.count("*").alias("n"))
    want = F.when(F.col("n") >= SUPPORT, pct(0.0)).otherwise(pct(RELAX))
    at = F.coalesce(*[F.when(F.abs(want - x) < 1e-9, F.get("q", F.lit(i))) for i, x in enumerate(q)])
    return agg.select("plot_id", "scale", at.alias("threshold"))


def hessian(px: DataFrame, pixel: float, sigma: float) -> DataFrame:
    """Adds eigenvalues ``lam1`` >= ``lam2`` of the smoothed Hessian and ``blobness`` where both are negative."""
    s = max(sigma / pixel, 0.8)
    g, d1, d2 = stencils.gauss(s), stencils.gauss(s, 1), stencils.gauss(s, 2)
    df = stencils.convolved(px, "z", {"ixx": [(d2, g)], "iyy": [(g, d2)], "ixy": [(d1, d1)]})
    return df.withColumns(dict(zip(("lam1", "lam2", "blobness"), blobness(F.col("ixx"), F.col("iyy"), F.col("ixy")), strict=True))).drop("ixx", "iyy", "ixy")


def blobness(ixx: Column, iyy: Column, ixy: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a Hessian, the larger first, and the ratio of their sizes where both are negative."""
    trace, det = ixx + iyy, ixx * iyy - ixy * ixy
    root = F.sqrt(F.greatest(trace * trace - 4.0 * det, F.lit(0.0)))
    one, two = 0.5 * (trace + root), 0.5 * (trace - root)
    return one, two, F.when((one < 0) & (two < 0), F.least(F.abs(one), F.abs(two)) / (F.greatest(F.abs(one), F.abs(two)) + 1e-6))


def blobs(px: DataFrame, pixel: float, sigmas: tuple[float, ...] = SIGMAS_M) -> DataFrame:
    """Adds array ``blob``: the blobness at each scale, all of them in one pass over lines."""
    kernels = {}
    for i, sigma in enumerate(sigmas):
        g, d1, d2 = (stencils.gauss(max(sigma / pixel, 0.8), k) for k in range(3))
        kernels |= {f"_xx{i}": [(d2, g)], f"_yy{i}": [(g, d2)], f"_xy{i}": [(d1, d1)]}
    df = stencils.convolved(px, "z", kernels)
    return df.select(*px.columns, F.array(*[blobness(F.col(f"_xx{i}"), F.col(f"_yy{i}"), F.col(f"_xy{i}"))[2] for i in range(len(sigmas))]).alias("blob"))


def _blobness(z: np.ndarray, sigma: float) -> np.ndarray:
    """The blobness of a stack of rasters of one form at a width in pixels, NaN where there is none; as ``blobs`` adds it up."""
    n, h, w = z.shape
    g, d1, d2 = (stencils.gauss(max(sigma, 0.8), k) for k in range(3))
    upright = np.ascontiguousarray(z.transpose(0, 2, 1)).reshape(n * w, h)
    down = lambda taps: np.ascontiguousarray(stencils.weighted(upright, taps).reshape(n, w, h).transpose(0, 2, 1)).reshape(n * h, w)
    xx, yy, xy = (stencils.weighted(down(a), b) for a, b in ((d2, g), (g, d2), (d1, d1)))
    trace, det = xx + yy, xx * yy - xy * xy
    root = np.sqrt(np.maximum(trace * trace - 4.0 * det, 0.0))
    one, two = 0.5 * (trace + root), 0.5 * (trace - root)
    size = np.abs(one), np.abs(two)
    return np.where((one < 0) & (two < 0), np.minimum(*size) / (np.maximum(*size) + 1e-6), np.nan).reshape(n, h * w)


#: Pixels of the rasters that are weighted together.
STACK = 1 << 15


def raster_blobs(rasters_: DataFrame, pixel: float, sigmas: tuple[float, ...] = SIGMAS_M) -> DataFrame:
    """As ``blobs``, of whole rasters (plot_id, width, z: an array in raster order): ``(plot_id, row, col, blob)``; no pixel is sent between tasks."""

    def run(plots: pa.Array, widths: pa.Array, z: pa.Array) -> pa.Array:
        refuse_large(plots, z)
        at, size, w = z.offsets.to_numpy(), z.value_lengths().fill_null(0).to_numpy(), widths.to_numpy()
        v = z.values.cast(pa.float64()).fill_null(np.nan).to_numpy()
        edges = np.concatenate([[0], np.cumsum(size)])
        out = np.full((edges[-1], len(sigmas)), np.nan)
        for n, wide in set(zip(size.tolist(), w.tolist(), strict=True)):
            same = np.flatnonzero((size == n) & (w == wide))
            many = max(1, STACK // max(n, 1))
            for own in (same[k : k + many] for k in range(0, len(same) if n else 0, many)):
                stack, to = v[at[own, None] + np.arange(n)].reshape(len(own), -1, wide), edges[own, None] + np.arange(n)
                for i, sigma in enumerate(sigmas):
                    out[to, i] = _blobness(stack, sigma / pixel)
        flat = out.ravel()
        scales = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(sigmas), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), scales)

    made = F.arrow_udf(run, "array<array<double>>")("plot_id", "width", "z")
    cells = rasters_.select("plot_id", "width", F.posexplode(made).alias("k", "blob"))
    return cells.select("plot_id", F.expr("k div width").alias("row"), (F.col("k") % F.col("width")).alias("col"), "blob")


def slope(px: DataFrame) -> DataFrame:
    """Adds ``slope``: Sobel magnitude of the raster smoothed by one pixel."""
    g = stencils.gauss(1.0)
    df = stencils.convolved(px, "z", {"_s": [(g, g)]})
    smooth, edge = [(-1, 0.25), (0, 0.5), (1, 0.25)], [(-1, -0.5), (0, 0.0), (1, 0.5)]
    df = stencils.convolved(df, "_s", {"_y": [(edge, smooth)], "_x": [(smooth, edge)]})
    return df.withColumn("slope", F.sqrt((F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")) / 2)).drop("_s", "_x", "_y")


def suppressed(candidates: DataFrame, factor: float = 1.0) -> DataFrame:
    """Greedy suppression per plot: in descending score each kept point removes all within its radius ``r``; ties by row, then column."""
    entry = F.struct((-F.col("score")).alias("s"), "row", "col", (F.col("r") * factor).alias("r"), "tree_id")
    lists = candidates.groupBy("plot_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))  # the candidates of one plot
    kind = lists.schema["all"].dataType.simpleString()

    def add(acc: Column, v: Column) -> Column:
        near = lambda k: F.sqrt((k.row - v.row) * (k.row - v.row) + (k.col - v.col) * (k.col - v.col)) <= k.r
        return F.when(F.exists(acc, near), acc).otherwise(F.concat(acc, F.array(v)))

    kept = F.aggregate("all", F.array().cast(kind), add)
    return lists.select("plot_id", F.explode(kept).alias("k")).select("plot_id", "k.tree_id", "k.row", "k.col", (-F.col("k.s")).alias("score"), "k.r")


def nearest(tops: DataFrame, pixel: float, cell: int = 8) -> DataFrame:
    """``(plot_id, tree_id, nnd)``: distance to the nearest other tree of the plot.

    Trees are compared with those of the 3 x 3 cells around; one that finds none
    as near as a cell is wide there is compared with all of its plot.  Here and
    below joins are hinted to merge: sizes of derived rows are estimated far too
    low, and a broadcast would hold all trees in the driver.
    """
    d = F.sqrt((F.col("row") - F.col("r2")) * (F.col("row") - F.col("r2")) + (F.col("col") - F.col("c2")) * (F.col("col") - F.col("c2")))
    at = tops.select("plot_id", "tree_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    o = at.select("plot_id", F.col("tree_id").alias("o"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    around = F.explode(F.array(*[F.struct((F.floor(F.col("row") / cell) + a).alias("y"), (F.floor(F.col("col") / cell) + b).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("_c")
    near = at.select("*", around).select("plot_id", "tree_id", "row", "col", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"))
    near = near.join(o.withColumns({"y": F.floor(F.col("r2") / cell), "x": F.floor(F.col("c2") / cell)}).hint("merge"), ["plot_id", "y", "x"])
    found = near.where(F.col("tree_id") != F.col("o")).groupBy("plot_id", "tree_id").agg(F.min(d).alias("nnd")).where(F.col("nnd") <= cell)
    rest = at.join(found.hint("merge"), ["plot_id", "tree_id"], "left_anti").join(o.hint("merge"), "plot_id").where(F.col("tree_id") != F.col("o")).groupBy("plot_id", "tree_id").agg(F.min(d).alias("nnd"))
    return found.unionByName(rest).withColumn("nnd", F.col("nnd") * pixel)


def spacing(tops: DataFrame, pixel: float) -> DataFrame:
    """Mean and variation of the distances; null for fewer than two trees."""
    agg = nearest(tops, pixel).groupBy("plot_id").agg(F.avg("nnd").alias("mean_nnd_m"), (F.stddev_samp("nnd") / F.greatest(F.avg("nnd"), F.lit(1e-6))).alias("cv_nnd"))
    return tops.select("plot_id").distinct().join(agg.hint("merge"), "plot_id", "left")


def rmax(h: Column) -> Column:
    return F.least(F.greatest(0.8 + 0.25 * h, F.lit(1.2)), F.lit(5.0))


def crowns(labels: DataFrame, tops: DataFrame, pixel: float, least: float = MIN_AREA) -> DataFrame:
    """Crown records of labelled pixels (plot_id, row, col, z, tree_id, and the raster's height and width) and treetops with height ``h``; small crowns drop out."""
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("height") - 1) | (F.col("col") == F.col("width") - 1)
    c = labels.groupBy("plot_id", "tree_id").agg((F.count("*") * (pixel * pixel)).alias("area_m2"), F.avg("z").alias("mean_h"), F.max("z").alias("max_h"), F.max(edge.cast("int")).alias("edge_flag")).where(F.col("area_m2") >= least)
    c = c.join(tops.select("plot_id", "tree_id", F.col("h").alias("peak_h")).hint("merge"), ["plot_id", "tree_id"])
    r = F.sqrt(F.col("area_m2") / F.pi())
    return c.withColumns({"radius_eq_m": r, "r_max_m": rmax(F.col("peak_h"))}).withColumn("oversize", (F.col("radius_eq_m") > 1.15 * F.col("r_max_m")).cast("int"))


def pix_to_xy(transform: tuple[float, float, float, float, float, float], row: str = "row", col: str = "col") -> tuple[Column, Column]:
    """Position of a pixel's corner: x = c + col a + row b, y = f + col d + row e."""
    a, b, c, d, e, f = transform
    return (F.col(col) * a + F.col(row) * b + c), (F.col(col) * d + F.col(row) * e + f)


def plot_metrics(tops: DataFrame, crown: DataFrame, pixel: float, plots: DataFrame) -> DataFrame:
    """The slim table, a row for each of ``plots`` (plot_id, pixels): treetops are counted, all else is of the crowns that stay."""
    n = tops.groupBy("plot_id").agg(F.count("*").alias("n_trees"))
    cv = F.when(F.count("*") > 1, F.stddev_samp("radius_eq_m") / F.greatest(F.avg("radius_eq_m"), F.lit(1e-6))).otherwise(0.0)
    c = crown.groupBy("plot_id").agg(F.sum("area_m2").alias("_area"), F.avg("radius_eq_m").alias("mean_radius_m"), cv.alias("cv_radius"), F.avg("oversize").alias("pct_oversize"), F.avg("edge_flag").alias("pct_edge_trees"), F.avg("peak_h").alias("mean_peak_h"))
    df = plots.join(n.hint("merge"), "plot_id", "left").join(spacing(tops, pixel).hint("merge"), "plot_id", "left").join(c.hint("merge"), "plot_id", "left")
    return df.select("plot_id", F.coalesce("n_trees", F.lit(0)).alias("n_trees"), "mean_nnd_m", "cv_nnd", (F.col("_area") / (F.col("pixels") * (pixel * pixel))).alias("cover_ratio"), "mean_radius_m", "cv_radius", "pct_oversize", "pct_edge_trees", "mean_peak_h")


def watershed(image: np.ndarray, tops: list[tuple[int, int]], mask: np.ndarray, compactness: float) -> np.ndarray:
    """Labels grown from markers in order of cost: image value plus compactness times distance to the marker; ties in order of entry; 4 neighbours."""
    out, n = np.zeros(image.shape, np.int32), 0
    agenda: list[tuple[float, int, int, int, int]] = []
    for i, (r, c) in enumerate(tops, 1):
        if mask[r, c]:
            agenda.append((float(image[r, c]), n, r, c, i))
            n += 1
    heapq.heapify(agenda)
    while agenda:
        _, _, r, c, i = heapq.heappop(agenda)
        if out[r, c]:
            continue
        out[r, c] = i
        r0, c0 = tops[i - 1]
        for a, b in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= a < image.shape[0] and 0 <= b < image.shape[1] and mask[a, b] and not out[a, b]:
                heapq.heappush(agenda, (float(image[a, b]) + compactness * float(np.hypot(a - r0, b - c0)), n, a, b, i))
                n += 1
    return out


def peaks(resp: np.ndarray, threshold: float, distance: int) -> list[tuple[int, int]]:
    """Local maxima above a threshold, at least so many pixels apart (larger of the two axes), borders allowed; the best pixel of a plateau."""
    top = stencils.extreme(resp, distance, True)
    r, c = np.nonzero((resp == top) & (resp > threshold))
    kept: list[tuple[int, int]] = []
    for k in np.argsort(-resp[r, c], kind="stable"):
        if all(max(abs(r[k] - a), abs(c[k] - b)) > distance for a, b in kept):
            kept.append((int(r[k]), int(c[k])))
    return kept


def collapsed(found: list[tuple[int, int]], pick: np.ndarray) -> list[tuple[int, int, int]]:
    """Of touching peaks the one with the largest ``pick``, the first in raster order among equals, and how many they are."""
    m = np.zeros(pick.shape, bool)
    for r, c in found:
        m[r, c] = True
    lab = label(m)
    size = np.bincount(lab.ravel())
    best: dict[int, tuple[int, int]] = {}
    for r, c in sorted(found, key=lambda p: (-pick[p], p)):
        best.setdefault(int(lab[r, c]), (r, c))
    return [(r, c, int(size[k])) for k, (r, c) in best.items()]


def local_maxima(px: DataFrame, value: str, threshold: float, distance: int) -> DataFrame:
    """``(plot_id, row, col)`` of the peaks of each plot, collapsed over touching ones."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (a,) = rasters(frame, "v")
        return pd.DataFrame([(key[0], r, c) for r, c, _ in collapsed(peaks(a, threshold, distance), a)], columns=["plot_id", "row", "col"])

    return plotwise(px.selectExpr("plot_id", "row", "col", f"{value} AS v"), run, "plot_id long, row long, col long")


def watershed_labels(px: DataFrame, tops: DataFrame, compactness: float = COMPACTNESS) -> DataFrame:
    """``(plot_id, row, col, z, tree_id, height, width)``: pixels (z, slope, mask) grown from treetops (plot_id, row, col, tree_id).

    A plot and its treetops are one task's unit (see :func:`components.plotwise`); plots without treetops have no labels.
    """
    names = ["plot_id", "row", "col", "z", "tree_id", "height", "width"]

    def run(key: tuple, frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(own):
            return pd.DataFrame([], columns=names)
        if len(frame) > PLOT_PIXELS:
            raise ValueError(f"plot {key[0]} has {len(frame)} pixels, more than {PLOT_PIXELS}; clip it first")
        z, s, m = rasters(frame, "z", "slope", "m")
        own = own.sort_values("tree_id")
        lab = watershed(s, list(zip(own["row"].tolist(), own["col"].tolist(), strict=True)), m > 0, compactness)
        r, c = np.nonzero(lab)
        ids = own["tree_id"].to_numpy()
        return pd.DataFrame({"plot_id": key[0], "row": r, "col": c, "z": z[r, c], "tree_id": ids[lab[r, c] - 1], "height": lab.shape[0], "width": lab.shape[1]})

    a = px.selectExpr("plot_id", "row", "col", "z", "slope", "CAST(mask AS DOUBLE) AS m").groupBy("plot_id")
    b = tops.selectExpr("plot_id AS plot", "CAST(row AS BIGINT) AS row", "CAST(col AS BIGINT) AS col", "tree_id").groupBy("plot")  # a name of its own, as treetops may come from the same pixels
    return a.cogroup(b).applyInPandas(run, "plot_id long, row long, col long, z double, tree_id long, height long, width long")


def _percentile(values: np.ndarray, q: float) -> float:
    """As Spark's exact percentile."""
    v, at = np.sort(values), (len(values) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return float(v[low]) if low == high else float((high - at) * v[low] + (at - low) * v[high])


def _spared(found: list[tuple], factor: float) -> list[tuple]:
    """Greedy suppression of (score, row, col, r, ...), which are in order: each that is kept removes all within its radius."""
    kept: list[tuple] = []
    for x in found:
        if all(np.sqrt((k[1] - x[1]) ** 2 + (k[2] - x[2]) ** 2) > k[3] * factor for k in kept):
            kept.append(x)
    return kept


def treetops(z: np.ndarray, mask: np.ndarray, pixel: float, sigmas: tuple[float, ...] = SIGMAS_M, equalise: bool = True) -> list[tuple[int, int, float, float, float]]:
    """Treetops of one raster by descending score: (row, col, sigma_m, h, score); see :func:`detect`."""
    if equalise:
        z = masks.equalised_under(z, mask)
    background = stencils.gauss(max(5.0 / pixel / 2.355, 0.2))
    lhd = z - stencils.convolve(z, background, background)
    resp, blob = [], []
    for s in sigmas:
        width, broad = max(s / pixel, 0.5), max(s / pixel, 0.8)
        g, d = stencils.gauss(width), [(at, -(width**2) * w) for at, w in stencils.gauss(width, 2)]
        resp.append(stencils.convolve(z, d, g) + stencils.convolve(z, g, d))
        g0, g1, g2 = (stencils.gauss(broad, k) for k in range(3))
        xx, yy, xy = stencils.convolve(z, g2, g0), stencils.convolve(z, g0, g2), stencils.convolve(z, g1, g1)
        trace, det = xx + yy, xx * yy - xy * xy
        root = np.sqrt(np.maximum(trace * trace - 4.0 * det, 0.0))
        one, two = 0.5 * (trace + root), 0.5 * (trace - root)
        size = np.abs(one), np.abs(two)
        blob.append(np.where((one < 0) & (two < 0), np.minimum(*size) / (np.maximum(*size) + 1e-6), -np.inf))
    best, found = np.argmax(resp, axis=0), []
    for i, s in enumerate(sigmas):
        positive = resp[i][mask & (resp[i] > 0)]
        if not positive.size:
            continue
        pct = (PCTL_SMALL if s <= SMALL_M else PCTL_LARGE) - (0.0 if positive.size >= SUPPORT else RELAX)
        over = np.where(mask & (resp[i] > _percentile(positive, max(50.0, pct) / 100)), resp[i], 0.0)
        for r, c, n in collapsed(peaks(over, 0.0, max(int(1.6 * (s / pixel)), 1)), lhd):
            if z[r, c] >= MIN_H and lhd[r, c] >= (LHD_PLATEAU if n >= PLATEAU else LHD_MIN) and best[r, c] == i and blob[i][r, c] >= BLOB_MIN:
                found.append((float(resp[i][r, c]), r, c, s * (NMS_K / pixel), float(s), float(z[r, c])))
    found.sort(key=lambda x: (-x[0], x[1], x[2], x[4]))
    return [(r, c, sigma, h, score) for score, r, c, _, sigma, h in _spared(_spared(found, 1.0), 0.8)]


def detect(px: DataFrame, pixel: float, sigmas: tuple[float, ...] = SIGMAS_M, equalise: bool = True) -> DataFrame:
    """Treetops (plot_id, row, col, sigma_m, h, score, tree_id) of plots (z, mask).

    The raster is equalised under the mask first.  Peaks of each scale's
    response above its threshold must be tall, stand out (plateaus of PLATEAU
    pixels less so), have their largest response at that scale and be blobs;
    then they are suppressed twice.  Numbers go by descending score.  A plot is
    one task's unit (see :func:`components.plotwise`): no filter's raster is written.
    """
    names = ["plot_id", "row", "col", "sigma_m", "h", "score", "tree_id"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        z, m = rasters(frame, "z", "m")
        return pd.DataFrame([(key[0], *t, i) for i, t in enumerate(treetops(z, np.nan_to_num(m) > 0, pixel, sigmas, equalise), 1)], columns=names)

    return plotwise(px.selectExpr("plot_id", "row", "col", "z", "CAST(mask AS DOUBLE) AS m"), run, "plot_id long, row long, col long, sigma_m double, h double, score double, tree_id long")


def sloped(z: np.ndarray) -> np.ndarray:
    """Sobel magnitude of one raster smoothed by one pixel."""
    g = stencils.gauss(1.0)
    z = stencils.convolve(z, g, g)
    smooth, edge = [(-1, 0.25), (0, 0.5), (1, 0.25)], [(-1, -0.5), (0, 0.0), (1, 0.5)]
    y, x = stencils.convolve(z, edge, smooth), stencils.convolve(z, smooth, edge)
    return np.sqrt((x * x + y * y) / 2)


def delineate(px: DataFrame, pixel: float) -> dict[str, DataFrame]:
    """All of a batch of plots (plot_id, row, col, z): ``tops``, ``labels``, ``crowns`` (the tree table) and ``features``, one row a plot.

    Pits are filled, the three masks meet, treetops are found and crowns grown
    on the slope; labels of crowns that are too small are dropped.  A plot
    without treetops has 0 trees and null metrics.  A plot is one task's unit
    from its heights to its labels; only trees with the pixels of their crowns
    are written, as tree 0 the plot itself.
    """
    radius = max(1, round(PIT_RADIUS_M / pixel))
    names = ["plot_id", "tree_id", "row", "col", "sigma_m", "h", "score", "height", "width", "pixels", "rows", "cols", "zs"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (z,) = rasters(frame, "z")
        z = np.maximum(np.nan_to_num(z), 0.0)
        up = stencils.extreme(stencils.extreme(z, radius, True), radius, False)
        z = np.where(up - z <= PIT_DEPTH_M, up, z + PIT_DEPTH_M)
        mask = masks.intersection(z > masks.MASK_MIN_H, z >= masks.MASK_MIN_H, z, pixel)
        tops = treetops(z, mask, pixel)
        out: list[tuple] = [(key[0], 0, 0, 0, 0.0, 0.0, 0.0, *z.shape, len(frame), [], [], [])]
        lab = watershed(sloped(z), [(r, c) for r, c, *_ in tops], mask, COMPACTNESS) if tops else None
        for i, t in enumerate(tops, 1):
            r, c = np.nonzero(lab == i)
            out.append((key[0], i, *t, *z.shape, len(frame), r, c, z[r, c]))
        return pd.DataFrame(out, columns=names)

    kinds = "plot_id long, tree_id long, row long, col long, sigma_m double, h double, score double, height long, width long, pixels long, rows array<int>, cols array<int>, zs array<double>"
    made = cut(plotwise(px.select("plot_id", "row", "col", F.col("z").cast("double").alias("z")), run, kinds))
    trees = made.where("tree_id > 0")
    tops = trees.select("plot_id", "row", "col", "sigma_m", "h", "score", "tree_id")
    cells = trees.select("plot_id", "tree_id", "height", "width", F.explode(F.arrays_zip("rows", "cols", "zs")).alias("c"))
    labels = cells.select("plot_id", F.col("c.rows").cast("long").alias("row"), F.col("c.cols").cast("long").alias("col"), F.col("c.zs").alias("z"), "tree_id", "height", "width")
    table = cut(crowns(labels, tops, pixel).join(tops.drop("h").hint("merge"), ["plot_id", "tree_id"]))
    labels = labels.join(table.select("plot_id", "tree_id").hint("merge"), ["plot_id", "tree_id"], "left_semi")
    return {"tops": tops, "labels": labels, "crowns": table, "features": plot_metrics(tops, table, pixel, made.where("tree_id = 0").select("plot_id", "pixels"))}
