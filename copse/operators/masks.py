"""Masks of the tree detector, adaptive equalisation under a mask, and outlines of crowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stencils
from .components import label, plotwise, refuse_large, with_raster

# Thresholds of the masks.
MASK_MIN_H, CLOSE_PX, MIN_CANOPY_M2 = 3.5, 3, 16.0
ROUGH_M, ROUGH_STD = 2.0, 0.28
# Grey levels, bins, clip share and tiles of the equalisation.
GRAYS, BINS, CLIP, TILES = 1 << 14, 256, 0.01, 8


def half_even(x: float) -> int:
    """To the nearest integer, halves to the even one."""
    return round(x)


def height_mask(px: DataFrame, out: str = "height", least: float = MASK_MIN_H) -> DataFrame:
    """Adds a boolean: above the least height, closed by a disk."""
    df = px.withColumn("_tall", F.col("z") > least)
    return stencils.closing(df, "_tall", CLOSE_PX, out).drop("_tall")


def large(mask: np.ndarray, pixel: float, area: float = MIN_CANOPY_M2) -> np.ndarray:
    """Pixels of a raster's components (4 neighbours) of the area or more."""
    lab = label(mask)
    size = np.bincount(lab.ravel())
    return (size[lab] >= max(1, half_even(area / (pixel * pixel)))) & (lab > 0)


def canopy_mask(px: DataFrame, pixel: float, out: str = "canopy", least: float = MASK_MIN_H, area: float = MIN_CANOPY_M2) -> DataFrame:
    """Adds a boolean: in a closed canopy component (4 neighbours) of the area or more; a plot is one task's unit."""
    df = px.withColumn("_tall", F.col("z") >= least)
    return with_raster(df, ["_tall"], lambda m: large(stencils.closed(m > 0, CLOSE_PX), pixel, area), out, "boolean").drop("_tall")


def roughness_mask(px: DataFrame, pixel: float, out: str = "rough", metres: float = ROUGH_M, least: float = ROUGH_STD) -> DataFrame:
    """Adds a boolean: the local deviation in a window of so many metres is the least or more."""
    k = max(1, half_even(metres / pixel))
    df = stencils.local_moments(px, {"_k": (k // 2, k - 1 - k // 2)})
    return df.withColumn(out, F.col("_k_std") >= least).drop("_k_mean", "_k_std")


def rough(z: np.ndarray, pixel: float, metres: float = ROUGH_M, least: float = ROUGH_STD) -> np.ndarray:
    """The roughness mask of one raster."""
    k = max(1, half_even(metres / pixel))
    box = [(d, 1.0 / k) for d in range(-(k // 2), k - k // 2)]
    mean, square = (stencils.convolve(v, box, box, False) for v in (z, z * z))
    return ~(np.sqrt(np.maximum(square - mean * mean, 0.0)) < least)


def intersection(high: np.ndarray, tall: np.ndarray, z: np.ndarray, pixel: float) -> np.ndarray:
    """All masks of one raster: ``high`` is above the least height, ``tall`` at it or above."""
    return stencils.closed(high, CLOSE_PX) & large(stencils.closed(tall, CLOSE_PX), pixel) & rough(z, pixel)


def mask_intersection(px: DataFrame, pixel: float, out: str = "mask") -> DataFrame:
    """Adds a boolean: tall, in a large canopy, and rough; a plot is one task's unit, as components need it whole."""
    df = px.withColumns({"_high": F.col("z") > MASK_MIN_H, "_tall": F.col("z") >= MASK_MIN_H})
    return with_raster(df, ["_high", "_tall", "z"], lambda a, b, z: intersection(a > 0, b > 0, z, pixel), out, "boolean").drop("_high", "_tall")


def quick_stats(px: DataFrame, value: str = "z", mask: Column | None = None) -> DataFrame:
    """``(plot_id, n, min, p50, p95, max)`` of finite values, under a mask if one is given; no row for a plot without any."""
    v = F.col(value).cast("double")
    rows = px.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    if mask is not None:
        rows = rows.where(mask)
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy("plot_id").agg(F.count(v).alias("n"), F.min(v).alias("min"), q[0].alias("p50"), q[1].alias("p95"), F.max(v).alias("max"))


def _clipped(hist: np.ndarray, limit: int) -> np.ndarray:
    """A histogram with what exceeds the limit dealt out evenly over the bins below it."""
    out = np.minimum(hist, limit)
    over = int(hist.sum() - out.sum())
    each = over // len(out)
    room = limit - out
    first = np.where(room > each, each, np.where(room > 0, room, 0))
    out, over = out + first, over - int(first.sum())
    while over > 0 and (room := out < limit).any():
        step = max(1, int(room.sum()) // over)
        for start in range(len(out)):
            own = np.flatnonzero(out[start::step] < limit)[:over] * step + start
            out[own] += 1
            over -= len(own)
            if over <= 0:
                break
    return out


def equalise(values: np.ndarray) -> np.ndarray:
    """Adaptive equalisation of a sequence between 0 and 1: histograms of neighbouring tiles, clipped, mapped and interpolated."""
    n = len(values)
    tile = max(n // TILES, 1)
    span = values.max() - values.min()
    level = np.rint((values - values.min()) / (span or 1) * (GRAYS - 1)).astype(np.int64) // (1 + GRAYS // BINS)
    before, after = tile // 2, (tile - n % tile) % tile + -(-tile // 2)
    wide = np.pad(level, (before, after), mode="reflect" if n > max(before, after) else "symmetric")
    inner = wide[tile // 2 :][: (len(wide) // tile - 1) * tile].reshape(-1, tile)
    limit = max(int(CLIP * tile), 1)
    maps = np.stack([np.minimum(np.cumsum(_clipped(np.bincount(b, minlength=BINS), limit)) * ((GRAYS - 1) / tile), GRAYS - 1).astype(np.int64) for b in inner])
    maps = np.concatenate([maps[:1], maps, maps[-1:]])
    blocks = wide[: len(wide) // tile * tile].reshape(-1, tile)
    share = np.arange(tile) / tile
    at = np.arange(len(blocks))[:, None]
    flat = ((1 - share) * maps[at, blocks] + share * maps[at + 1, blocks]).ravel()[before : before + n]
    low, high = flat.min(), flat.max()
    return (flat - low) / (high - low) if high > low else np.zeros(n)


def equalised_under(z: np.ndarray, under: np.ndarray) -> np.ndarray:
    """One raster equalised under its mask, in raster order, back on its own range; without a mask or a range it stays as it is."""
    z, own = z.copy(), z[under]
    if own.size and own.max() - own.min() >= 1e-6:
        z[under] = equalise((own - own.min()) / (own.max() - own.min())) * (own.max() - own.min()) + own.min()
    return z


def equalised(px: DataFrame, mask: str = "mask", out: str = "z") -> DataFrame:
    """``z`` equalised under the mask, in raster order, back on its own range; plots without a mask or a range stay as they are."""
    made = with_raster(px.withColumn("z", F.col("z").cast("double")), ["z", mask], lambda z, m: equalised_under(z, np.nan_to_num(m) > 0), out, "double")
    return made.select(*px.columns, *[c for c in made.columns if c not in px.columns])


def equalised_rasters(rasters: DataFrame, least: float) -> DataFrame:
    """As ``equalised``, of whole rasters (plot_id, z: an array in raster order) under their pixels above ``least``; no pixel is sent between tasks."""

    def run(plots: pa.Array, z: pa.Array) -> pa.Array:
        refuse_large(plots, z)
        at, v = z.offsets.to_numpy(), z.values.cast(pa.float64()).fill_null(np.nan).to_numpy()
        made = [equalised_under(own, own > least) for own in (v[a:b] for a, b in zip(at, at[1:], strict=False))]
        return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(np.concatenate([v[:0], *made])))

    return rasters.withColumn("z", F.arrow_udf(run, "array<double>")("plot_id", "z"))


def outlines(labels: np.ndarray) -> list[tuple[int, int, list[list[tuple[int, int]]]]]:
    """``(raster, label, rings)`` of each polygon of a stack of label rasters (0: outside), 8-connected: rings of pixel corners (col, row), the outer first.

    Each pixel side between inside and outside is an edge with the inside on its
    right; at a corner where two pieces touch, edges go on to the left, which
    keeps them together.  A ring begins at its topmost corner, the leftmost of
    these, where an outer one goes east and a hole's south.
    """
    _, h, w = labels.shape
    flat = np.pad(labels, ((0, 0), (1, 1), (1, 1))).ravel()
    step, at = (1, w + 2, -1, -w - 2), np.flatnonzero(flat)  # east over a pixel, south right of it, west below, north left of it
    edges, nexts = [], []
    for way in range(4):
        ahead, left = step[way], step[way - 1]
        p = at[flat[at + left] != flat[at]]
        edges.append(p * 4 + way)
        nexts.append(np.select([flat[p + left + ahead] == flat[p], flat[p + ahead] == flat[p]], [(p + left + ahead) * 4 + (way - 1) % 4, (p + ahead) * 4 + way], p * 4 + (way + 1) % 4))
    edge = np.concatenate(edges)
    pixel, way = edge // 4, edge % 4
    of, own = pixel // ((h + 2) * (w + 2)), flat[pixel]
    x, y = pixel % (w + 2) - 1 + ((way == 1) | (way == 2)), pixel // (w + 2) % (h + 2) - 1 + (way > 1)
    order, by_edge = np.lexsort((x, y, own, of)), np.argsort(edge)
    place = np.empty(len(edge), np.int64)
    place[order] = np.arange(len(edge))
    after = place[by_edge[np.searchsorted(edge, np.concatenate(nexts), sorter=by_edge)]][order].tolist()
    of, own, x, y, way = (v[order].tolist() for v in (of, own, x, y, way))
    seen, out, holes = bytearray(len(edge)), [], []
    for start in range(len(edge)):
        if seen[start]:
            continue
        ring, i, last = [], start, -1
        while not seen[i]:
            seen[i] = 1
            if way[i] != last:
                ring.append((x[i], y[i]))
                last = way[i]
            i = after[i]
        ring.append(ring[0])
        (holes if way[start] else out).append((of[start], own[start], [ring]))

    def area(ring: list[tuple[int, int]]) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2

    def within(p: tuple[float, float], ring: list[tuple[int, int]]) -> bool:
        hit = False
        for a, b in zip(ring, ring[1:], strict=False):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                hit = not hit
        return hit

    outer: dict[tuple[int, int], list] = {}
    for k, own_, rings in out if holes else ():
        outer.setdefault((k, own_), []).append((area(rings[0]), rings[0], rings))
    for k, own_, (hole,) in holes:
        side = (hole[0][0] - 0.25, hole[0][1] + 0.5)  # just inside the pixel to the right of the first edge
        min((o for o in outer[k, own_] if within(side, o[1])), key=lambda o: o[0])[2].append(hole)
    return out


def outline(mask: np.ndarray) -> list[list[list[tuple[int, int]]]]:
    """Polygons of a boolean raster, 8-connected: each a list of rings of pixel corners (col, row), the outer first."""
    return [rings for _, _, rings in outlines(np.asarray(mask, np.int8)[None])]


def _wkt(rings: list[list[tuple[int, int]]], transform: tuple[float, ...], row: int = 0, col: int = 0) -> str:
    a, b, c, d, e, f = transform
    at = lambda p: f"{c + (p[0] + col) * a + (p[1] + row) * b!r} {f + (p[0] + col) * d + (p[1] + row) * e!r}"
    return "POLYGON (" + ", ".join("(" + ", ".join(map(at, ring)) + ")" for ring in rings) + ")"


def crown_polygons(labels: DataFrame, transform: tuple[float, float, float, float, float, float]) -> DataFrame:
    """``(plot_id, tree_id, part, wkt)``: outlines of labelled pixels (8 neighbours) in the raster's system.

    ``transform``: x = c + col a + row b and y = f + col d + row e, as (a, b, c, d, e, f).
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for tree, own in frame.groupby("tree_id"):
            r0, c0 = int(own["row"].min()), int(own["col"].min())
            m = np.zeros((int(own["row"].max()) - r0 + 1, int(own["col"].max()) - c0 + 1), bool)
            m[own["row"] - r0, own["col"] - c0] = True
            found += [(key[0], tree, part, _wkt(rings, transform, r0, c0)) for part, rings in enumerate(outline(m))]
        return pd.DataFrame(found, columns=["plot_id", "tree_id", "part", "wkt"])

    return plotwise(labels.select("plot_id", "row", "col", "tree_id"), run, "plot_id long, tree_id long, part int, wkt string")


def raster_polygons(rasters: DataFrame, transform: tuple[float, float, float, float, float, float]) -> DataFrame:
    """As ``crown_polygons``, of whole label rasters (plot_id, width, tree_id: an array in raster order, null outside); no pixel is sent between tasks."""

    def run(plots: pa.Array, widths: pa.Array, trees: pa.Array) -> pa.Array:
        refuse_large(plots, trees)
        at, size, w = trees.offsets.to_numpy(), trees.value_lengths().to_numpy(), widths.to_numpy()
        own = pa.compute.dictionary_encode(trees.values)
        names, flat = own.dictionary.to_pylist(), own.indices.fill_null(-1).to_numpy()
        order = np.argsort(names)
        ranks = np.zeros(len(names) + 1, np.int32)  # the last is of pixels outside
        ranks[order] = np.arange(1, len(names) + 1)
        found: list[list[tuple]] = [[] for _ in size]
        for n, wide in set(zip(size.tolist(), w.tolist(), strict=True)):
            same = np.flatnonzero((size == n) & (w == wide))
            before = None
            for k, rank, rings in outlines(ranks[flat[at[same, None] + np.arange(n)]].reshape(len(same), -1, wide)):
                part = part + 1 if before == (k, rank) else 0  # noqa: F821
                before = k, rank
                found[same[k]].append({"tree_id": names[order[rank - 1]], "part": part, "wkt": _wkt(rings, transform)})
        return pa.array(found, pa.list_(pa.struct([("tree_id", pa.int64()), ("part", pa.int32()), ("wkt", pa.string())])))

    made = F.arrow_udf(run, "array<struct<tree_id: bigint, part: int, wkt: string>>")("plot_id", "width", "tree_id")
    return rasters.select("plot_id", F.explode(made).alias("p")).select("plot_id", "p.tree_id", "p.part", "p.wkt")
