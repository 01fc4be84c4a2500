"""Neighbourhood operators on rasters as relations: one row per pixel (plot_id, row, col, z).

Sliding windows are two passes of window functions, along rows and along
columns, so a plot's pixels are partitioned by line and never gathered; kernels
are weighted sums over lines.  Rasters are complete rectangles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["plot_id", "row", "col"]


def line(axis: str, before: int, after: int):
    """Window along one axis: ``col`` within a row, ``row`` within a column."""
    across = "row" if axis == "col" else "col"
    return Window.partitionBy("plot_id", across).orderBy(axis).rowsBetween(-before, after)


def box_extreme(px: DataFrame, value: str, radius: int, largest: bool, out: str) -> DataFrame:
    """Largest or least value in the square of a radius; a border that repeats pixels adds none, so windows just end there."""
    f = F.max if largest else F.min
    df = px.withColumn("_v", f(value).over(line("col", radius, radius)))
    return df.withColumn(out, f("_v").over(line("row", radius, radius))).drop("_v")


def fill_pits(px: DataFrame, radius: int, depth: float) -> DataFrame:
    """Adds ``filled``: grey closing where it lifts a pixel by ``depth`` at most, else the pixel lifted by ``depth``."""
    df = box_extreme(box_extreme(px, "z", radius, True, "_up"), "_up", radius, False, "_closed")
    return df.withColumn("filled", F.when(F.col("_closed") - F.col("z") <= depth, F.col("_closed")).otherwise(F.col("z") + depth)).drop("_up", "_closed")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def _morph(px: DataFrame, value: str, radius: int, grow: bool, out: str) -> DataFrame:
    """Any (grow) or all of a boolean over a disk; pixels outside do not count.

    A disk is a stack of lines: extremes along rows for each half-width, then the lines above and below.
    """
    f, pick = (F.max, F.greatest) if grow else (F.min, F.least)
    widths = {d: max(b for a, b in disk(radius) if a == d) for d in range(radius + 1)}
    df = px.withColumns({f"_w{w}": f(F.col(value).cast("int")).over(line("col", w, w)) for w in set(widths.values())})
    down = Window.partitionBy("plot_id", "col").orderBy("row")
    lines = [F.col(f"_w{widths[0]}"), *[shift(f"_w{w}", d).over(down) for d, w in widths.items() if d for shift in (F.lag, F.lead)]]
    made = pick(*lines) if len(lines) > 1 else lines[0]
    return df.withColumn(out, made == 1).drop(*[f"_w{w}" for w in set(widths.values())])


def closing(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Binary closing with a disk: growth, then shrinkage."""
    grown = _morph(px, value, radius, True, "_grown")
    return _morph(grown, "_grown", radius, False, out).drop("_grown")


def gauss(sigma: float, order: int = 0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a sampled Gaussian, normalised, or of its first or second derivative."""
    r = int(truncate * sigma + 0.5)
    base = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(base)
    poly = {0: lambda x: 1.0, 1: lambda x: -x / sigma**2, 2: lambda x: x * x / sigma**4 - 1 / sigma**2}[order]
    return [(i, b / total * poly(i)) for i, b in zip(range(-r, r + 1), base, strict=True)]


Taps = list[tuple[int, float]]


def weighted(lines: np.ndarray, taps: Taps, mirror: bool = True) -> np.ndarray:
    """Weighted sums along the rows of a matrix; beyond the borders it is mirrored, edge values repeated, or the edge goes on."""
    n = lines.shape[1]
    reach = max(abs(d) for d, _ in taps)
    at = np.arange(-reach, n + reach)
    wide = lines[:, np.minimum(at % (2 * n), 2 * n - 1 - at % (2 * n)) if mirror else np.clip(at, 0, n - 1)]
    out = np.zeros_like(lines)
    for d, w in taps:
        out += wide[:, reach + d : reach + d + n] * w
    return out


def convolve(z: np.ndarray, down: Taps, right: Taps, mirror: bool = True) -> np.ndarray:
    """One raster weighted along columns, then along rows."""
    return weighted(np.ascontiguousarray(weighted(np.ascontiguousarray(z.T), down, mirror).T), right, mirror)


def extreme(z: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Largest or least value of one raster in the square of a radius."""
    f, none = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    for axis in (0, 1):
        n = z.shape[axis]
        wide = np.pad(z, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], constant_values=none)
        z = f.reduce([wide.take(range(d, d + n), axis) for d in range(2 * radius + 1)])
    return z


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    """Binary closing of one raster with a disk; pixels outside do not count."""

    def grown(m: np.ndarray) -> np.ndarray:
        (h, w), wide, out = m.shape, np.pad(m, radius), m.copy()
        for a, b in disk(radius):
            out |= wide[radius + a : radius + a + h, radius + b : radius + b + w]
        return out

    return ~grown(~grown(mask))


def _along(px: DataFrame, axis: str, sums: dict[str, list[tuple[str, Taps]]], mirror: bool = True) -> DataFrame:
    """Adds a column for each sum of weighted neighbours along one axis; a line of pixels is a value of its own in a batch."""
    across = "row" if axis == "col" else "col"
    used = sorted({v for terms in sums.values() for v, _ in terms})
    carried = [c for c in px.columns if c not in ("plot_id", across)]
    lines = px.groupBy("plot_id", across).agg(F.array_sort(F.collect_list(F.struct(axis, *[c for c in carried if c != axis]))).alias("p"))

    def run(*columns: pd.Series) -> pd.DataFrame:
        sizes = columns[0].map(len).to_numpy()
        out = {name: np.empty(len(sizes), object) for name in sums}
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            given = {v: np.stack(columns[i].iloc[own].to_numpy()).astype(np.float64) for i, v in enumerate(used)}
            for name, terms in sums.items():
                made = sum(weighted(given[v], taps, mirror) for v, taps in terms)
                for k, row in zip(own, made, strict=True):
                    out[name][k] = row
        return pd.DataFrame(out)

    kernel = F.pandas_udf(run, ", ".join(f"{name} array<double>" for name in sums))
    made = lines.select("plot_id", across, "p", kernel(*[F.col("p")[v] for v in used]).alias("m"))
    cells = made.select("plot_id", across, F.explode(F.arrays_zip(F.col("p").alias("p"), *[F.col(f"m.{name}").alias(name) for name in sums])).alias("c"))
    return cells.select("plot_id", across, *[F.col(f"c.p.{v}").alias(v) for v in carried], *[F.col(f"c.{name}").alias(name) for name in sums])


def convolved(px: DataFrame, value: str, kernels: dict[str, list[tuple[Taps, Taps]]]) -> DataFrame:
    """Adds a column for each kernel: a sum of products of weights along rows and along columns; borders mirrored.

    Lines of pixels go to NumPy in Arrow batches, once for each axis and all
    kernels; memory is in proportion to a line, not to the raster.
    """
    first: dict[tuple, str] = {}
    for terms in kernels.values():
        for down, _ in terms:
            first.setdefault(tuple(down), f"_s{len(first)}")
    df = _along(px, "row", {name: [(value, list(taps))] for taps, name in first.items()})
    df = _along(df, "col", {name: [(first[tuple(down)], right) for down, right in terms] for name, terms in kernels.items()})
    return df.select(*px.columns, *kernels)


def local_moments(px: DataFrame, windows: dict[str, tuple[int, int]], value: str = "z") -> DataFrame:
    """Adds ``{name}_mean`` and ``{name}_std`` (population) over the square from ``before`` to ``after`` of each window; the edge goes on outside."""
    v = F.col(value)
    df = px.withColumns({"_a": v, "_b": v * v})
    box = {name: [(d, 1.0 / (before + after + 1)) for d in range(-before, after + 1)] for name, (before, after) in windows.items()}
    df = _along(df, "row", {f"_{m}_{name}": [(f"_{m}", taps)] for name, taps in box.items() for m in "ab"}, False)
    df = _along(df, "col", {f"_{m}{m}_{name}": [(f"_{m}_{name}", taps)] for name, taps in box.items() for m in "ab"}, False)
    made = []
    for name in windows:
        mean, square = F.col(f"_aa_{name}"), F.col(f"_bb_{name}")
        made += [mean.alias(f"{name}_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"{name}_std")]
    return df.select(*px.columns, *made)
